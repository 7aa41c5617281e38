"""English stemming by the published Porter2 rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values of the published algorithm
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate",
    "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous",
    "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less",
}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")

_VOWEL = re.compile("[aeiouy]")
_REGION = re.compile("[aeiouy][^aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    known = re.match("gener|commun|arsen", word)
    m = known or _REGION.search(word)
    first = m.end() if m else len(word)
    m = _REGION.search(word, first)
    return first, m.end() if m else len(word)


def _ends_short(word: str) -> bool:
    if len(word) == 2:
        return word[0] in "aeiouy" and word[1] not in "aeiouy"
    return len(word) > 2 and word[-1] not in "aeiouywxY" and word[-2] in "aeiouy" and word[-3] not in "aeiouy"


def stem(word: str) -> str:
    """The stem of one lower-case word."""
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    if word in _SPECIAL:
        return _SPECIAL[word]
    if word in _SAME:
        return word
    # y after a vowel or at the start is a consonant, written Y
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    r1, r2 = _regions(word)

    for suffix in ("'s'", "'s", "'"):  # step 0
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break

    if word.endswith("sses"):  # step 1a
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and _VOWEL.search(word[:-2]):
        word = word[:-1]
    if word in _KEPT:
        return word

    for suffix in ("eedly", "eed", "ingly", "edly", "ing", "ed"):  # step 1b
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if suffix.startswith("eed"):
                if len(base) >= r1:
                    word = base + "ee"
            elif _VOWEL.search(base):
                word = base
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", word):
                    word = word[:-1]
                elif _ends_short(word) and len(word) <= r1:
                    word += "e"
            break

    if len(word) > 2 and word[-1] in "yY" and word[-2] not in "aeiouy":  # step 1c
        word = word[:-1] + "i"

    for suffix in sorted([*_STEP2, "ogi", "li"], key=len, reverse=True):  # step 2
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= r1:
                if suffix == "ogi":
                    word = base + "og" if base.endswith("l") else word
                elif suffix == "li":
                    word = base if base and base[-1] in "cdeghkmnrt" else word
                else:
                    word = base + _STEP2[suffix]
            break

    for suffix in sorted([*_STEP3, "ative"], key=len, reverse=True):  # step 3
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if suffix == "ative":
                word = base if len(base) >= r2 else word
            elif len(base) >= r1:
                word = base + _STEP3[suffix]
            break

    for suffix in sorted([*_STEP4, "ion"], key=len, reverse=True):  # step 4
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) >= r2 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break

    if word.endswith("e"):  # step 5
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _ends_short(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stem_terms(terms: DataFrame) -> DataFrame:
    """term and stem of each distinct term; the function runs once a term, not once an occurrence."""

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return terms.select("term").distinct().select("term", run("term").alias("stem"))
