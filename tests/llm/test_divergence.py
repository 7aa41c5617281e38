import re
from collections import Counter, defaultdict

import pytest
from vitrine.llm.divergence import divergence

SCHEMA = "doc_id long, text string, lang string, source string, rank string"


def expected(rows, least=3, most=200):
    words, texts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        words[lang, source].update(found)
        texts[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in texts[lang].items() if n >= least]
        inside = [g for g in groups if g[0] == lang]

        def share(counts):
            size = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (size + len(kept)) for t in kept}

        p, q = share(words[lang, source]), share(sum((words[g] for g in inside), Counter()))
        pairs = []
        for _, other in inside:
            o = share(words[lang, other])
            pairs.append((other, sum((p[t] - o[t]) ** 2 // o[t] for t in kept)))
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if words[lang, source][t] and p[t] > q[t]]
        for part, items, limit in (("pair", [x for x in pairs if x[0] != source], None), ("term", terms, most)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items[:limit])]
    return sorted(out)


def check(spark, rows, **options):
    found = divergence(spark.createDataFrame(rows, SCHEMA), **options)
    assert sorted(map(tuple, found.collect())) == expected(rows, options.get("least_docs", 3), options.get("most_terms", 200))


@pytest.mark.parametrize("most", [200, 2])
def test_equals_brute_force(spark, most):
    text = ["The cat saw a DOG", "dog and cat; dog's été", "Éte cat\nthe the", "x1y2 the dog", "cat ÉTÉ été"]
    rows = [(i, text[i * 7 % 5] + " hot" * (i % 4), "en" if i % 3 else "de", f"s{i % 5 if i % 2 else 0}", "x") for i in range(60)]
    check(spark, rows, most_terms=most)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None),
        (1, "", "en", None, None),
        (1, "aa bb " * 20_000, "en", "s", None),
        (1, "aa bb", "en", "s", None),
        (1, "aa bb", "en", "s", None),
        (2, "... 123", "en", "only marks", None),
        (3, "alone alone", "xx", "one", None),
        (4, "a lang without kept terms", "yy", "one", None),
        (5, "", "yy", "two", None),
    ]
    check(spark, rows)


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).collect() == []
