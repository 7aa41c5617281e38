"""Text expressions: cleaning of product records, tokens, stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of a packed product record, in order (fixed values).
FIELDS = ("gender", "master_category", "sub_category", "article_type", "base_colour", "season", "year", "usage", "product_name")
#: What counts as no value in a link (fixed values).
UNDEFINED = ("", "undefined", "none", "null", "nan")


def is_defined(column: Column) -> Column:
    """Neither null nor, trimmed and in lower case, one of the words for no value."""
    return column.isNotNull() & ~F.lower(F.trim(column)).isin(*UNDEFINED)


def file_id(path: Column) -> Column:
    """The number that a file is named by, less folder and extension."""
    return F.regexp_extract(path, r"([^/]+)\.[^.]*$", 1).try_cast("int")


def local_path(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(prefix.rstrip("/") + "/"), F.element_at(F.split(url, "/"), -1))


def pack_record(columns: list[Column]) -> Column:
    """Pipe-joined attributes; a null becomes the word nan, so positions stay."""
    return F.array_join(F.array(*(c.cast("string") for c in columns)), "|", "nan")


def unpack_record(record: Column) -> Column:
    """Struct of the nine attributes; missing ones are empty, further ones are dropped."""
    parts = F.split(record, r"\|", -1)
    return F.struct(*(F.coalesce(F.get(parts, i), F.lit("")).alias(n) for i, n in enumerate(FIELDS)))


def sub_category(record: Column) -> Column:
    return F.coalesce(F.get(F.split(record, r"\|", -1), 2), F.lit(""))


def repair_line(line: Column, fields: int = 10) -> Column:
    """CSV fields of a line; commas beyond the last field belong to it."""
    return F.split(line, ",", fields)


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters that are ASCII letters and digits throughout; null gives none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(runs, lambda t: t.rlike("^[a-z0-9]+$"))


def without(words: Column, stop_words: list[str]) -> Column:
    """The words less stop words, which are a short list by nature."""
    if not stop_words:
        return words
    return F.filter(words, lambda t: ~t.isin(*stop_words))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def distinct_terms(df: DataFrame) -> DataFrame:
    return df.select("term").distinct()
