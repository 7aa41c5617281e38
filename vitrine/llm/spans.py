"""Pattern matches with code-point positions, as DataFrame expressions."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,value:string>>"


#: Matches whose positions are added up at once; arrays grow by such pieces, so many matches do not cost their square.
PIECE = 128


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and non-overlapping, with start and end.

    The pieces between matches and the matches themselves alternate, so their
    lengths add up to the positions.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.char_length(part["gap"])
        end = start + F.char_length(part["value"])
        one = F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value"))
        return F.when(part["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found")))

    def placed(parts: Column) -> Column:
        """Of parts that are at hand, so that the text is searched once."""

        def piece(acc: Column, i: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), F.array().cast(MATCHES).alias("found"))
            return F.aggregate(F.slice(parts, i * PIECE + 1, F.lit(PIECE)), begin, add, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["found"], F.array(x["found"])).alias("found")))

        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{MATCHES}>").alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(parts) / PIECE).cast("int")), empty, piece, lambda acc: F.flatten(acc["found"]))

    return F.get(F.transform(F.array(parts), placed), 0)


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


@dataclass(frozen=True)
class Kind:
    """One kind of match. ``hint`` is a cheap test that every text with a match passes."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    keep: Callable[[Column], Column]

    def find(self, text: Column) -> Column:
        found = F.filter(matches(text, self.pattern), lambda m: self.keep(m["value"]))
        return F.when(self.hint(text), found).otherwise(none_of(MATCHES))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))
