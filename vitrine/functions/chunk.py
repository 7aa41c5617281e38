"""Chunks of about 160 characters, as rows."""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 160


def units(text: str, size: int = SIZE) -> list[str]:
    """Pieces of at most ``size``: paragraphs, else lines, else words, else slices."""
    if len(text) <= size:
        return [text]
    found, levels = [], ("\n\n", "\n", " ")
    todo = [(text, 0)]
    while todo:
        piece, level = todo.pop()
        if level == len(levels):
            found += (piece[i : i + size] for i in range(0, len(piece), size))
        elif len(piece) <= size:
            found.append(piece)
        else:
            parts = [p for p in piece.split(levels[level]) if p.strip()]
            todo += ((p, level + 1 if len(p) > size else 0) for p in reversed(parts))
    return found


def chunks(text: str | None, size: int = SIZE, overlap: int = 0) -> list[str]:
    """Units joined by spaces up to ``size``; the next chunk starts with the last unit at least, even at no overlap.

    That repeat is part of the semantics: units at a chunk's end count in two chunks.
    """
    if text is None or not text.strip():
        return []
    pieces = units(text, size)
    end = [0, *accumulate(len(p) + 1 for p in pieces)]  # joined length of i..j is end[j] - end[i] - 1
    out, low = [], 0
    for i in range(1, len(pieces)):
        if end[i + 1] - end[low] - 1 > size:
            out.append(" ".join(pieces[low:i]))
            while i - low > 1 and end[i] - end[low] - 1 > overlap:
                low += 1
    return [*out, " ".join(pieces[low:])]


def chunk_column(text: Column, size: int = SIZE, overlap: int = 0) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, size, overlap))

    return run(text)


def chunk_rows(docs: DataFrame, size: int = SIZE, overlap: int = 0) -> DataFrame:
    """doc_id, chunk (from 0) and text of every chunk."""
    return docs.select("doc_id", F.posexplode(chunk_column(F.col("text"), size, overlap)).alias("chunk", "text"))
