"""Sums of fixed-size integer arrays over a whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import shuffle_partitions
from .textbytes import tidy

CHUNK, SALTS = 8192, 16
PARTS = "chunk int, salt int, part binary"


def _rows(chunks: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = sorted(chunks)
    data = [zlib.compress(chunks[k].astype("<i8").tobytes(), 1) for k in keys]
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(data, pa.binary())], names=["chunk", "salt", "part"])


def gathered(df: DataFrame, add: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all rows of what ``add`` adds to an array of ``size`` integers.

    Each task sums its own rows. The sums meet in two rounds, first by chunk of
    the array and salt and then by chunk, as streams; the driver gets one array
    of ``size`` whatever the table holds. Integers make the result independent of order.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
        for batch in batches:
            add(batch, total)
        salt = TaskContext.get().partitionId() % SALTS
        chunks = {(i, salt): x for i, x in enumerate(total.reshape(-1, CHUNK)) if x.any()}
        if chunks:
            yield _rows(chunks)

    def meet(keep_salt: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunks: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for chunk, salt, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    key = (chunk, salt if keep_salt else 0)
                    value = np.frombuffer(zlib.decompress(part), "<i8")
                    chunks[key] = chunks[key] + value if key in chunks else value
            if chunks:
                yield _rows(chunks)

        return run

    n = shuffle_partitions(df.sparkSession)
    parts = df.mapInArrow(tidy(count), PARTS).repartition(n, "chunk", "salt").mapInArrow(tidy(meet(True)), PARTS)
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.int64)
    for row in parts.repartition(n, "chunk").mapInArrow(tidy(meet(False)), PARTS).collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] += np.frombuffer(zlib.decompress(row.part), "<i8")
    return out[:size]
