"""Packing of token sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, whole_text
from .textbytes import U, mix, tidy, utf8
from .tokens import encoder

VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, pack_group bigint"
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BinTree:
    """Tournament tree of free space: each node has the most that any bin below it has."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Takes ``size`` from the first bin with room; returns the bin and its free space before."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        was = free[node]
        free[node] = was - size
        bin_number = node - self.leaves
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
        return bin_number, was


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, none above ``capacity``; bins are numbered from 0 without gaps."""
    order = np.argsort(-sizes, kind="stable")
    tree = BinTree(len(sizes), capacity)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in order.tolist():
        b, free = tree.place(int(sizes[i]))
        bins[i], offsets[i] = b, capacity - free
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1, group_docs: int = 1024) -> DataFrame:
    """Token pieces of all documents and their places in sequences of ``capacity``.

    A document's ids end with ``end_id``. It is cut every ``capacity`` ids, and
    the pieces of about ``group_docs`` randomly chosen documents are packed
    together, so groups are independent and only lengths are shuffled. Rows draw
    their group from their place in the input, not from their doc_id or text.

    Null and empty texts are one end id; repeated rows are packed each; an
    empty table gives an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path()
    groups = max(1, -(-docs.count() // group_docs))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        seen, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            doc_ids = batch.column(0)
            ids, bounds = encode(*utf8(batch.column(1)))
            group = mix((U(part) << U(32)) + np.arange(seen, seen + len(doc_ids)).astype(U)) % U(groups)
            seen += len(doc_ids)
            row, start, length, crc, total = [], [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.int32(end_id)).astype("<u4")
                for at in range(0, len(own), capacity):
                    piece = own[at : at + capacity]
                    row.append(i)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(own))
            columns = [doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(group[row].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"])

    def fit(table: pa.Table) -> pa.Table:
        size = table.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(size, capacity)
        first = table.column("pack_group")[0].as_py() << 32
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(tidy(pieces), PIECES)
    return cut.repartition(shuffle_partitions(spark), "pack_group").groupBy("pack_group").applyInArrow(fit, PACKED)
