"""Blocks of rows for tasks that work on more than one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

BLOCK_BYTES = 16 << 20


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Batches put together until they hold about ``limit`` bytes, so memory follows the limit and not the task's rows."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
