"""Arrow batches in parts, so that what Python makes of one is bounded however many rows Spark sends at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows and bytes of a part; a row of more bytes comes by itself.
ROWS, BYTES = 256, 1 << 20


def parts(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, halved until a part is within both bounds; nothing for an empty batch."""
    if batch.num_rows > 1 and (batch.num_rows > rows or batch.nbytes > size):
        half = batch.num_rows // 2
        yield from parts(batch.slice(0, half), rows, size)
        yield from parts(batch.slice(half), rows, size)
    elif batch.num_rows:
        yield batch
