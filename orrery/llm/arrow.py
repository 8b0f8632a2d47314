"""Small helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache
from time import monotonic

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose ``column`` holds about ``most_bytes`` each.

    A row larger than that comes alone, so memory follows the longest row.
    """
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.asarray(
        pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
    )
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    col = batch.column(column)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [x or b"" for x in col.to_pylist()]


@lru_cache(maxsize=1)
def _allocator():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_last = [0.0]


def trim(every: float = 0.0) -> None:
    """Gives freed memory back to the system: a worker waits for its next task with no more than it holds."""
    if monotonic() - _last[0] < every:
        return
    pa.default_memory_pool().release_unused()
    if give := _allocator():
        give(0)
    _last[0] = monotonic()


def lean(table: pa.Table) -> pa.Table:
    """``table``, after a group's work, with memory given back once a second at most."""
    trim(1.0)
    return table


def zipped(data: bytes) -> bytes:
    """``data`` in fewer bytes, behind its length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
