"""Arrow batches in Python workers: pieces of a bounded size, and memory that goes back to the system after a task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a worker turns into Python or numpy objects at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20


def spans(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Start and end of runs of rows whose sizes sum up to `limit` at most, or of one row."""
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield start, stop
        start = stop


def text_bytes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def list_bytes(rows: pa.Array) -> np.ndarray:
    """Bytes of all texts of each row's list; null has none."""
    sums = np.concatenate([[0], np.cumsum(text_bytes(rows.flatten()))])
    counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]


def give_back() -> None:
    """Returns what was freed to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back when it has seen the last one."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return tidied
