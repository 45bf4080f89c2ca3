"""Arrow batches in workers: texts a few megabytes at a time, and memory given back when a task ends."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of at most `most` in sum, or of one element."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += int(n)
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def text_parts(texts: pa.Array, most: int) -> Iterator[tuple[slice, list[bytes]]]:
    """Consecutive parts of a column of texts, of at most `most` bytes or of one text; nulls are empty."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for cut in slices(sizes, most):
        part = texts.slice(cut.start, cut.stop - cut.start).cast(pa.binary())
        yield cut, [x or b"" for x in part.to_pylist()]


def give_back() -> None:
    """Hand freed memory back to the system: a worker waits for its next task beside others that need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function for mapInArrow that gives memory back when its task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
