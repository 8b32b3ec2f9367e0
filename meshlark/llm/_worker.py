"""Memory of Python workers, which outlive their tasks: what a task took is handed back when it ends."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes from which glibc maps a block by itself, so that it goes back to the system when it is freed (mallopt's M_MMAP_THRESHOLD is -3).
_MAPPED, _M_MMAP_THRESHOLD = 1 << 20, -3


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_M_MMAP_THRESHOLD, _MAPPED)
        return libc
    except (OSError, AttributeError):  # another C library: nothing to set
        return None


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = _libc()
    if libc is not None:
        libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over batches, after which the worker is as small as before."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _libc()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped
