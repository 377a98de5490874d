"""The C heap of a Python worker, which Spark keeps from task to task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

# Parameters of mallopt in glibc's malloc.h.
TRIM_THRESHOLD, TOP_PAD, MMAP_THRESHOLD = -1, -2, -3


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's work on batches, reusing freed memory while it lasts and giving all back at its end.

    Otherwise every large array maps fresh pages, and a worker stays as large
    as its largest task.
    """

    def task(batches: Iterator) -> Iterator:
        pa.set_memory_pool(pa.system_memory_pool())
        _call("mallopt", MMAP_THRESHOLD, 8 << 20)
        _call("mallopt", TRIM_THRESHOLD, 64 << 20)
        _call("mallopt", TOP_PAD, 8 << 20)
        yield from run(batches)
        _call("malloc_trim", 0)

    return task


def _call(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except AttributeError:  # another C library
        pass
