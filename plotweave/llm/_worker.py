"""Keeping Python workers small.

Spark keeps a worker for later tasks, of other operators too, and free memory in
its heap stays with it. So each function here hands free memory back after each
batch and at a task's end; an executor's memory then is that of its tasks now.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    """glibc's malloc_trim; nothing on other systems, which only keep more."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda keep: 0)


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    _trim()(0)


def lean(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """`run` for mapInArrow, which gives free memory back before it asks for the next batch, and at the end."""

    def freed(batches):
        for b in batches:
            yield b
            del b
            give_back()

    def wrapped(batches):
        try:
            yield from run(freed(batches))
        finally:
            give_back()

    return wrapped
