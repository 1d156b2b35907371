"""What a Python worker holds between tasks. Workers serve the stages of an application one after another, so what each
stage keeps would add up: tables of other stages go when a stage begins, and freed memory goes back to the system when a task ends.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, MutableMapping

import pyarrow as pa

_caches: dict[str, MutableMapping] = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def cache(owner: str, held: MutableMapping) -> MutableMapping:
    """``held``, emptied when a stage of another owner begins."""
    _caches[owner] = held
    return held


def release() -> None:
    """Give freed memory back; allocators keep it otherwise."""
    with contextlib.suppress(NotImplementedError):
        pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def begin(owner: str) -> None:
    for other, held in _caches.items():
        if other != owner:
            held.clear()


def alone(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that keeps tables of ``owner`` only."""

    def out(batches):
        begin(owner)
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return out
