"""What a Python worker holds on to.

Workers live on from stage to stage, and so would every model and cache they ever loaded. A worker
holds the model of one stage at a time: asking for another one, or working on a stage without any,
drops it first. What a partition took is given back to the system when it ends.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import pickle
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa

#: Parameters of the GNU library's allocator (fixed values).
_MMAP_THRESHOLD, _ARENA_MAX = -3, -8
LARGE_BLOCK = 1 << 18

_held: dict[Hashable, object] = {}


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU library has it
        pass


_settled = False


def settle() -> None:
    """Large blocks of memory are mapped one by one and go back when they are freed, instead of
    staying in a heap that only grows; all threads share one heap. Once per worker."""
    global _settled
    if not _settled:
        _settled = True
        try:
            mallopt = ctypes.CDLL(None).mallopt
        except (AttributeError, OSError):
            return
        mallopt(_MMAP_THRESHOLD, LARGE_BLOCK)
        mallopt(_ARENA_MAX, 1)


def model(key: Hashable, build: Callable[[], object]):
    """The model of this key; built, after all others are dropped, if the worker doesn't hold it."""
    if key not in _held:
        _held.clear()
        trim()
        _held[key] = build()
        trim()
    return _held[key]


def unpickled(key: Hashable, held):
    """The model in a broadcast of pickled bytes."""
    return model(key, lambda: pickle.loads(held.value))


def key_of(raw: bytes) -> str:
    return hashlib.md5(raw).hexdigest()


def keep_only(key: Hashable) -> None:
    settle()
    for other in [k for k in _held if k != key]:
        del _held[other]
    trim()


def lean(run: Callable, key: Hashable = None) -> Callable:
    """`run` over the batches of a partition, which holds no model but that of `key`. (A function
    within a function travels to workers by value: it must not touch `_held` itself.)"""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(key)
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
