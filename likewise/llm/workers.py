"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

#: By operator, the caches of what its tasks read once per worker.
_CACHES: dict[str, list] = {}


def remembered(operator: str) -> Callable[[Callable], Callable]:
    """Remember a function's last result in a worker, until another operator's task begins there."""

    def of(f: Callable) -> Callable:
        cached = functools.lru_cache(maxsize=1)(f)
        _CACHES.setdefault(operator, []).append(cached)
        return cached

    return of


def begin(operator: str) -> None:
    """Drop what other operators' tasks remember in this worker: theirs are over, or read it again."""
    held = [c for owner, caches in _CACHES.items() if owner != operator for c in caches if c.cache_info().currsize]
    for cache in held:
        cache.cache_clear()
    if held:
        give_back()


def give_back() -> None:
    """Return to the system what a batch has freed.

    A worker outlives its task, and an executor has several: what the allocators keep for
    themselves in each of them adds up, beside the JVM, to more than a small executor has.
    """
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
