"""What a Python worker process keeps between tasks: one thing at a time.

Workers outlive the step that started them. A vocabulary or table kept by one step would stay in memory through all
later ones, so whoever needs another thing drops it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa

_kept: dict[Hashable, object] = {}


def give_back() -> None:
    """Return freed memory to the system; else Arrow and the C library keep what earlier steps of a worker needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def only(key: Hashable, make: Callable[[], object]):
    """The kept thing of this key, made anew after anything else that was kept is dropped."""
    if key not in _kept:
        _kept.clear()
        give_back()
        _kept[key] = make()
    return _kept[key]
