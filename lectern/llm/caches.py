"""One cache per worker at a time.

Python workers outlive a stage, and the operators keep what they know of words in module
tables. An operator that begins to fill its table empties those of the others, so that a
pipeline of several operators holds no more than the largest of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_holder: list[tuple[str, Callable[[], None]]] = []


def claim(name: str, clear: Callable[[], None]) -> None:
    """Makes ``name`` the worker's only cache; ``clear`` empties it when another is claimed."""
    if _holder and _holder[0][0] == name:
        return
    if _holder:
        _holder.pop()[1]()
        _given_back()
    _holder.append((name, clear))


def _given_back() -> None:
    """Hands freed memory back to the system, which the allocators would keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library
