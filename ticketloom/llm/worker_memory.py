"""What a Python worker keeps from one task to the next: the things of one operator at a time.

Spark hands a worker's process to task after task, of whatever operator. An encoder that remembers its
words is worth keeping between tasks of its own job, but would take the memory of the jobs after it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_KEPT: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """The thing under `key`, made at its first use; what stood under other keys is let go before."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Forget what is kept and give its memory back to the system, where the C library can."""
    if not _KEPT:
        return
    _KEPT.clear()
    give_back()


def give_back() -> None:
    """Free memory goes back to the system, where the C library can; else a worker holds its largest group's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def freed(run: Callable, *groups):
    """What `run` makes of one group, with the memory it took for that given back before the next."""
    made = run(*groups)
    give_back()
    return made
