"""What a Python worker keeps from one task to the next: one thing at a time.

Codecs and lexicons are costly to make, and workers serve many tasks; but a
worker also serves other operators afterwards, and then it should not hold
what they don't use.  Memory that a task let go would stay with the worker too:
the allocators give it back only when asked.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, object] = {}


@functools.cache
def _trim() -> Callable[[int], int]:
    """malloc_trim, where the C library has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Memory that isn't in use returns to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def kept(name: str, make: Callable[[], object]):
    """The object of this name, made if the worker doesn't hold it; any other one is let go first."""
    if name not in _held:
        _held.clear()
        give_back()
        _held[name] = make()
    return _held[name]


def lean(run: Callable, rows: int | None = None) -> Callable:
    """A function of batches that gives its memory back when a task ends; with ``rows``, it gets at most that many rows at a time."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches if rows is None else (b.slice(k, rows) for b in batches for k in range(0, b.num_rows, rows)))
        finally:
            give_back()

    return task
