"""Python workers outlive a task: what operators leave in them is cleared and given back."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_owner: tuple[str, Callable[[], None]] | None = None


def nothing() -> None:
    """Of an operator that remembers nothing between tasks."""


def give_back() -> None:
    """Return free memory of this process to the machine; else an idle worker holds what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def claim(name: str, clear: Callable[[], None]) -> None:
    """Say that operator ``name`` uses this worker's cache from now on; another one's is cleared."""
    global _owner
    if _owner and _owner[0] != name:
        _owner[1]()
        gc.collect()
        give_back()
    if not _owner or _owner[0] != name:
        _owner = (name, clear)


def worker(name: str, clear: Callable[[], None] = nothing) -> Callable:
    """For functions over batches of a task: the worker belongs to operator ``name`` meanwhile, and gives back its memory at the end."""

    def wrap(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
        @functools.wraps(run)
        def held(batches: Iterator) -> Iterator:
            claim(name, clear)
            try:
                yield from run(batches)
            finally:
                give_back()

        return held

    return wrap
