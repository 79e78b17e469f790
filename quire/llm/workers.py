"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def release() -> None:
    """Freed memory that Arrow and the C library hold goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def releasing(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, which releases at its end: a worker waits for its next task, beside others at work, with little in hand."""

    @functools.wraps(run)
    def released(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            release()

    return released
