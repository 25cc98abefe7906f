"""What a Python worker keeps between tasks.

Workers are used again by later stages. What one operator has learnt serves its
own next tasks; another operator's tasks let go of it, and every task hands the
memory that it no longer uses back to the system.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Modules and their cached functions of one result each.
HELD = {"token_store": "encoder", "token_counts": "transducer", "licenses": "standard"}


def let_go(owner: str) -> None:
    """Forget what operators other than ``owner`` keep in this process."""
    for name, kept in HELD.items():
        module = sys.modules.get(f"{__package__}.{name}")
        if module and name != owner and getattr(module, kept).cache_info().currsize:
            getattr(module, kept).cache_clear()
            gc.collect()


def give_back() -> None:
    """Hand freed memory to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable, owner: str) -> Callable:
    """``run``, a function of Arrow batches, with both at its ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
