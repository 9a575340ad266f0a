"""Memory of Python workers, which later tasks use again."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from glycoflow.llm import rolling


def _give_back() -> None:
    """What is free goes back to the system."""
    rolling.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _forget_encoders() -> None:
    tokens = sys.modules.get("glycoflow.llm.tokens")
    if tokens is not None:
        tokens.encoder.cache_clear()


def frugal(f: Callable[..., Iterator], encodes: bool = False) -> Callable[..., Iterator]:
    """``f``, a function of batches, whose worker keeps no memory after the task.

    The executor has to hold what its workers keep beside what the next stage needs. Only encoders last from task to
    task, until a worker gets one of another kind (``encodes`` is not set).
    """

    @wraps(f)
    def run(*args: object) -> Iterator:
        if not encodes:
            _forget_encoders()
        try:
            yield from f(*args)
        finally:
            _give_back()

    return run


def encoding(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    return frugal(f, encodes=True)
