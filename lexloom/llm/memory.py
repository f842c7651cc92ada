"""Giving memory back between tasks: Python workers live on, and what they keep counts against their executor."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa


def released() -> None:
    """Return freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
