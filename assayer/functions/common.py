"""Small helpers for column expressions and Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as the body likes, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task and would hold it through the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)
