"""Small Arrow batches for stages that take whole texts, whose workers give their memory back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes of a batch.  Texts, what is made of them and the output are in memory together.
ROWS, BYTES = 1000, 8 << 20


def small(spark: SparkSession) -> None:
    """Python stages get small batches, unless the session asks for still smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def let_go() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator[Any]], Iterator[Any]]) -> Callable[[Iterator[Any]], Iterator[Any]]:
    """A function of batches whose worker, which waits for further tasks, gives its memory back when the task ends."""

    @functools.wraps(run)
    def inner(batches: Iterator[Any]) -> Iterator[Any]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return inner
