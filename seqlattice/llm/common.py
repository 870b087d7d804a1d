"""Helpers shared by the training-data operators.

Every operator first calls :func:`pick`, which keeps exactly the columns it
works on, found by exact name (case-sensitive) so that further columns, even
ones that differ from a needed name by case only, are left out, and casts them.
"""

from __future__ import annotations

import ctypes
import functools
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WHITE = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast; a column that is missing becomes null."""
    small_batches(df.sparkSession)
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    out = []
    for name, kind in types.items():
        at = names.index(name) if name in names else next(
            (i for i, n in enumerate(names) if n.lower() == name.lower()), None)
        col = F.lit(None) if at is None else F.col(f"_{at}")
        out.append(col.cast(kind).alias(name))
    return plain.select(*out)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns called _0, _1, ..., so that no two names clash, and their names."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))]), df.columns


def byte_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each value, None for null."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in column:
        yield value.as_py()


Batches = Iterator[pa.RecordBatch]

#: Rows and bytes of an Arrow batch.  Texts, what is made of them and the output are in memory together.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Python stages get small batches, unless the session asks for still smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow whose worker, which waits for further tasks, gives its memory back when the task ends."""

    @functools.wraps(run)
    def inner(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return inner


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names in spark.checkpoint.dir.

    Only local mode, where all run in one process on one machine, has a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = f"file:///tmp/checkpoints/seqlattice-{os.getpid()}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def letting_go(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write, which no one reads again, are let go when it ends."""
    before = spark.conf.get(_LET_GO, None)
    spark.conf.set(_LET_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(_LET_GO, before) if before is not None else spark.conf.unset(_LET_GO)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    path = shared_dir(df.sparkSession)
    with letting_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of a few whole numbers each that may be sent to every executor.
FEW_ROWS = 2_000_000


def if_few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has at most FEW_ROWS rows; beyond that a join with it is a shuffle."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by key, so that joins on it needn't shuffle it again.

    Its name is in the session's catalogue until :func:`forget`."""
    spark = df.sparkSession
    name, n = f"b_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with letting_go(spark):
        df.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", shared_dir(spark)).saveAsTable(name)
    out = spark.table(name)
    out._bucketed_name = name
    return out


def forget(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._bucketed_name}")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
