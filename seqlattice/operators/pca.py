"""Principal components of vectors: partial sums of products by task, an exact eigen-decomposition of the small matrix, projection by task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _rows(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.array(batch.column(k).to_pylist(), np.float64).reshape(len(batch), -1)


def components(vectors: DataFrame, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings (k x dimensions, the largest entry of each positive) and explained shares of vectors (v).

    Only sums come to the driver, dimensions squared in size, one for each task; they are added up in one further task first.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = _rows(batch, 0)
                n, total, products = n + len(x), total + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()]), pa.array([products.tobytes()])], ["n", "s", "p"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, 0.0, 0.0
        for batch in batches:
            for m, s, p in zip(*(c.to_pylist() for c in batch.columns)):
                n, total, products = n + m, total + np.frombuffer(s), products + np.frombuffer(p)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()]), pa.array([products.tobytes()])], ["n", "s", "p"])

    schema = "n long, s binary, p binary"
    rows = vectors.select("v").mapInArrow(partial, schema).repartition(1).mapInArrow(merged, schema).collect()
    if not rows:
        return np.zeros(0), np.zeros((k, 0)), np.zeros(k)
    n, mean = rows[0].n, np.frombuffer(rows[0].s) / rows[0].n
    scatter = np.frombuffer(rows[0].p).reshape(len(mean), -1) - n * np.outer(mean, mean)
    values, loadings = np.linalg.eigh(scatter)
    values, loadings = np.maximum(values[::-1][:k], 0), loadings.T[::-1][:k]
    signs = np.sign(loadings[np.arange(len(loadings)), np.abs(loadings).argmax(axis=1)])
    whole = np.trace(scatter)
    return mean, loadings * signs[:, None], values / whole if whole > 0 else np.zeros(k)


def projected(vectors: DataFrame, mean: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """id, x, y for vectors (id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                xy = (_rows(batch, 1) - mean) @ loadings[:2].T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["id", "x", "y"])

    return vectors.select("id", "v").mapInArrow(run, "id long, x double, y double")
