"""Vectors of texts: a provider that is called batch by batch, and a cache keyed by content."""

from __future__ import annotations

import hashlib
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[list[float]]]


def local_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """Deterministic unit vectors without a network: signed counts of hashed words."""
    out = np.zeros((len(texts), size))
    for k, text in enumerate(texts):
        for word in text.split():
            h = hashlib.blake2b(word.encode(), digest_size=8).digest()
            out[k, h[0] % size] += 1 if h[1] & 1 else -1
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0).tolist()


def http_vectors(url: str, model: str, key: str = "", timeout: float = 120, attempts: int = 3) -> Provider:
    """A provider that posts texts to a service and takes the vectors in the order of their index.  Errors of the service's side and time-outs are tried again."""

    def ask(texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
        request = urllib.request.Request(url, json.dumps({"model": model, "input": texts}).encode(), headers, method="POST")
        for left in range(attempts - 1, -1, -1):
            try:
                with urllib.request.urlopen(request, timeout=timeout) as response:
                    data = json.load(response).get("data", [])
                break
            except urllib.error.HTTPError as e:
                if e.code < 500 or not left:
                    raise RuntimeError(f"{url}: {e.code} {e.read().decode(errors='replace')[:2000]}") from e
            except OSError:
                if not left:
                    raise
        if sorted(item["index"] for item in data) != list(range(len(texts))):
            raise ValueError(f"{url}: {len(data)} vectors for {len(texts)} texts")
        return [item["embedding"] for item in sorted(data, key=lambda item: item["index"])]

    return ask


def embedded(records: DataFrame, provider: Provider = local_vectors, batch_size: int = 100) -> DataFrame:
    """records (id, text) with sha and embedding, asked for in batches; a task that runs again asks for the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                ids, texts = (c.to_pylist() for c in batch.slice(at, batch_size).columns)
                texts = [t or "" for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]), pa.array(provider(texts), pa.list_(pa.float64()))], ["id", "sha", "embedding"])

    return records.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, sha string, embedding array<double>")


def cache_status(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """id, status: fresh, stale, absent from the cache, or surplus in it, for (id, sha) on both sides."""
    both = wanted.select("id", F.col("sha").alias("w")).join(held.select("id", F.col("sha").alias("h")), "id", "full")
    return both.select("id", F.when(F.col("h").isNull(), "absent").when(F.col("w").isNull(), "surplus").when(F.col("w") != F.col("h"), "stale").otherwise("fresh").alias("status"))


def matches(wanted: DataFrame, held: DataFrame) -> bool:
    """Whether a cache as a whole fits: the same ids with the same digests."""
    return cache_status(wanted, held).where("status <> 'fresh'").limit(1).count() == 0


def refreshed(wanted: DataFrame, held: DataFrame, provider: Provider = local_vectors, batch_size: int = 100) -> DataFrame:
    """The vectors of wanted (id, text): what fits from held (id, sha, embedding), the rest from the provider."""
    keyed = wanted.select(F.col("id").cast("string").alias("id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    kept = held.join(keyed.select("id", "sha"), ["id", "sha"], "left_semi").select("id", "sha", "embedding")
    return kept.unionByName(embedded(keyed.join(held.select("id", "sha"), ["id", "sha"], "left_anti"), provider, batch_size))
