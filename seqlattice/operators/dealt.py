"""All vectors dealt to each of a few tasks, which work on their share of trials, placements or rows.

Vectors go through one shuffle as blocks of bytes, in single precision where
that loses nothing, once for each task; what leaves a task are sums.  A task
holds one matrix of all vectors and unit vectors of a band of cells, so its
memory and the bytes moved grow with the items, not with items times trials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches
from .grid import OFFSETS
from .grid import side_of as side  # noqa: F401

ROWS, BAND = 4096, 4096
PACKED = "what string, ids binary, width int, data binary"


def _rows_of(column: pa.Array) -> np.ndarray:
    """The vectors of a list column; a null is a row of NaN."""
    real = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, int(real.sum()))
    out = np.full((len(column), width), np.nan)
    out[real] = flat.reshape(-1, width)
    return out


def _packs(batch: pa.RecordBatch, what: str) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        wide = _rows_of(part.column(1))
        with np.errstate(over="ignore"):
            short = wide.astype(np.float32)
        data = short if np.array_equal(short, wide, equal_nan=True) else wide
        ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([what]), pa.array([ids.tobytes()], pa.binary()), pa.array([wide.shape[1]], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["what", "ids", "width", "data"])


def packed(df: DataFrame, key: str = "id", value: str = "v", what: str = "v") -> DataFrame:
    """PACKED: blocks of df's whole numbers key and vectors value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _packs(batch, what)

    return df.select(F.col(key), F.col(value)).mapInArrow(run, PACKED)


def packed_ids(df: DataFrame, key: str = "id", what: str = "v") -> DataFrame:
    """PACKED: blocks of df's whole numbers key, without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([what]), pa.array([ids.tobytes()], pa.binary()), pa.array([0], pa.int32()), pa.array([b""], pa.binary())], ["what", "ids", "width", "data"])

    return df.select(F.col(key)).mapInArrow(run, PACKED)


def tasks_for(spark: SparkSession, units: int) -> int:
    return max(1, min(units, 2 * spark.sparkContext.defaultParallelism))


def grouped(df: DataFrame, groups: int, tasks: list[list[int]], what: str) -> DataFrame:
    """(task, *PACKED): blocks of df's vectors (id, v) by groups of ids, each block once for every task (a key) of its group; what gets the group's number behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(2).to_numpy(zero_copy_only=False)
            for group in np.unique(which):
                for part in _packs(batch.filter(pa.array(which == group)), f"{what}{group}"):
                    yield pa.RecordBatch.from_arrays([pa.array([tasks[group]], pa.list_(pa.int64())), *part.columns], ["tasks", *part.schema.names])

    keyed = df.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"))
    return keyed.mapInArrow(run, f"tasks array<long>, {PACKED}").select(F.explode("tasks").alias("task"), "what", "ids", "width", "data")


def task_keys(spark: SparkSession, tasks: int) -> list[int]:
    """Keys that hash to a partition each, so that no two tasks share one."""
    tried = spark.range(0, 64 * tasks, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("bin"))
    keys = [r.id for r in tried.groupBy("bin").agg(F.min("id").alias("id")).orderBy("id").collect()]
    return keys + [-1 - k for k in range(tasks - len(keys))]


class Rows:
    """What a task gets: blocks (PACKED), which go into a matrix for each what as they come, so that no batch is held beside it."""

    def __init__(self, batches: Iterable[pa.RecordBatch] = ()) -> None:
        self.held: dict[str, tuple[list[np.ndarray], np.ndarray, int]] = {}
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) for c in ("what", "ids", "width", "data")]
            for k in range(batch.num_rows):
                what, ids, width, data = (c[k] for c in columns)
                self._add(what.as_py(), np.frombuffer(ids.as_buffer(), np.int64).copy(), width.as_py(), data.as_buffer())
            del batch, columns

    def _add(self, what: str, ids: np.ndarray, width: int, raw: pa.Buffer) -> None:
        kind = np.float32 if raw.size == 4 * width * len(ids) else np.float64
        block = np.frombuffer(raw, kind).reshape(len(ids), width) if width else np.empty((len(ids), 0), np.float32)
        keys, held, n = self.held.get(what, ([], np.empty((0, width), block.dtype), 0))
        if (kind_of := np.result_type(held, block)) != held.dtype:
            held = held.astype(kind_of)
        if width > held.shape[1]:  # blocks that have no vector are without width
            held = np.full((n, width), np.nan, held.dtype)
        if n + len(ids) > len(held):  # the memory is moved, not copied, and stays within an eighth of what is needed
            held.resize((n + len(ids) + n // 8, held.shape[1]), refcheck=False)
        held[n : n + len(ids)] = block if width == held.shape[1] else np.nan
        keys.append(ids)
        self.held[what] = (keys, held, n + len(ids))

    def take(self, what: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values, as they came; given once."""
        keys, held, n = self.held.pop(what, ([], np.empty((0, 0), np.float32), 0))
        return np.concatenate(keys) if keys else np.empty(0, np.int64), held[:n]


def in_tasks(sent: DataFrame, keys: list[int], run: Callable[[int, Rows], Iterable[pa.Table] | pa.Table], schema: str) -> DataFrame:
    """run(number, rows) for each task with the rows (task, *PACKED) that have its key."""
    batches.small(sent.sparkSession)
    number = {k: n for n, k in enumerate(keys)}

    def inner(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            rows = Rows(parts)
            batches.let_go()
            out = run(number[key[0].as_py()], rows)
            for table in [out] if isinstance(out, pa.Table) else out:
                yield from table.to_batches()
        finally:  # the worker waits for further tasks
            batches.let_go()

    return sent.repartition(len(keys), "task").groupBy("task").applyInArrow(inner, schema)


def by_task(parts: DataFrame, tasks: int, run: Callable[[int, Rows], Iterable[pa.Table] | pa.Table], schema: str, own: DataFrame | None = None) -> DataFrame:
    """run(number, rows) for each task with all rows of parts (PACKED), and with those of own (number, *PACKED) that are for it."""
    keys = task_keys(parts.sparkSession, tasks)
    sent = parts.select(F.explode(F.array(*(F.lit(k).cast("long") for k in keys))).alias("task"), "*")
    if own is not None:
        at = F.element_at(F.array(*(F.lit(k).cast("long") for k in keys)), F.col("number") + 1)
        sent = sent.unionByName(own.select(at.alias("task"), "what", "ids", "width", "data"))
    return in_tasks(sent, keys, run, schema)


def taken(rows: Rows | pa.Table, what: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """(keys, values) of all blocks."""
    return (Rows(rows.to_batches()) if isinstance(rows, pa.Table) else rows).take(what)


class Vectors:
    """All vectors in the order of their keys.  Behind the last one is a row of zeros, which the place -1 of an empty cell means."""

    def __init__(self, rows: Rows | pa.Table, what: str = "v") -> None:
        keys, self._raw = taken(rows, what)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        #: Places' rows in the order in which blocks came.
        self._at = np.append(order, -1).astype(np.int32 if len(keys) < 1 << 31 else np.int64)
        self.known, self.scale = np.zeros(len(keys) + 1, bool), np.zeros(len(keys) + 1)
        for at in range(0, len(keys), ROWS):
            part = self._raw[at : at + ROWS]
            bad = np.isnan(part).any(axis=1)
            part[bad] = 0
            self.known[at : at + len(part)] = ~bad
            length = np.sqrt(np.einsum("ij,ij->i", part, part, dtype=np.float64))
            self.scale[at : at + len(part)] = np.divide(1, length, out=np.zeros(len(part)), where=length > 0)
        self.known, self.scale = self.known[self._at], self.scale[self._at]

    def __len__(self) -> int:
        return len(self.keys)

    def plain(self, places: np.ndarray) -> np.ndarray:
        """Vectors as they are; those of empty cells and null ones are zeros."""
        if not len(self.keys):
            return np.zeros((len(places), self._raw.shape[1]))
        out = self._raw[self._at[places]].astype(np.float64)
        out[~self.known[places]] = 0
        return out

    def unit(self, places: np.ndarray) -> np.ndarray:
        out = self.plain(places)
        out *= self.scale[places, None]
        return out

    def along(self, order: np.ndarray) -> np.ndarray:
        """Similarities of neighbours in an order; NaN where a vector is null."""
        out = np.empty(max(0, len(order) - 1))
        for at in range(0, len(out), BAND):
            x = self.unit(order[at : at + BAND + 1])
            out[at : at + BAND] = np.einsum("ij,ij->i", x[:-1], x[1:])
        if not self.known[order].all():
            out[~(self.known[order[:-1]] & self.known[order[1:]])] = np.nan
        return out


def digest_order(names: list[bytes], prefix: bytes) -> np.ndarray:
    """The places of names in the order of the MD5 of prefix and name."""
    md5 = hashlib.md5
    d = np.empty((len(names), 2), np.uint64)
    for at in range(0, len(names), ROWS):
        d[at : at + ROWS] = np.frombuffer(b"".join([md5(prefix + x, usedforsecurity=False).digest() for x in names[at : at + ROWS]]), ">u8").reshape(-1, 2)
    order = np.argsort(d[:, 0], kind="stable")
    first = d[order, 0]
    return np.lexsort((d[:, 1], d[:, 0])) if (first[1:] == first[:-1]).any() else order


def names_of(keys: np.ndarray) -> list[bytes]:
    return [b"%d" % k for k in keys.tolist()]


def ordinals(n: int) -> dict[str, np.ndarray]:
    """The layouts of grid.ORDINALS over the cells of a grid of side n, row by row."""
    r, c = np.divmod(np.arange(n * n, dtype=np.int64), n) if n else (np.empty(0, np.int64),) * 2

    def diagonal(t: np.ndarray) -> np.ndarray:
        begin = np.where(t < n, t * (t + 1) // 2, n * n - (2 * n - 1 - t) * (2 * n - t) // 2)
        return begin + np.where(t % 2 == 0, r - np.maximum(0, t - n + 1), np.minimum(t, n - 1) - r)

    ring = np.minimum(np.minimum(r, c), np.minimum(n - 1 - r, n - 1 - c))
    last = n - 1 - ring
    turn = np.select([r == ring, c == last, r == last], [c - ring, last - ring + r - ring, 2 * (last - ring) + last - c], 3 * (last - ring) + last - r)
    return {
        "row_major": r * n + c, "row_serpentine": r * n + np.where(r % 2 == 0, c, n - 1 - c),
        "column_major": c * n + r, "column_serpentine": c * n + np.where(c % 2 == 0, r, n - 1 - r),
        "diagonal_nw_se": diagonal(r + c), "diagonal_ne_sw": diagonal(r + n - 1 - c), "spiral": 4 * ring * (n - ring) + turn}


def placed(order: np.ndarray, layout: np.ndarray) -> np.ndarray:
    """What is in each cell of a layout (ordinals by cell): the order's places, -1 for none."""
    full = np.full(len(layout), -1, np.int64)
    full[: len(order)] = order
    return full[layout]


def edges_at(spots: np.ndarray, n: int, offset: int, begin: int = 0, most: int | None = None) -> tuple[int, np.ndarray]:
    """(step, first cells) of neighbouring cells an offset apart that are both filled, for so many first cells from one on."""
    dr, dc = OFFSETS[offset]
    step = dr * n + dc
    stop = max(begin, n * n - step)
    stop = stop if most is None else min(stop, begin + most)
    col = np.arange(begin, stop) % max(n, 1)
    return step, begin + np.flatnonzero((col + dc >= 0) & (col + dc < n) & (spots[begin:stop] >= 0) & (spots[begin + step : stop + step] >= 0))


def _products(vectors: Vectors, spots: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(offset's number, what is in the first of neighbouring cells that are both filled, and in the second, similarities for each (spots of the first, spots of the second)), by bands of cells."""
    size = n * n
    different = {id(s): s for pair in sides for s in pair}
    for at in range(0, size, BAND):
        x = {k: vectors.unit(s[at : at + BAND + n + 1]) for k, s in different.items()}
        for k in range(len(OFFSETS)):
            step, cells = edges_at(spots, n, k, at, BAND)
            m, here = min(BAND, size - step - at), cells - at
            if len(cells):
                yield k, spots[cells], spots[cells + step], [np.einsum("ij,ij->i", x[id(a)][:m], x[id(b)][step : step + m])[here] for a, b in sides]


def grid_means(vectors: Vectors, spots: np.ndarray, n: int) -> dict[int, float]:
    """kind -> mean similarity of neighbouring cells; kinds without neighbours are left out."""
    total, count = {4: 0.0, 8: 0.0}, {4: 0, 8: 0}
    for k, u, v, (values,) in _products(vectors, spots, [(spots, spots)], n):
        known = vectors.known[u] & vectors.known[v]
        for kind in ((4, 8) if k < 2 else (8,)):
            total[kind] += values[known].sum()
            count[kind] += int(known.sum())
    return {kind: total[kind] / count[kind] for kind in total if count[kind]}


def omission_means(vectors: Vectors, spots: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, means for each place of the sequence left out), for cells that hold ordinals of the places kept.

    Running sums over the ends of three ranges of places (see overlaps.omission_overlaps).
    """
    size, later = len(vectors), np.where(spots >= 0, spots + 1, -1)
    steps, count = np.zeros((2, size + 1)), [0, 0]
    for k, u, v, (same, moved, less, more) in _products(vectors, spots, [(spots, spots), (later, later), (spots, later), (later, spots)], n):
        add, apart = steps[int(k >= 2)], np.where(u < v, less, more)
        np.add.at(add, np.minimum(u, v) + 1, apart - moved)
        np.add.at(add, np.maximum(u, v) + 1, same - apart)
        add[0] += moved.sum()
        count[int(k >= 2)] += len(u)
    for kind, n_edges in ((4, count[0]), (8, sum(count))):
        if kind == 8:
            steps[0] += steps[1]
        if n_edges:
            yield kind, np.cumsum(steps[0, :size]) / n_edges
