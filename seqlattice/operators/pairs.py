"""Pairs of items: neighbours in a sequence, rankings of all pairs, nearest items."""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from . import dealt

BLOCK = 2048
#: Components of a group of vectors at most, and rows and columns that are multiplied at once.
GROUP, LEFT, RIGHT = 65_536 * 64, 512, 2048


def side(df: DataFrame, suffix: str, *columns: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{suffix}") for c in columns))


def at_lag(seq: DataFrame, lag: int, *columns: str) -> DataFrame:
    """Items lag places apart: columns with _l and _r; an equi-join on place, so no task holds the sequence."""
    return side(seq, "l", "pos", *columns).withColumn("_at", F.col("pos_l") + lag).join(side(seq, "r", "pos", *columns).withColumnRenamed("pos_r", "_at"), "_at").drop("_at")


def adjacent(seq: DataFrame, *columns: str) -> DataFrame:
    pairs = at_lag(seq, 1, "id", "v", *columns)
    return pairs.withColumn("cosine", cosine(F.col("v_l"), F.col("v_r"))).drop("v_l", "v_r")


def mirrored(seq: DataFrame) -> DataFrame:
    """First with last, second with last but one, ...; a middle item has no partner."""
    n = seq.agg(F.count(F.lit(1)).alias("n"))
    left = side(seq, "l", "pos", "id", "v").join(F.broadcast(n)).where("pos_l < floor(n / 2)").withColumn("pos_r", F.col("n") - 1 - F.col("pos_l"))
    return left.join(side(seq, "r", "pos", "id", "v"), "pos_r").select("id_l", "id_r", cosine(F.col("v_l"), F.col("v_r")).alias("cosine"))


def _blocks(vectors: DataFrame) -> DataFrame:
    """(block, ids, data): unit vectors in blocks of about BLOCK rows."""
    n = vectors.count()
    blocks = max(1, -(-n // BLOCK))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("id")  # a block that is made twice, as fetches of a shuffle come in any order, is the same twice
        v = np.array(t.column("v").to_pylist(), np.float64).reshape(len(t), -1)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), "data": pa.array([v.tobytes()], pa.binary())})

    keyed = vectors.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")
    return keyed.groupBy("block").applyInArrow(pack, "block int, ids array<long>, data binary")


class _Group:
    """A group's unit vectors in the order of their ids, in double and in single precision; what is null is left out."""

    def __init__(self, rows: dealt.Rows | pa.Table, what: str, sign: int = 1) -> None:
        held = dealt.Vectors(rows, what)
        known = np.flatnonzero(held.known[:-1])
        self.ids, self.unit = held.keys[known], sign * held.unit(known)
        self.short = self.unit.astype(np.float32)
        #: What a product in single precision, and rounding to six digits, may be off.
        self.slack = 5e-7 + (self.unit.shape[1] + 8) * 2.0**-23

    def __len__(self) -> int:
        return len(self.ids)

    def times(self, sign: int) -> "_Group":
        out = copy(self)
        out.unit, out.short = sign * self.unit, sign * self.short
        return out


def _size(vectors: DataFrame) -> tuple[int, int]:
    """Rows, and groups that they take at least."""
    n, width = vectors.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    return n, max(1, -(-n * max(1, width or 0) // GROUP))


def _chosen(left: _Group, i: np.ndarray, right: _Group, at: int, s: np.ndarray, near: np.ndarray, better) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded similarity) of the near products that are better(similarities, rows) in double precision.  s are those of rows i and the columns from at on."""
    m = s.shape[1]
    if len(near) > s.size // 16:  # copies, or nothing found yet: all are multiplied again
        t = np.round(left.unit[i] @ right.unit[at : at + m].T, 6)
        r, c = np.divmod(np.flatnonzero(better(t, np.arange(len(i))[:, None])), m)
        return r, c, t[r, c]
    r, c = np.divmod(near, m)
    t = np.round(np.einsum("ij,ij->i", left.unit[i[r]], right.unit[at + c]), 6)
    keep = better(t, r)
    return r[keep], c[keep], t[keep]


def _extremes(left: _Group, right: _Group, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest (id_l < id_r, similarity) between two groups, or in one; by rounded similarity, then ids."""
    a, b, v = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    for i in range(0, len(left), LEFT):
        rows = np.arange(i, min(i + LEFT, len(left)))
        for j in range(i // RIGHT * RIGHT if same else 0, len(right), RIGHT):
            least, last = (v[-1], (a[-1], b[-1])) if len(v) == k else (-np.inf, (0, 0))
            if least >= 1 and min(left.ids[i], right.ids[j]) > last[0]:
                continue  # nothing is larger, and ties go to smaller ids
            columns = right.ids[j : j + RIGHT]
            s = left.short[rows] @ right.short[j : j + RIGHT].T
            tied = (left.ids[rows] <= last[0])[:, None] | (columns <= last[0])[None, :]
            better = lambda t, r: (t > least) | (t == least) & tied if t.ndim == 2 else t >= least  # noqa: E731, B023
            r, c, t = _chosen(left, rows, right, j, s, np.flatnonzero(s >= least - left.slack), better)
            x, y = left.ids[rows[r]], columns[c]
            real = (x != y) & (rows[r] < j + c) if same else x != y
            x, y, t = np.minimum(x, y)[real], np.maximum(x, y)[real], t[real]
            if len(t) > 8 * k:
                some = t >= np.partition(t, len(t) - k)[len(t) - k]
                x, y, t = x[some], y[some], t[some]
            a, b, v = np.concatenate([a, x]), np.concatenate([b, y]), np.concatenate([v, t])
            best = np.lexsort((b, a, -v))[:k]
            a, b, v = a[best], b[best], v[best]
    return a, b, v


def extreme_pairs(vectors: DataFrame, k: int, largest: bool) -> DataFrame:
    """The k most (or least) similar pairs (id_l < id_r): groups of vectors are multiplied, a pair of groups in a task, which gives its k best only.

    Single precision finds what may be among the k best so far; it is multiplied
    again in double.  Candidates are chosen by rounded similarity, then ids, as the
    final order is.
    """
    spark, (n, least) = vectors.sparkSession, _size(vectors)
    groups = least
    while groups * (groups + 1) // 2 < 2 * spark.sparkContext.defaultParallelism and groups < n // RIGHT:
        groups += 1
    tiles = [(g, h) for g in range(groups) for h in range(g, groups)]
    keys = dealt.task_keys(spark, len(tiles))
    tasks = [[key for key, tile in zip(keys, tiles) if g in tile] for g in range(groups)]
    sign = 1 if largest else -1

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        g, h = tiles[number]
        right = _Group(rows, f"v{h}")
        a, b, v = _extremes(right.times(sign) if g == h else _Group(rows, f"v{g}", sign), right, g == h, k)
        return pa.table({"id_l": a, "id_r": b, "cosine": sign * v})

    found = dealt.in_tasks(dealt.grouped(vectors, groups, tasks, "v"), keys, run, "id_l long, id_r long, cosine double")
    return found.orderBy(F.desc("cosine") if largest else F.asc("cosine"), "id_l", "id_r").limit(k)


def _nearest(left: _Group, right: _Group, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(similarities, others), len(left) x k: the best of a group for each item, never itself; -inf where there are fewer.

    Columns come by their ids, so that among equals those found first stay.
    """
    values, others = np.full((len(left), k), -np.inf), np.zeros((len(left), k), np.int64)
    starts = [0, *range(LEFT // 2, len(right), RIGHT)]
    for i in range(0, len(left), LEFT):
        for j, end in zip(starts, [*starts[1:], len(right)]):
            rows = i + np.flatnonzero(values[i : i + LEFT, -1] < 1)  # nothing is above 1
            if not len(rows):
                break
            least, columns = values[rows, -1], right.ids[j:end]
            s = left.short[rows] @ right.short[j:end].T
            near = np.flatnonzero(s >= (least - left.slack).astype(np.float32)[:, None])
            r, c, t = _chosen(left, rows, right, j, s, near, lambda t, r: t > least[r])  # noqa: B023
            real = left.ids[rows[r]] != columns[c]
            if not real.any():
                continue
            r, c, t = r[real], c[real], t[real]
            met, number = np.unique(r, return_inverse=True)
            of = np.concatenate([np.repeat(np.arange(len(met)), k), number])
            v, o = np.concatenate([values[rows[met]].ravel(), t]), np.concatenate([others[rows[met]].ravel(), columns[c]])
            order = np.lexsort((o, -v, of))
            best = order[np.searchsorted(of[order], np.arange(len(met)))[:, None] + np.arange(k)]
            values[rows[met]], others[rows[met]] = v[best], o[best]
    return values, others


def nearest(targets: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(id, other, cosine, rank): for each target its k most similar other items, never itself; a group of targets and one of others are multiplied in a task."""
    spark, (n, gl), (m, gr) = targets.sparkSession, _size(targets), _size(others)
    want = 2 * spark.sparkContext.defaultParallelism
    gl = max(gl, min(-(-want // gr), n // LEFT))
    gr = max(gr, min(-(-want // gl), m // RIGHT))
    keys = dealt.task_keys(spark, gl * gr)

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        left = _Group(rows, f"l{number // gr}")
        values, found = _nearest(left, _Group(rows, f"r{number % gr}"), k)
        real = values.ravel() > -np.inf
        return pa.table({"id": np.repeat(left.ids, k)[real], "other": found.ravel()[real], "cosine": values.ravel()[real]})

    sent = dealt.grouped(targets, gl, [keys[g * gr : (g + 1) * gr] for g in range(gl)], "l")
    sent = sent.unionByName(dealt.grouped(others, gr, [keys[h::gr] for h in range(gr)], "r"))
    found = dealt.in_tasks(sent, keys, run, "id long, other long, cosine double")
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def correlation(vectors: DataFrame) -> DataFrame:
    """n_pairs, pearson of the similarities of all pairs by v and by w, for (id, v, w); block pairs give sums only."""
    left = _blocks(vectors.select("id", "v"))
    both = left.join(_blocks(vectors.select("id", F.col("w").alias("v"))).select("block", F.col("data").alias("other")), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for il, a, b, ir, c, d in zip(*(x.to_pylist() for x in batch.columns)):
                x, y = (np.frombuffer(p).reshape(len(il), -1) @ np.frombuffer(q).reshape(len(ir), -1).T for p, q in ((a, c), (b, d)))
                once = np.array(il)[:, None] < np.array(ir)[None, :] if il == ir else np.ones((len(il), len(ir)), bool)
                x, y = x[once], y[once]
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (len(x), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum())], ["n", "x", "y", "xx", "yy", "xy"])

    pairs = both.toDF("bl", "il", "al", "dl").join(both.toDF("br", "ir", "ar", "dr"), F.expr("bl <= br")).select("il", "al", "dl", "ir", "ar", "dr")
    sums = pairs.mapInArrow(run, "n long, x double, y double, xx double, yy double, xy double").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    top = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    below = F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    return sums.select(F.col("n").alias("n_pairs"), (top / F.nullif(below, F.lit(0.0))).alias("pearson"))


def label_gap(vectors: DataFrame) -> DataFrame:
    """Mean similarity of pairs within and across labels, by sums of unit vectors instead of pairs."""
    from ..functions.vectors import dot, unit

    u = vectors.select("label", unit(F.col("v")).alias("u")).select("label", "u", dot(F.col("u"), F.col("u")).alias("own"))
    parts = u.select("label", "own", F.posexplode("u").alias("k", "x"))
    sums = parts.groupBy("label", "k").agg(F.sum("x").alias("s"))
    sizes = u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("own"))
    inside = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss")).join(sizes, "label")
    inside = inside.agg(F.sum((F.col("ss") - F.col("own")) / 2).alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("nw"), F.sum("own").alias("own"), F.sum("n").alias("n"))
    whole = sums.groupBy("k").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"))
    both = inside.join(F.broadcast(whole))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    out = both.select((F.col("w") / F.col("nw")).alias("within"), (((F.col("ss") - F.col("own")) / 2 - F.col("w")) / (pairs - F.col("nw"))).alias("across"))
    return out.select(F.round("within", 6).alias("within_mean"), F.round("across", 6).alias("across_mean"), F.round(F.col("within") - F.col("across"), 6).alias("gap"))


def rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(c, digits)
