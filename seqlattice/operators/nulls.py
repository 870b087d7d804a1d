"""Null models: random orders of the same items.

The relational null ranks items by a digest of trial and id; it is the same in
any engine and needs no shared state.  The kernel null reproduces a seeded
generator's shuffles, each trial shuffling the list that the one before left.
Both work on vectors that are dealt to tasks (see dealt), whatever their number.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dealt


def trials_of(spark: SparkSession, trials: int) -> DataFrame:
    return spark.range(trials).withColumnRenamed("id", "trial")


def random_orders(ids: DataFrame, trials: int) -> DataFrame:
    """(trial, pos, id): ids in random order, for each trial; trials are spread over tasks."""
    spark = ids.sparkSession
    key = F.md5(F.concat(F.col("trial").cast("string"), F.lit(":"), F.col("id").cast("string")))
    every = ids.select("id").join(F.broadcast(trials_of(spark, trials)))
    return every.select("trial", "id", (F.row_number().over(Window.partitionBy("trial").orderBy(key)) - 1).cast("long").alias("pos"))


def random_neighbours(ids: DataFrame, trials: int) -> DataFrame:
    """(trial, pos, id_l, id_r): items next to each other in random orders."""
    spark = ids.sparkSession
    key = F.md5(F.concat(F.col("trial").cast("string"), F.lit(":"), F.col("id").cast("string")))
    by = Window.partitionBy("trial").orderBy(key)
    every = ids.select("id").join(F.broadcast(trials_of(spark, trials)))
    out = every.select("trial", (F.row_number().over(by) - 1).cast("long").alias("pos"), F.col("id").alias("id_l"), F.lead("id").over(by).alias("id_r"))
    return out.where("id_r is not null")


def seeded_orders(size: int, trials: int, seed: int, cumulative: bool = True) -> np.ndarray:
    """trials x size: each a shuffle of the order before it, or of the first one."""
    rng, order, out = random.Random(seed), list(range(size)), np.empty((trials, size), np.int32)
    for t in range(trials):
        if not cumulative:
            order = list(range(size))
        rng.shuffle(order)
        out[t] = order
    return out


def _runs(size: int) -> Iterator[tuple[int, range]]:
    """Bits to draw for the places size - 1 down to 1, as random.shuffle does: as many as place + 1 has."""
    i = size - 1
    while i > 0:
        bits = (i + 1).bit_length()
        least = max(1, (1 << (bits - 1)) - 1)
        yield bits, range(i, least - 1, -1)
        i = least - 1


def shuffled(order: list[int], rng: random.Random) -> None:
    """What random.shuffle does, in less time."""
    draw = rng.getrandbits
    for bits, places in _runs(len(order)):
        for i in places:
            j = draw(bits)
            while j > i:
                j = draw(bits)
            order[i], order[j] = order[j], order[i]


def passed(size: int, rng: random.Random) -> None:
    """Leaves the generator as the shuffle of a list of this size does."""
    draw = rng.getrandbits
    for bits, places in _runs(size):
        for i in places:
            while draw(bits) > i:
                pass


def generator(state: list[int]) -> random.Random:
    rng = random.Random()
    rng.setstate((3, tuple(state), None))
    return rng


class SeededOrders:
    """The orders of seeded_orders (each a shuffle of the one before), made in tasks: a part of the trials begins at an order and a state of the generator."""

    #: Up to this size the driver shuffles by itself; beyond, it only counts the generator on, and tasks shuffle.
    SMALL = 20_000

    def __init__(self, size: int, trials: int, seed: int) -> None:
        self.size, self.trials, self.seed = size, trials, seed

    def __len__(self) -> int:
        return self.trials

    def share(self, part: int, parts: int) -> int:
        return (self.trials * (part + 1)) // parts - (self.trials * part) // parts

    def starts(self, spark: SparkSession, parts: int) -> DataFrame:
        """(number, *PACKED): each part's first state and the order before it."""
        size, states, orders, order = self.size, [], [], list(range(self.size))
        rng, small = random.Random(self.seed), self.size <= self.SMALL
        for part in range(parts):
            states.append(list(rng.getstate()[1]))
            if small:
                orders.append(np.array(order, np.int64))
            for _ in range(self.share(part, parts) if part < parts - 1 else 0):
                shuffled(order, rng) if small else passed(size, rng)
        if not small:
            share = [self.share(part, parts) for part in range(parts)]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for part in batch.column(0).to_pylist():
                        order, mine = list(range(size)), generator(states[part])
                        for _ in range(share[part]):
                            shuffled(order, mine)
                        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([np.array(order, np.int32).tobytes()], pa.binary())], ["part", "moved"])

            moved = {r.part: np.frombuffer(r.moved, np.int32) for r in spark.range(0, parts - 1, 1, max(1, parts - 1)).mapInArrow(run, "part long, moved binary").toLocalIterator()}
            order = np.arange(size, dtype=np.int32)
            for part in range(parts):
                orders.append(order.astype(np.int64))
                order = order[moved[part]] if part in moved else order
        rows = [(part, what, bytearray(np.array(x, np.int64).tobytes()), 0, bytearray()) for part in range(parts) for what, x in (("state", states[part]), ("start", orders[part]))]
        return spark.createDataFrame(rows, f"number int, {dealt.PACKED}").repartition(parts, "number")

    def of(self, part: int, parts: int, rows: dealt.Rows | pa.Table) -> Iterator[np.ndarray]:
        """The orders of a part, in a task that has its row of starts."""
        state, start = (dealt.taken(rows, what)[0].tolist() for what in ("state", "start"))
        rng = generator(state)
        for _ in range(self.share(part, parts)):
            shuffled(start, rng)
            yield np.array(start, np.int64)


class DigestOrders:
    """The orders of random_orders of range(size)."""

    def __init__(self, size: int, trials: int) -> None:
        self.size, self.trials = size, trials

    def __len__(self) -> int:
        return self.trials

    def starts(self, spark: SparkSession, parts: int) -> None:
        return None

    def of(self, part: int, parts: int, rows: dealt.Rows | pa.Table) -> Iterator[np.ndarray]:
        names = dealt.names_of(np.arange(self.size))
        for trial in range(part, self.trials, parts):
            yield dealt.digest_order(names, b"%d:" % trial)


def kernel_null(kinds: tuple[int, ...], seq: DataFrame, orders: SeededOrders) -> DataFrame:
    """(kind, mean), a row for each order that assigns the items of a sequence (pos, v) to the cells of a grid."""
    tasks = dealt.tasks_for(seq.sparkSession, len(orders))

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        vectors = dealt.Vectors(rows)
        n = dealt.side(len(vectors))
        found = [(k, m) for order in orders.of(number, tasks, rows) for k, m in dealt.grid_means(vectors, dealt.placed(order, np.arange(n * n)), n).items() if k in kinds]
        return pa.table({"kind": pa.array([k for k, _ in found], pa.int32()), "mean": pa.array([m for _, m in found], pa.float64())})

    return dealt.by_task(dealt.packed(seq, "pos"), tasks, run, "kind int, mean double", orders.starts(seq.sparkSession, tasks))


def placement_null(items: DataFrame, without: dict[int, list[int]], trials: int) -> DataFrame:
    """(group, kind, trial, mean) for random placements of the items (id, v) without those that a group lacks."""
    units = [(g, t) for t in range(trials) for g in without]
    tasks = dealt.tasks_for(items.sparkSession, len(units))

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        vectors, found = dealt.Vectors(rows), []
        names = dealt.names_of(vectors.keys)
        for group, trial in units[number::tasks]:
            kept = np.flatnonzero(~np.isin(vectors.keys, without[group]))
            order, n = kept[dealt.digest_order([names[k] for k in kept], b"%d:" % trial)], dealt.side(len(kept))
            found += [(group, k, trial, m) for k, m in dealt.grid_means(vectors, dealt.placed(order, np.arange(n * n)), n).items()]
        return pa.Table.from_pylist([dict(zip(("group", "kind", "trial", "mean"), x)) for x in found], pa.schema([("group", pa.int64()), ("kind", pa.int32()), ("trial", pa.int64()), ("mean", pa.float64())]))

    return dealt.by_task(dealt.packed(items), tasks, run, "group long, kind int, trial long, mean double")


#: A sequence made from all items: the digest prefix that orders them (none: by id), ids left out, ids that give way to others.
Sequence = tuple[bytes | None, list[int], dict[int, int]]


def layout_means(items: DataFrame, sequences: list[Sequence]) -> DataFrame:
    """(number, layout, kind, mean) for each of the sequences in each layout."""
    units = [(s, name) for s in range(len(sequences)) for name in dealt.ordinals(1)]
    tasks = dealt.tasks_for(items.sparkSession, len(units))

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        vectors, found = dealt.Vectors(rows), []
        keys, names, orders = vectors.keys, dealt.names_of(vectors.keys), {}
        for s, name in units[number::tasks]:
            prefix, gone, put = sequences[s]
            if (at := (prefix, tuple(gone))) not in orders:
                kept = np.flatnonzero(~np.isin(keys, gone))
                orders = {at: kept if prefix is None else kept[dealt.digest_order([names[k] for k in kept], prefix)]}
            order = orders[at].copy()
            for old, new in put.items():
                order[orders[at] == np.searchsorted(keys, old)] = np.searchsorted(keys, new)
            n = dealt.side(len(order))
            found += [(s, name, k, m) for k, m in dealt.grid_means(vectors, dealt.placed(order, dealt.ordinals(n)[name]), n).items()]
        return pa.Table.from_pylist([dict(zip(("number", "layout", "kind", "mean"), x)) for x in found], pa.schema([("number", pa.int32()), ("layout", pa.string()), ("kind", pa.int32()), ("mean", pa.float64())]))

    return dealt.by_task(dealt.packed(items), tasks, run, "number int, layout string, kind int, mean double")


def omission_scores(seq: DataFrame, orders: SeededOrders | DigestOrders) -> DataFrame:
    """layout, kind, omitted, mean, random_mean, random_sd, z_score, percentile for a sequence (pos, v) with each place left out in turn.

    orders deal the ordinals of the places kept to cells.  Tasks take layouts,
    then trials; a trial's means for all omissions are running sums over its
    edges, of which a task keeps sums, squares around what is near the mean,
    and how many are at or below each layout's mean.
    """
    spark, layouts = seq.sparkSession, sorted(dealt.ordinals(1))
    vectors, tasks = dealt.packed(seq, "pos"), dealt.tasks_for(seq.sparkSession, len(orders))
    parts = dealt.tasks_for(spark, len(layouts))

    def observe(number: int, rows: dealt.Rows) -> pa.Table:
        held, out = dealt.Vectors(rows), []
        n = dealt.side(len(held) - 1)
        every = dealt.ordinals(n)
        for name in layouts[number::parts]:
            for kind, means in dealt.omission_means(held, dealt.placed(np.arange(len(held) - 1), every[name]), n):
                for at in range(0, len(means), dealt.ROWS):
                    part = means[at : at + dealt.ROWS]
                    out.append((at // dealt.ROWS, f"{kind} {name}", np.arange(at, at + len(part)).tobytes(), 1, part.tobytes()))
        return pa.Table.from_pylist([dict(zip(("chunk", "what", "ids", "width", "data"), x)) for x in out], pa.schema([("chunk", pa.int64()), ("what", pa.string()), ("ids", pa.binary()), ("width", pa.int32()), ("data", pa.binary())]))

    def score(number: int, rows: dealt.Rows) -> Iterator[pa.Table]:
        held = dealt.Vectors(rows)
        size, n = len(held), dealt.side(len(held) - 1)
        seen = {}
        for kind in (4, 8):
            table = np.full((len(layouts), size), np.nan)
            for m, name in zip(table, layouts):
                keys, part = dealt.taken(rows, f"{kind} {name}")
                m[keys] = part[:, 0] if len(keys) else 0
            seen[kind] = (table, np.mean(table, axis=0), np.zeros((2, size)), np.zeros((len(layouts), size), np.int32))
        trials = 0
        for order in orders.of(number, tasks, rows):
            trials += 1
            for kind, means in dealt.omission_means(held, dealt.placed(order, np.arange(n * n)), n):
                table, base, sums, at_most = seen[kind]
                for m, c in zip(table, at_most):
                    c += means <= m
                means -= base
                sums[0] += means
                sums[1] += np.square(means, out=means)
        for kind, (_, _, sums, at_most) in seen.items():
            for at in range(0, size if trials else 0, dealt.ROWS):
                part = np.concatenate([x[:, at : at + dealt.ROWS].astype(np.float64) for x in (sums, at_most)])
                yield pa.table({"chunk": [at // dealt.ROWS], "what": [f"{kind}"], "n": [trials], "data": pa.array([part.tobytes()], pa.binary())})

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = []
        means = {r["what"]: np.frombuffer(r["data"]) for r in rows.to_pylist() if " " in r["what"]}
        for kind in (4, 8):
            found = [r for r in rows.to_pylist() if r["what"] == f"{kind}"]
            if not found or f"{kind} {layouts[0]}" not in means:
                continue
            table = [means[f"{kind} {name}"] for name in layouts]
            base, trials = np.mean(table, axis=0), sum(r["n"] for r in found)
            sums = np.sum([np.frombuffer(r["data"]).reshape(2 + len(layouts), -1) for r in found], axis=0)
            mean, sd = base + sums[0] / trials, np.sqrt(np.maximum(sums[1] / trials - (sums[0] / trials) ** 2, 0))
            for k, name in enumerate(layouts):
                out.append(pa.table({
                    "layout": pa.array([name] * len(base), pa.string()), "kind": pa.array(np.full(len(base), kind), pa.int32()), "omitted": pa.array(np.arange(len(base)) + key[0].as_py() * dealt.ROWS, pa.int64()),
                    "mean": pa.array(table[k]), "m": pa.array(mean), "sd": pa.array(sd), "p": pa.array(sums[2 + k] / trials)}))
        empty = pa.schema([("layout", pa.string()), ("kind", pa.int32()), ("omitted", pa.int64()), *((c, pa.float64()) for c in ("mean", "m", "sd", "p"))]).empty_table()
        return pa.concat_tables([empty, *out])

    observed = dealt.by_task(vectors, parts, observe, f"chunk long, {dealt.PACKED}")
    scored = dealt.by_task(vectors.unionByName(observed.drop("chunk")), tasks, score, "chunk long, what string, n long, data binary", orders.starts(spark, tasks))
    every = scored.unionByName(observed.select("chunk", "what", F.lit(0).cast("long").alias("n"), "data"))
    got = every.groupBy("chunk").applyInArrow(finish, "layout string, kind int, omitted long, mean double, m double, sd double, p double")
    z = (F.col("mean") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return got.select("layout", "kind", "omitted", F.round("mean", 6).alias("mean"), F.round("m", 6).alias("random_mean"), F.round("sd", 6).alias("random_sd"), F.round(z, 4).alias("z_score"), F.round("p", 6).alias("percentile"))


def order_means(items: DataFrame, trials: int, first: int | None = None, parity: int | None = None) -> DataFrame:
    """(trial, mean): mean similarity of neighbours of items (id, v) in random orders, of their first pairs only, or of every other pair."""
    return neighbour_means(items, [b"%d:" % trial for trial in range(trials)], first, parity).withColumnRenamed("number", "trial")


def neighbour_means(items: DataFrame, prefixes: list[bytes | None], first: int | None = None, parity: int | None = None) -> DataFrame:
    """(number, mean): mean similarity of neighbours of items (id, v) in the orders of the digests of prefixes and ids (none: by id)."""
    tasks = dealt.tasks_for(items.sparkSession, len(prefixes))

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        vectors, found = dealt.Vectors(rows), []
        names = dealt.names_of(vectors.keys)
        for k in range(number, len(prefixes), tasks):
            order = np.arange(len(vectors)) if prefixes[k] is None else dealt.digest_order(names, prefixes[k])
            values = vectors.along(order if first is None else order[: first + 1])
            values = values if parity is None else values[parity::2]
            values = values[~np.isnan(values)]
            if len(values):
                found.append((k, values.mean()))
        return pa.table({"number": pa.array([k for k, _ in found], pa.int64()), "mean": pa.array([m for _, m in found], pa.float64())})

    return dealt.by_task(dealt.packed(items), tasks, run, "number long, mean double")


def neighbours_by_id(items: DataFrame, parity: int | None = None) -> DataFrame:
    """A row (n, mean, median): how many pairs of neighbours by id items (id, v) have, and their similarities; with a parity, every other pair from that one on.

    A task that is dealt all vectors finds both, as those of the null do, so nothing is sorted or joined.
    """

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        vectors = dealt.Vectors(rows)
        values = vectors.along(np.arange(len(vectors)))
        values = values if parity is None else values[parity::2]
        known = values[~np.isnan(values)]
        mean, median = (known.mean(), np.median(known)) if len(known) else (None, None)
        return pa.table({"n": pa.array([len(values)], pa.int64()), "mean": pa.array([mean], pa.float64()), "median": pa.array([median], pa.float64())})

    found = dealt.by_task(dealt.packed(items), 1, run, "n long, mean double, median double")
    return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("mean").alias("mean"), F.max("median").alias("median"))  # a row also of an empty table


def displacements(points: DataFrame, trials: int, max_lag: int) -> DataFrame:
    """(trial, lag, msd): mean squared distance of points (id, v) lag places apart in random orders."""
    tasks = dealt.tasks_for(points.sparkSession, trials)

    def run(number: int, rows: dealt.Rows) -> pa.Table:
        held, found = dealt.Vectors(rows), []
        names, xy = dealt.names_of(held.keys), held.plain(np.arange(len(held)))
        xy[~held.known[:-1]] = np.nan
        for trial in range(number, trials, tasks):
            x, y = xy[dealt.digest_order(names, b"%d:" % trial)].T.copy()
            for lag in range(1, min(max_lag, len(x) - 1) + 1):
                dx, dy = x[lag:] - x[:-lag], y[lag:] - y[:-lag]
                total, n = dx @ dx + dy @ dy, len(dx)
                if np.isnan(total):
                    square = dx * dx + dy * dy
                    total, n = np.nansum(square), int((~np.isnan(square)).sum())
                if n:
                    found.append((trial, lag, total / n))
        t, lag, m = zip(*found) if found else ((), (), ())
        return pa.table({"trial": pa.array(t, pa.int64()), "lag": pa.array(lag, pa.int32()), "msd": pa.array(m, pa.float64())})

    return dealt.by_task(dealt.packed(points), tasks, run, "trial long, lag int, msd double")


def kernel_omissions(edges: DataFrame, similarity: np.ndarray, orders: np.ndarray, observed: DataFrame) -> DataFrame:
    """layout, kind, omitted, mean, random_mean, random_sd, z_score, percentile for observed (layout, kind, omitted, mean).

    edges (kind, u, v) join ordinals of a grid that holds one item less than
    the sequence; an order deals ordinals to cells.  For each place left out an
    edge joins one of three pairs of places (see overlaps.omission_overlaps), so that a
    trial's means for all omissions are running sums over its edges.  Tasks
    take trials, and give for each omission sums, squares and how many of
    their trials are at or below each observed mean.
    """
    spark, n = edges.sparkSession, len(similarity)
    rows = edges.collect()  # of a layout's size, as the matrix is
    kinds = sorted({r.kind for r in rows})
    ends = {k: np.array([(r.u, r.v) for r in rows if r.kind == k]) for k in kinds}
    seen = observed.select("layout", "kind", "omitted", "mean").collect()
    layouts = sorted({r.layout for r in seen})
    table = np.full((len(kinds), len(layouts), n), np.nan)
    for r in seen:
        table[kinds.index(r.kind), layouts.index(r.layout), r.omitted] = r.mean
    shared = spark.sparkContext.broadcast((similarity, orders, ends, table))
    parts = max(1, min(len(orders) // 100, spark.sparkContext.defaultParallelism * 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sim, perms, graph, means = shared.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                for k, kind in enumerate(kinds):
                    values = []
                    for order in np.array_split(perms, parts)[part]:
                        p, q = np.sort(order[graph[kind]].astype(np.int64), axis=1).T
                        step = np.zeros(n + 1)
                        for first, after, x, y in ((q + 1, np.full(len(q), n), p, q), (np.zeros(len(p), np.int64), p + 1, p + 1, q + 1), (p + 1, q + 1, p, q + 1)):
                            s = sim[x, np.minimum(y, n - 1)] * (first < after)
                            step += np.bincount(first, s, n + 1)[: n + 1] - np.bincount(after, s, n + 1)[: n + 1]
                        values.append(np.cumsum(step[:n]) / len(p))
                    values = np.array(values).reshape(-1, n)
                    at_most = [(values <= m[None, :]).sum(axis=0) for m in means[k]]
                    base = np.nanmean(means[k], axis=0)  # squares are taken around what is near the mean
                    off = values - base
                    yield pa.table({
                        "kind": pa.array(np.full(n, kind), pa.int32()), "omitted": pa.array(np.arange(n), pa.int64()), "base": pa.array(base), "n": pa.array(np.full(n, len(values)), pa.int64()),
                        "s": pa.array(off.sum(axis=0)), "s2": pa.array((off * off).sum(axis=0)), "at_most": pa.array(np.array(at_most).T.tolist(), pa.list_(pa.int64()))}).to_batches()[0]

    found = spark.range(0, parts, 1, parts).mapInArrow(run, "kind int, omitted long, base double, n long, s double, s2 double, at_most array<long>")
    each = found.groupBy("kind", "omitted").agg(F.first("base").alias("base"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("s2").alias("s2"), *(F.sum(F.col("at_most")[k]).alias(f"c{k}") for k in range(len(layouts))))
    each = each.select("kind", "omitted", "n", (F.col("base") + F.col("s") / F.col("n")).alias("m"), F.sqrt(F.greatest(F.col("s2") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("sd"), F.inline(F.array(*(F.struct(F.lit(name).alias("layout"), F.col(f"c{k}").alias("c")) for k, name in enumerate(layouts)))))
    both = observed.join(each, ["layout", "kind", "omitted"])
    z = (F.col("mean") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0))
    return both.select("layout", "kind", "omitted", F.round("mean", 6).alias("mean"), F.round("m", 6).alias("random_mean"), F.round("sd", 6).alias("random_sd"), F.round(z, 4).alias("z_score"), F.round(F.col("c") / F.col("n"), 6).alias("percentile"))


def sampled_pairs(spark: SparkSession, n: int, k: int, trials: int) -> DataFrame:
    """(trial, i, j): k different pairs of 0..n-1 for each trial, drawn by digest; of 4k draws the first k different ones."""
    total = n * (n - 1) // 2
    draws = trials_of(spark, trials).select("trial", F.explode(F.sequence(F.lit(0), F.lit(4 * k - 1))).alias("draw"))
    digest = F.md5(F.concat(F.lit("pair:"), F.col("trial").cast("string"), F.lit(":"), F.col("draw").cast("string")))
    draws = draws.withColumn("p", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % total)
    firsts = draws.groupBy("trial", "p").agg(F.min("draw").alias("draw"))
    kept = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("trial").orderBy("draw"))).where(F.col("_r") <= k)
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2).cast("long")
    return kept.withColumn("j", j).withColumn("i", F.col("p") - F.expr("(j * (j - 1)) div 2")).select("trial", "i", "j")
