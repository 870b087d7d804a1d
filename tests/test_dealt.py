"""Nulls and layouts over vectors dealt to tasks, against plain loops."""

import random

import numpy as np
import pyarrow as pa
import pytest

from seqlattice.operators import dealt, grid, nulls, pairs


def vectors_of(spark, n, width=4, key="id"):
    v = np.random.default_rng(n).standard_normal((n, width))
    return spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], f"{key} long, v array<double>"), v / np.linalg.norm(v, axis=1, keepdims=True)


def neighbours(order, cells):
    """Plain pairs of what is in neighbouring cells: kind -> pairs."""
    out, at = {4: [], 8: []}, {cells[k]: order[k] for k in range(len(order))}
    for (r, c), x in at.items():
        for k, (dr, dc) in enumerate(grid.OFFSETS):
            if (y := at.get((r + dr, c + dc))) is not None:
                for kind in (4, 8) if k < 2 else (8,):
                    out[kind].append((x, y))
    return out


def by_digest(ids, prefix):
    from hashlib import md5

    return sorted(ids, key=lambda i: md5(f"{prefix}{i}".encode()).hexdigest())


@pytest.mark.parametrize("n", [1, 2, 7])
def test_ordinals_are_those_of_the_expressions(spark, n):
    want = {(r.layout, r.r, r.c): r.ordinal for r in grid.cells(spark, n * n).collect()}
    assert want == {(name, k // n, k % n): int(o) for name, every in dealt.ordinals(n).items() for k, o in enumerate(every)}


def test_random_placements_of_sets_against_plain_means(spark):
    items, u = vectors_of(spark, 23)
    got = {(r.group, r.kind, r.trial): r["mean"] for r in nulls.placement_null(items, {7: [3, 5], 9: [22]}, 3).collect()}
    assert len(got) == 12
    for (group, kind, trial), mean in got.items():
        order = by_digest([i for i in range(23) if i not in {7: (3, 5), 9: (22,)}[group]], f"{trial}:")
        met = neighbours(order, [(k // 5, k % 5) for k in range(25)])[kind]
        assert abs(mean - np.mean([u[i] @ u[j] for i, j in met])) < 1e-12


def test_swapped_sequences_in_each_layout_against_plain_means(spark):
    items, u = vectors_of(spark, 23)
    sequences = [(None, [22, 21], {}), (b"B:", [0, 4], {5: 0, 6: 4})]
    cells = {}
    for r in grid.cells(spark, 21).collect():
        cells.setdefault(r.layout, {})[r.ordinal] = (r.r, r.c)
    plain = [list(range(21)), [{5: 0, 6: 4}.get(i, i) for i in by_digest([i for i in range(23) if i not in (0, 4)], "B:")]]
    rows = nulls.layout_means(items, sequences).collect()
    assert len(rows) == 2 * 7 * 2
    for r in rows:
        met = neighbours(plain[r.number], cells[r.layout])[r.kind]
        assert abs(r["mean"] - np.mean([u[i] @ u[j] for i, j in met])) < 1e-12


def test_vectors_are_moved_once_a_task_whatever_the_trials(spark):
    """The null's plan has one exchange of vectors and no join."""
    items, _ = vectors_of(spark, 5)
    plan = nulls.placement_null(items, {0: []}, 5000)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Window" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_every_layout_shares_one_null(spark):
    from seqlattice.plans import grids

    rows = grids.every_layout(spark.createDataFrame([(4, 0.5)], "kind int, mean double")).collect()
    assert {r.layout for r in rows} == set(grid.ORDINALS) and all((r.kind, r["mean"]) == (4, 0.5) for r in rows)


def test_omissions_against_plain_means(spark):
    n = 14
    seq, u = vectors_of(spark, n, key="pos")
    cells, want = {}, {}
    for r in grid.cells(spark, n - 1).collect():
        cells.setdefault(r.layout, {})[r.ordinal] = (r.r, r.c)
    for o in range(n):
        kept = [i for i in range(n) if i != o]
        null = [neighbours([kept[x] for x in by_digest(range(n - 1), f"{t}:")], [(k // 4, k % 4) for k in range(16)]) for t in range(5)]
        for layout, at in cells.items():
            for kind, met in neighbours(kept, at).items():
                mean = np.mean([u[i] @ u[j] for i, j in met])
                sample = np.array([np.mean([u[i] @ u[j] for i, j in x[kind]]) for x in null])
                want[layout, kind, o] = (mean, sample.mean(), sample.std(), (mean - sample.mean()) / sample.std(), (sample <= mean).mean())
    rows = nulls.omission_scores(seq, nulls.DigestOrders(n - 1, 5)).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert np.allclose((r["mean"], r.random_mean, r.random_sd, r.z_score, r.percentile), want[r.layout, r.kind, r.omitted], atol=1e-4, rtol=1e-4)


@pytest.mark.parametrize("size", [0, 1, 2, 64, 1001])
def test_shuffles_are_those_of_the_generator(size):
    rng, mine, far = random.Random(5), random.Random(5), random.Random(5)
    order, want = list(range(size)), list(range(size))
    for _ in range(5):
        nulls.shuffled(order, mine)
        nulls.passed(size, far)
        rng.shuffle(want)
        assert order == want and rng.getstate() == mine.getstate() == far.getstate()


@pytest.mark.parametrize("most", [10, 20_000])
def test_parts_of_seeded_orders_continue_each_other(spark, monkeypatch, most):
    monkeypatch.setattr(nulls.SeededOrders, "SMALL", most)
    orders, got = nulls.SeededOrders(110, 11, 3), []
    starts = orders.starts(spark, 3).collect()
    for part in range(3):
        rows = pa.Table.from_pylist([{"what": r.what, "ids": bytes(r.ids), "width": r.width, "data": b""} for r in starts if r.number == part])
        got += list(orders.of(part, 3, rows))
    assert np.array_equal(np.array(got), nulls.seeded_orders(110, 11, 3))


@pytest.mark.parametrize("name", ["layout_kernel_null", "loo_kernel_scan"])
def test_kernels_take_more_items_than_a_matrix_of_pairs(spark, tmp_path, monkeypatch, name):
    from seqlattice.plans import catalogue, grids

    monkeypatch.setattr(grids, "KERNEL_TRIALS", 8)
    spark.range(5100).selectExpr("id as vec_id", "array(float(sin(id)), float(cos(id * 3)), float(sin(id * id))) as embedding", "int(id % 10) as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(rows) == (14 if name == "layout_kernel_null" else 14 * 5097) and all(r.random_sd is not None for r in rows)


def test_random_orders_of_pairs_and_points_against_plain_means(spark):
    items, u = vectors_of(spark, 11)
    order = by_digest(range(11), "1:")
    plain = np.array([u[a] @ u[b] for a, b in zip(order, order[1:])])
    for want, kw in ((plain, {}), (plain[:4], {"first": 4}), (plain[1::2], {"parity": 1})):
        assert abs({r.trial: r["mean"] for r in nulls.order_means(items, 3, **kw).collect()}[1] - want.mean()) < 1e-12
    v = np.array([r.v for r in items.orderBy("id").collect()])[:, :2]
    got = {(r.trial, r.lag): r.msd for r in nulls.displacements(items.selectExpr("id", "slice(v, 1, 2) as v"), 2, 40).collect()}
    assert set(got) == {(t, lag) for t in (0, 1) for lag in range(1, 11)}
    assert abs(got[1, 3] - ((v[order[3:]] - v[order[:-3]]) ** 2).sum(axis=1).mean()) < 1e-12


def test_the_band_has_the_references_trials():
    from seqlattice.plans import catalogue, sequences

    assert sequences.MSD_TRIALS == 10_000 and "range(10000)" in catalogue.ORACLES["msd_band"]


def ranked(u, ids, largest):
    """All pairs of different ids by rounded similarity, then ids."""
    s = np.round(u @ u.T, 6)
    return sorted(((min(a, b), max(a, b), s[i, j]) for i, a in enumerate(ids) for j, b in enumerate(ids) if i < j), key=lambda x: (-x[2] if largest else x[2], x[0], x[1]))


def with_copies(n, width=5):
    """Vectors of which many are copies of two that point apart, so that bests are tied."""
    v = np.random.default_rng(n).standard_normal((n, width)).astype(np.float32)
    v[5::3], v[6::7] = v[5], -v[5]
    return v


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("group", [5 * 1000, 5 * 30])
def test_extreme_pairs_of_groups_against_all_pairs(spark, monkeypatch, group, largest):
    monkeypatch.setattr(pairs, "GROUP", group)
    v = with_copies(100).astype(float)
    ids = [7 * i % 101 for i in range(100)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    found = pairs.extreme_pairs(df, 20, largest)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan  # vectors go to tasks by groups, not by pairs of blocks
    got = [(r.id_l, r.id_r, r.cosine) for r in found.collect()]
    assert got == ranked(v / np.linalg.norm(v, axis=1, keepdims=True), ids, largest)[:20]


@pytest.mark.parametrize("group", [5 * 1000, 5 * 30])
def test_nearest_in_groups_against_all(spark, monkeypatch, group):
    monkeypatch.setattr(pairs, "GROUP", group)
    v = with_copies(100).astype(float)
    u, ids = v / np.linalg.norm(v, axis=1, keepdims=True), [7 * i % 101 for i in range(100)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>")
    found = pairs.nearest(df, df, 4)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    s = np.round(u @ u.T, 6)
    want = {(a, r + 1): (b, c) for i, a in enumerate(ids) for r, (b, c) in enumerate(sorted(((ids[j], s[i, j]) for j in range(100) if j != i), key=lambda x: (-x[1], x[0]))[:4])}
    assert {(r.id, r["rank"]): (r.other, r.cosine) for r in found.collect()} == want


@pytest.mark.parametrize("shift", [0, 1])
def test_blocks_of_products_against_all(monkeypatch, shift):
    """Small blocks, so that thresholds of earlier ones count; with copies and, shifted, without."""
    monkeypatch.setattr(pairs, "LEFT", 16)
    monkeypatch.setattr(pairs, "RIGHT", 24)
    v = with_copies(150) if not shift else np.random.default_rng(1).standard_normal((150, 5)).astype(np.float32)
    table = lambda x, what, at: pa.table({"what": [what], "ids": [np.arange(at, at + len(x)).tobytes()], "width": pa.array([5], pa.int32()), "data": [x.tobytes()]})
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    for largest, sign in ((True, 1), (False, -1)):
        for parts, same in (((0, 150), (0, 150)), True), (((0, 90), (90, 150)), False):
            (a, b), (c, d) = parts
            left, right = pairs._Group(table(v[a:b], "x", a), "x", sign), pairs._Group(table(v[c:d], "y", c), "y")
            got = list(zip(*(x.tolist() for x in pairs._extremes(left, right, same, 30))))
            want = [x for x in ranked(u, range(150), largest) if same or (x[0] < 90) != (x[1] < 90)][:30]
            assert [(i, j, sign * x) for i, j, x in got] == want
    side = pairs._Group(table(v, "x", 0), "x")
    values, others = pairs._nearest(side, side, 6)
    s = np.round(u @ u.T, 6)
    for i in range(150):
        assert others[i].tolist() == sorted((j for j in range(150) if j != i), key=lambda j: (-s[i, j], j))[:6]


def test_cells_are_not_broadcast(spark):
    """Spark takes cells, made from a range, for a few bytes, whatever their number."""
    plan = grid.edges(grid.cells(spark, 50))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_overlaps_of_layouts_against_plain_pairs(spark):
    """Ids with gaps; no pair of items leaves a task and no join is planned, so the driver broadcasts nothing."""
    from seqlattice.operators import overlaps

    ids = [k + k // 5 for k in range(23)]
    seqs = [[i for i in ids if i not in (26, 25)], by_digest([i for i in ids if i not in (0, 7)], "B:")]
    common, met = set(seqs[0]) & set(seqs[1]), []
    cells = {}
    for r in grid.cells(spark, 21).collect():
        cells.setdefault(r.layout, {})[r.ordinal] = (r.r, r.c)
    for seq in seqs:
        met.append({(layout, kind): {frozenset(p) for p in pairs_ if common.issuperset(p)} for layout, at in cells.items() for kind, pairs_ in neighbours(seq, at).items()})
    want = {(a, b, k): (len(x), len(y), len(x & y), sum(max(p) - min(p) == 1 for p in x & y), len(common)) for (a, k), x in met[0].items() for (b, kind), y in met[1].items() if kind == k}
    found = overlaps.overlaps(spark.createDataFrame([(i,) for i in ids], "id long"), (None, [26, 25]), (b"B:", [0, 7]))
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {(r.layout_first, r.layout_second, r.kind): tuple(r[3:]) for r in found.collect()} == want


def test_a_tasks_memory_holds_vectors_once():
    """Blocks go into one matrix as they come; beside it, a trial needs little."""
    import tracemalloc

    n, width, rng = 90_000, 64, np.random.default_rng(0)

    def parts():
        for at in rng.permutation(n // 1000) * 1000:
            v = rng.standard_normal((1000, width)).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"what": ["v"], "ids": [np.arange(at, at + 1000).tobytes()], "width": pa.array([width], pa.int32()), "data": pa.array([v.tobytes()], pa.binary())})

    tracemalloc.start()
    held = dealt.Vectors(dealt.Rows(parts()))
    means = dict(dealt.omission_means(held, dealt.placed(np.arange(n - 1), np.arange(300 * 300)), 300))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(held) == n and np.array_equal(held.keys, np.arange(n)) and set(means) == {4, 8}
    assert most < 2 * n * width * 4


def test_blocks_of_several_widths_and_kinds_are_one_matrix():
    block = lambda ids, v, kind: {"what": "v", "ids": np.array(ids).tobytes(), "width": v.shape[1], "data": v.astype(kind).tobytes()}
    a, b, none = np.array([[1.0, 2], [np.nan, np.nan]]), np.array([[3.0, 4e300]]), np.empty((2, 0))
    schema = pa.schema([("what", pa.string()), ("ids", pa.binary()), ("width", pa.int32()), ("data", pa.binary())])
    held = dealt.Vectors(pa.Table.from_pylist([block([9, 8], none, "f4"), block([3, 1], a, "f4"), block([2], b, "f8")], schema))
    assert held.keys.tolist() == [1, 2, 3, 8, 9] and held.known.tolist() == [False, True, True, False, False, False]
    assert held.plain(np.array([2, 1, 0, -1])).tolist() == [[1, 2], [3, 4e300], [0, 0], [0, 0]]


def test_common_orders_are_dealt_without_joins_of_vectors(spark, tmp_path):
    """Both orderings' neighbours are found in tasks: the only join is that of a few means with the null."""
    from seqlattice.plans import catalogue

    spark.range(40).selectExpr("id as vec_id", "array(float(sin(id)), float(cos(id * 3)), float(sin(id * id))) as embedding", "int(id % 10) as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["common_only_adjacent"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 1
    items = spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").collect()
    u = {r.vec_id + 1: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in items}
    ids = sorted(set(range(1, 37)) - set(by_digest(range(1, 37), "A:")[:3]))
    want = {name: np.mean([u[a] @ u[b] for a, b in zip(order, order[1:])]) for name, order in (("first", ids), ("second", by_digest(ids, "B:")))}
    assert {r.ordering: r["mean"] for r in found.collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_overlaps_of_omissions_against_plain_pairs(spark):
    from seqlattice.operators import overlaps

    ids, n = list(range(23)), 21
    first, second = [i for i in ids if i not in (21, 22)], by_digest([i for i in ids if i not in (0, 7)], "B:")
    cells, whole = {}, {}
    for r in grid.cells(spark, n - 1).collect():
        cells.setdefault(r.layout, {})[r.ordinal] = (r.r, r.c)
    for r in grid.cells(spark, n).where("layout = 'spiral'").collect():
        whole[r.ordinal] = (r.r, r.c)
    spiral, want = {k: set(map(frozenset, x)) for k, x in neighbours(first, whole).items()}, {}
    for o in range(n):
        for layout, at in cells.items():
            for kind, met in neighbours([i for k, i in enumerate(second) if k != o], at).items():
                common = [frozenset(x) for x in met if set(first).issuperset(x)]
                want[layout, kind, o] = (len(common), sum(x in spiral[kind] for x in common))
    found = overlaps.omission_overlaps(spark.createDataFrame([(i,) for i in ids], "id long"), (None, [21, 22]), (b"B:", [0, 7]), "spiral")
    assert "Join" not in found._jdf.queryExecution().toString()
    assert {(r.layout, r.kind, r.omitted): (r.n_second, r.n_both) for r in found.collect()} == want


def table_of(spark, path, n, width=16):
    rng = np.random.default_rng(n)
    rows = [(k, rng.standard_normal(width).astype(np.float32).tolist(), k % 10) for k in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(1).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


#: How often vectors go to a task, with 8 tasks for a null's trials: once for each, and for the seven layouts or for what is observed.
DEALT = {"shared_cell_scan": 8, "layout_null_stats": 8 + 7, "adjacent_summary_null": 8 + 1, "pair_mean_even_odd": 8 + 1, "pair_mean_odd_even": 8 + 1, "pair_mean_odd_even_strict": 8 + 1}


@pytest.mark.parametrize("name", DEALT)
def test_bytes_moved_are_those_of_vectors_once_a_task(spark, tmp_path, name):
    """Not those of items times trials, nor of joins or sorts of the vectors."""
    from seqlattice.plans import catalogue

    n, width, sc = 3000, 16, spark.sparkContext._jsc.sc()
    data = table_of(spark, tmp_path, n, width)

    def moved():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorSummary("driver").totalShuffleWrite()

    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the table were large
    try:
        before = moved()
        catalogue.QUERIES[name](spark, data).collect()
        assert 0 < moved() - before < 1.1 * DEALT[name] * n * (4 * width + 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
@pytest.mark.parametrize("name", ["adjacent_summary_null", "pair_mean_even_odd", "pair_mean_odd_even", "pair_mean_odd_even_strict"])
def test_neighbours_of_few_items_against_sql(spark, tmp_path, name, n):
    """A random order of two or three items may tie with the observed one, which must not depend on rounding."""
    from comparing import against_sql
    from seqlattice.plans import catalogue

    against_sql(catalogue.QUERIES[name](spark, table_of(spark, tmp_path, n)), catalogue.ORACLES[name].replace("FROM embeddings)", f"FROM '{tmp_path}/embeddings.parquet/*.parquet')"))
