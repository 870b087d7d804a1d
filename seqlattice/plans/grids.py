"""Queries over square layouts of the two orderings: neighbouring cells, nulls, scans, overlaps."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..functions.vectors import cosine
from ..operators import grid, nulls, overlaps
from ..sources import tables
from .registry import SEQUENCES, null_sql, registered

GRID_TRIALS, KERNEL_TRIALS, SEED = 30, 10_000, 20260710


def _sql(e: str) -> str:
    """An ordinal's expression for another engine: whole division and conditions are written differently."""
    out = e.replace(" div ", " // ")
    while "if(" in out:
        at = out.index("if(")
        depth, parts, begin, k = 0, [], at + 3, at + 2
        while True:
            c = out[k]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                parts.append(out[begin:k])
                begin = k + 1
            if depth == 0:
                parts.append(out[begin:k])
                break
            k += 1
        out = f"{out[:at]}CASE WHEN {parts[0]} THEN {parts[1]} ELSE {parts[2]} END{out[k + 1 :]}"
    return out


def _grid_sql(items: str, name: str = "g", less: int = 0) -> str:
    """CTEs {name}_cells (layout, ordinal, r, c) and {name} (layout, kind, u, v) for as many items as a CTE has, less some."""
    each = " UNION ALL ".join(f"SELECT '{k}' AS layout, {_sql(e)} AS ordinal, r, c, m FROM {name}_rc" for k, e in grid.ORDINALS.items())
    offsets = ", ".join(f"({dr}, {dc}, {kind})" for k, (dr, dc) in enumerate(grid.OFFSETS) for kind in ((4, 8) if k < 2 else (8,)))
    return f"""{name}_n AS (SELECT m, CAST(ceil(sqrt(m)) AS BIGINT) AS n FROM (SELECT count(*) - {less} AS m FROM {items})),
{name}_rc AS (SELECT m, n, k // n AS r, k % n AS c FROM {name}_n, LATERAL (SELECT unnest(range(n * n)) AS k) x),
{name}_cells AS (SELECT layout, ordinal, r, c FROM ({each}) WHERE ordinal < m),
{name} AS (SELECT x.layout, o.kind, least(x.ordinal, y.ordinal) AS u, greatest(x.ordinal, y.ordinal) AS v FROM {name}_cells x, (VALUES {offsets}) o(dr, dc, kind), {name}_cells y WHERE y.layout = x.layout AND y.r = x.r + o.dr AND y.c = x.c + o.dc)"""


def graph_of(spark: SparkSession, n: int) -> DataFrame:
    return grid.edges(grid.cells(spark, n))


@registered("layout_cells", f"WITH {SEQUENCES}, {_grid_sql('a')} SELECT layout, ordinal, r, c FROM g_cells")
def layout_cells(spark, sf_dir):
    return grid.cells(spark, tables.first_order(spark, sf_dir).count())


@registered("layout_edges", f"WITH {SEQUENCES}, {_grid_sql('a')} SELECT layout, kind, count(*) AS n_edges, CAST(sum(v - u) AS BIGINT) AS reach FROM g GROUP BY layout, kind")
def layout_edges(spark, sf_dir):
    n = tables.first_order(spark, sf_dir).count()
    return graph_of(spark, n).groupBy("layout", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("v") - F.col("u")).alias("reach"))


_MEANS = f"WITH {SEQUENCES}, {_grid_sql('a')}, e AS (SELECT layout, kind, x.id AS i, y.id AS j, list_cosine_similarity(x.v, y.v) AS c FROM g JOIN a x ON x.pos = u JOIN a y ON y.pos = g.v)"


def scored_edges(spark, sf_dir) -> DataFrame:
    seq = tables.first_order(spark, sf_dir)
    return grid.with_similarity(grid.occupied(graph_of(spark, seq.count()), seq), seq)


@registered("layout_edge_means", f"{_MEANS} SELECT layout, kind, count(*) AS n_edges, round(avg(c), 6) AS mean FROM e GROUP BY layout, kind")
def layout_edge_means(spark, sf_dir):
    return scored_edges(spark, sf_dir).groupBy("layout", "kind").agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.avg("cosine"), 6).alias("mean"))


@registered("layout_edge_extremes", f"""{_MEANS}, r AS (SELECT layout, kind, i, j, round(c, 6) AS cosine FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY layout, kind ORDER BY cosine DESC, least(i, j), greatest(i, j)) AS hi, row_number() OVER (PARTITION BY layout, kind ORDER BY cosine, least(i, j), greatest(i, j)) AS lo FROM r)
SELECT layout, kind, least(i, j) AS id_l, greatest(i, j) AS id_r, cosine, hi <= 12 AS is_top FROM k WHERE hi <= 12 OR lo <= 12""")
def layout_edge_extremes(spark, sf_dir):
    e = scored_edges(spark, sf_dir).select("layout", "kind", F.least("i", "j").alias("id_l"), F.greatest("i", "j").alias("id_r"), F.round("cosine", 6).alias("cosine"))
    by = Window.partitionBy("layout", "kind")
    ranked = e.withColumns({"hi": F.row_number().over(by.orderBy(F.desc("cosine"), "id_l", "id_r")), "lo": F.row_number().over(by.orderBy("cosine", "id_l", "id_r"))})
    return ranked.where("hi <= 12 or lo <= 12").select("layout", "kind", "id_l", "id_r", "cosine", (F.col("hi") <= 12).alias("is_top"))


@registered("layout_null_stats", f"""{_MEANS}, o AS (SELECT layout, kind, avg(c) AS mean FROM e GROUP BY layout, kind),
ro AS (SELECT trial, v, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || ':' || id)) - 1 AS pos FROM a, (SELECT unnest(range({GRID_TRIALS})) AS trial)),
s1 AS (SELECT kind, x.trial, avg(list_cosine_similarity(x.v, y.v)) AS mean FROM g JOIN ro x ON x.pos = u JOIN ro y ON y.pos = g.v AND y.trial = x.trial WHERE layout = 'row_major' GROUP BY kind, x.trial),
s0 AS (SELECT layout, kind, s1.mean FROM (SELECT DISTINCT layout, kind FROM g) JOIN s1 USING (kind)) {null_sql('o', 's0', ['layout', 'kind']).replace('FROM o o', 'FROM o')}""")
def layout_null_stats(spark, sf_dir):
    """Every layout against random placements; the first layout's cell graph serves all."""
    items = tables.items(spark, sf_dir)
    own = ids_of(tables.own_ids(items))
    observed = nulls.layout_means(items, [(None, own, {})]).drop("number")
    sample = nulls.placement_null(items, {0: own}, GRID_TRIALS).select("kind", "mean")
    return stats.against_null(observed, every_layout(sample), ["layout", "kind"])


def ids_of(few: DataFrame) -> list[int]:
    return sorted(r.id for r in few.select("id").collect())


def every_layout(sample: DataFrame) -> DataFrame:
    """A null's rows for each of the layouts, whose full grids have one cell graph."""
    return sample.select(F.explode(F.array(*map(F.lit, grid.ORDINALS))).alias("layout"), "*")


@registered("layout_kernel_null")
def layout_kernel_null(spark, sf_dir):
    """Random placements by seeded shuffles, each of the order before it; one layout's graph for each kind of neighbourhood."""
    seq, items = tables.first_order(spark, sf_dir), tables.items(spark, sf_dir)
    sample = nulls.kernel_null((4, 8), seq, nulls.SeededOrders(seq.count(), KERNEL_TRIALS, SEED))
    observed = nulls.layout_means(items, [(None, ids_of(tables.own_ids(items)), {})]).drop("number")
    return stats.against_null(observed, every_layout(sample), ["layout", "kind"])


def omission_scores(seq: DataFrame, trials: int) -> DataFrame:
    """layout, kind, omitted, mean, random_mean, random_sd, z_score, percentile: each configuration against random placements of the items it keeps."""
    return nulls.omission_scores(seq, nulls.DigestOrders(seq.count() - 1, trials))


_OMIT = f"""WITH {SEQUENCES}, {_grid_sql('b', less=1)}, sims AS MATERIALIZED (SELECT x.pos AS p, y.pos AS q, list_cosine_similarity(x.v, y.v) AS c FROM b x JOIN b y ON x.pos < y.pos),
e AS (SELECT layout, kind, o.pos AS omitted, u + CASE WHEN u >= o.pos THEN 1 ELSE 0 END AS p, v + CASE WHEN v >= o.pos THEN 1 ELSE 0 END AS q FROM g, (SELECT pos FROM b) o)"""
_OMIT_MEANS = f"{_OMIT}, om AS (SELECT layout, kind, omitted, avg(c) AS mean FROM e JOIN sims USING (p, q) GROUP BY layout, kind, omitted)"
_OMIT_SCORES = f"""{_OMIT_MEANS}, rp AS (SELECT trial, k, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || ':' || k)) - 1 AS pos FROM (SELECT pos AS k FROM b WHERE pos < (SELECT count(*) FROM b) - 1), (SELECT unnest(range({GRID_TRIALS})) AS trial)),
rg AS (SELECT kind, x.trial, least(x.k, y.k) AS u, greatest(x.k, y.k) AS v FROM g JOIN rp x ON x.pos = u JOIN rp y ON y.pos = g.v AND y.trial = x.trial WHERE layout = 'row_major'),
re AS (SELECT kind, trial, o.pos AS omitted, u + CASE WHEN u >= o.pos THEN 1 ELSE 0 END AS p, v + CASE WHEN v >= o.pos THEN 1 ELSE 0 END AS q FROM rg, (SELECT pos FROM b) o),
rm AS MATERIALIZED (SELECT kind, trial, omitted, avg(c) AS mean FROM re JOIN sims USING (p, q) GROUP BY kind, trial, omitted),
sc AS (SELECT om.layout, om.kind, om.omitted, round(om.mean, 6) AS mean, round(avg(rm.mean), 6) AS random_mean, round(stddev_pop(rm.mean), 6) AS random_sd, round((om.mean - avg(rm.mean)) / nullif(stddev_pop(rm.mean), 0), 4) AS z_score,
  round(count(*) FILTER (rm.mean <= om.mean) / count(*), 6) AS percentile FROM om JOIN rm USING (kind, omitted) GROUP BY om.layout, om.kind, om.omitted, om.mean)"""
_LABEL = "'S' || lpad(CAST(omitted + 1 AS VARCHAR), 5, '0') || '/H' || CASE WHEN own THEN 'none' ELSE CAST(b.id AS VARCHAR) END AS label"
_SCORES = "mean, random_mean, random_sd, z_score, percentile"


def labelled(seq: DataFrame) -> DataFrame:
    """omitted (place), omitted_id, label."""
    return seq.select(F.col("pos").alias("omitted"), F.col("id").alias("omitted_id"), F.format_string("S%05d/H%s", F.col("pos") + 1, F.when(F.col("own"), "none").otherwise(F.col("id").cast("string"))).alias("label"))


@registered("loo_layout_scan", f"{_OMIT_SCORES} SELECT layout, kind, b.id AS omitted_id, {_LABEL}, {_SCORES} FROM sc JOIN b ON b.pos = omitted")
def loo_layout_scan(spark, sf_dir):
    """The second ordering in every layout with each of its items left out in turn."""
    seq = tables.second_order(spark, sf_dir)
    return omission_scores(seq, GRID_TRIALS).join(labelled(seq), "omitted").drop("omitted")


@registered("loo_top_by_z", f"{_OMIT_SCORES} SELECT layout, kind, omitted, {_SCORES} FROM sc QUALIFY row_number() OVER (PARTITION BY kind ORDER BY coalesce(nullif(z_score, 0), '-inf'::DOUBLE) DESC, layout, omitted) <= 20")
def loo_top_by_z(spark, sf_dir):
    """The 20 best configurations of each neighbourhood by z against random placements; a z of 0 ranks last."""
    best = Window.partitionBy("kind").orderBy(stats.rank_of_z(F.col("z_score")).desc(), "layout", "omitted")
    return omission_scores(tables.second_order(spark, sf_dir), GRID_TRIALS).withColumn("_r", F.row_number().over(best)).where("_r <= 20").drop("_r")


#: Places of the second ordering whose omission is looked at by itself.
FIXED_OMISSIONS = (0, 52, 72, 75, 89, 100)


@registered("loo_fixed_omissions", f"{_OMIT_SCORES} SELECT layout, text_name AS layout_name, kind, omitted, {_LABEL}, {_SCORES} FROM sc JOIN b ON b.pos = omitted JOIN (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in text.LAYOUT_NAMES.items()) + f") n(code, text_name) ON code = layout WHERE omitted IN {FIXED_OMISSIONS}")
def loo_fixed_omissions(spark, sf_dir):
    seq = tables.second_order(spark, sf_dir)
    few = omission_scores(seq, GRID_TRIALS).where(F.col("omitted").isin(*FIXED_OMISSIONS)).join(labelled(seq).drop("omitted_id"), "omitted")
    return few.withColumn("layout_name", text.layout_name(F.col("layout")))


@registered("loo_kernel_scan")
def loo_kernel_scan(spark, sf_dir):
    """The same scan against the 10,000 seeded shuffles, all omissions of a shuffle at once."""
    seq = tables.second_order(spark, sf_dir)
    return nulls.omission_scores(seq, nulls.SeededOrders(seq.count() - 1, KERNEL_TRIALS, SEED)).join(labelled(seq), "omitted").drop("omitted")


#: For sets of items (grp, id): s (grp, kind, trial, mean).  For scored configurations o (grp, ..., mean): their comparison.
_SETS_NULL = f"""isims AS MATERIALIZED (SELECT x.id AS i, y.id AS j, list_cosine_similarity(x.v, y.v) AS c FROM items x JOIN items y ON x.id < y.id),
ro AS MATERIALIZED (SELECT grp, trial, id, row_number() OVER (PARTITION BY grp, trial ORDER BY md5(trial || ':' || id)) - 1 AS pos FROM sets, (SELECT unnest(range({GRID_TRIALS})) AS trial)),
rx AS MATERIALIZED (SELECT grp, trial, kind, id AS i, g.v AS spot FROM g JOIN ro ON pos = u WHERE layout = 'row_major'),
ry AS MATERIALIZED (SELECT rx.grp, rx.trial, kind, least(i, id) AS i, greatest(i, id) AS j FROM rx JOIN ro ON ro.grp = rx.grp AND ro.trial = rx.trial AND pos = spot),
s AS MATERIALIZED (SELECT grp, kind, trial, avg(c) AS mean FROM ry JOIN isims USING (i, j) GROUP BY grp, kind, trial)"""


def against_sets(items: DataFrame, configs: list[tuple[int, dict, nulls.Sequence]], sets: dict[int, list[int]]) -> DataFrame:
    """*labels, layout, kind and the comparison of configurations (group, labels, sequence) with random placements of their group's items: all without those of sets."""
    spark, labels = items.sparkSession, list(configs[0][1])
    means = nulls.layout_means(items, [c[2] for c in configs])
    rows = [(k, group, *label.values()) for k, (group, label, _) in enumerate(configs)]
    named = spark.createDataFrame(rows, "number int, group long, " + ", ".join(f"{c} {'string' if isinstance(configs[0][1][c], str) else 'long'}" for c in labels))
    means = means.join(F.broadcast(named), "number").drop("number")
    sample = nulls.placement_null(items, sets, GRID_TRIALS).select("group", "kind", F.col("mean").alias("r"))
    keys = [*labels, "layout"]
    return stats.against_null(means, means.select("group", "kind", *keys).join(sample, ["group", "kind"]), ["group", "kind", *keys], sample="r").drop("group")


_SHARED = f"""WITH {SEQUENCES}, {_grid_sql('a')}, holes AS (SELECT pos AS ordinal, row_number() OVER (ORDER BY pos) - 1 AS slot FROM a WHERE id IN (SELECT id FROM missing)),
cfg AS (SELECT o.id AS grp, x.id || '-' || y.id || '-' || z.id AS config, [x.id, y.id, z.id] AS ids FROM own x, own y, own z, own o WHERE x.id <> y.id AND x.id <> z.id AND y.id <> z.id AND o.id NOT IN (x.id, y.id, z.id)),
occ AS (SELECT grp, config, pos AS ordinal, id FROM a, cfg WHERE id NOT IN (SELECT id FROM missing) UNION ALL SELECT grp, config, ordinal, ids[slot + 1] FROM cfg, holes),
ov AS (SELECT grp, config, ordinal, v FROM occ JOIN items USING (id)),
o AS (SELECT x.grp, x.config, layout, kind, avg(list_cosine_similarity(x.v, y.v)) AS mean FROM g JOIN ov x ON x.ordinal = u JOIN ov y ON y.ordinal = g.v AND y.config = x.config GROUP BY x.grp, x.config, layout, kind),
sets AS (SELECT o.id AS grp, i.id FROM own o, (SELECT id FROM a WHERE id NOT IN (SELECT id FROM missing) UNION ALL SELECT id FROM own) i WHERE i.id <> o.id), {_SETS_NULL},
r AS ({null_sql('o', 's', ['grp', 'kind'], ['config', 'layout'])})
SELECT grp AS omitted, config, layout, kind, {_SCORES} FROM r"""


@registered("shared_cell_scan", _SHARED)
def shared_cell_scan(spark, sf_dir):
    """Items of both orderings keep the cells of the first; the cells of items that the second lacks take its own ones but one, in every order."""
    items = tables.items(spark, sf_dir)
    gone, own = ids_of(tables.missing_ids(items)), ids_of(tables.own_ids(items))
    configs = []
    for put in permutations(own, len(gone)):
        out = next(o for o in own if o not in put)
        configs.append((out, {"omitted": out, "config": "-".join(map(str, put))}, (None, own, dict(zip(gone, put)))))
    out = against_sets(items, configs, {o: [*gone, o] for o in own})
    return out.select("omitted", "kind", "config", "layout", *(c for c in out.columns if c not in ("omitted", "kind", "config", "layout")))


_BASE = f"""WITH {SEQUENCES}, {_grid_sql('b', less=1)}, lo AS (SELECT o.id AS omitted, b.id, b.own, row_number() OVER (PARTITION BY o.id ORDER BY b.pos) - 1 AS ordinal FROM b, own o WHERE b.id <> o.id),
holes AS (SELECT omitted, ordinal, row_number() OVER (PARTITION BY omitted ORDER BY ordinal) - 1 AS slot FROM lo WHERE own),
cfg AS (SELECT o.id AS omitted, x.id || '-' || y.id || '-' || z.id AS config, [x.id, y.id, z.id] AS ids FROM own o, missing x, missing y, missing z WHERE x.id <> y.id AND x.id <> z.id AND y.id <> z.id),
occ AS (SELECT omitted, 'base' AS config, ordinal, id FROM lo UNION ALL SELECT omitted, config, ordinal, lo.id FROM lo JOIN cfg USING (omitted) WHERE NOT own UNION ALL SELECT omitted, config, ordinal, ids[slot + 1] FROM cfg JOIN holes USING (omitted)),
ov AS (SELECT omitted, config, ordinal, v FROM occ JOIN items USING (id)),
o AS (SELECT CASE WHEN x.config = 'base' THEN x.omitted ELSE 0 END AS grp, x.omitted, x.config, layout, kind, avg(list_cosine_similarity(x.v, y.v)) AS mean FROM g JOIN ov x ON x.ordinal = u JOIN ov y ON y.ordinal = g.v AND y.config = x.config AND y.omitted = x.omitted GROUP BY x.omitted, x.config, layout, kind),
sets AS (SELECT o.id AS grp, b.id FROM own o, b WHERE b.id <> o.id UNION ALL SELECT 0, id FROM b WHERE NOT own UNION ALL SELECT 0, id FROM missing), {_SETS_NULL},
r AS ({null_sql('o', 's', ['grp', 'kind'], ['omitted', 'config', 'layout'])})
SELECT omitted, config, layout, kind, {_SCORES} FROM r"""


@registered("base_substitution_scan", _BASE)
def base_substitution_scan(spark, sf_dir):
    """The second ordering without one of its own items; then the other own ones give way to the items that it lacks, in every order."""
    items = tables.items(spark, sf_dir)
    gone, own = ids_of(tables.missing_ids(items)), ids_of(tables.own_ids(items))
    placed = [own[k] for k in nulls.dealt.digest_order([b"%d" % i for i in own], tables.SECOND)]
    # Substituted configurations have the same items, whichever own item was left out.
    configs, sets = [], {0: own} | {o: [*gone, o] for o in own}
    for out in own:
        configs.append((out, {"omitted": out, "config": "base"}, (tables.SECOND, sets[out], {})))
        slots = [i for i in placed if i != out]
        configs += [(0, {"omitted": out, "config": "-".join(map(str, put))}, (tables.SECOND, sets[out], dict(zip(slots, put)))) for put in permutations(gone, len(slots))]
    return against_sets(items, configs, sets)


_OVERLAP = f"""WITH {SEQUENCES}, {_grid_sql('a')}, {_grid_sql('b', name='h')}, common AS (SELECT id FROM a WHERE id IN (SELECT id FROM b)), space AS (SELECT count(*) * (count(*) - 1) / 2 AS pairs FROM common),
ea AS (SELECT DISTINCT layout, kind, least(x.id, y.id) AS i, greatest(x.id, y.id) AS j FROM g JOIN a x ON x.pos = u JOIN a y ON y.pos = g.v WHERE x.id IN (SELECT id FROM common) AND y.id IN (SELECT id FROM common)),
eb AS (SELECT DISTINCT layout, kind, least(x.id, y.id) AS i, greatest(x.id, y.id) AS j FROM h JOIN b x ON x.pos = u JOIN b y ON y.pos = h.v WHERE x.id IN (SELECT id FROM common) AND y.id IN (SELECT id FROM common)),
na AS (SELECT layout, kind, count(*) AS n FROM ea GROUP BY ALL), nb AS (SELECT layout, kind, count(*) AS n FROM eb GROUP BY ALL),
x AS (SELECT ea.layout AS la, eb.layout AS lb, ea.kind, count(*) AS both_n, count(*) FILTER (ea.j - ea.i = 1) AS consecutive FROM ea JOIN eb USING (kind, i, j) GROUP BY ALL)
SELECT na.layout AS layout_first, nb.layout AS layout_second, na.kind, na.n AS n_first, nb.n AS n_second, coalesce(both_n, 0) AS n_both, coalesce(consecutive, 0) AS n_consecutive,
  round(coalesce(both_n, 0) / nb.n, 6) AS overlap_second, round(coalesce(both_n, 0) / (na.n + nb.n - coalesce(both_n, 0)), 6) AS jaccard, round(na.n * nb.n / pairs, 6) AS expected
FROM na JOIN nb ON na.kind = nb.kind LEFT JOIN x ON x.la = na.layout AND x.lb = nb.layout AND x.kind = na.kind, space"""


def both_orders(spark, sf_dir) -> tuple[DataFrame, tuple, tuple]:
    """The ids, and the digest prefix (none: by id) and what it lacks of each ordering."""
    items = tables.items(spark, sf_dir)
    return items.select("id"), (None, ids_of(tables.own_ids(items))), (tables.SECOND, ids_of(tables.missing_ids(items)))


@registered("layout_overlap_matrix", _OVERLAP)
def layout_overlap_matrix(spark, sf_dir):
    """Pairs that are neighbours in a layout of the first ordering and in one of the second."""
    every = overlaps.overlaps(*both_orders(spark, sf_dir))
    n = F.col("n_common")
    a, b, x = F.col("n_first"), F.col("n_second"), F.col("n_both")
    share = lambda k, of: F.coalesce(k / F.nullif(of, F.lit(0)), F.lit(0.0))
    return every.select("layout_first", "layout_second", "kind", "n_first", "n_second", "n_both", "n_consecutive", F.round(share(x, b), 6).alias("overlap_second"), F.round(share(x, a + b - x), 6).alias("jaccard"), F.round(share(a * b, n * (n - 1) / 2), 6).alias("expected"))


@registered("overlap_omission_scan", f"""{_OMIT}, {_grid_sql('a', name='h')}, ea AS (SELECT DISTINCT kind, least(x.id, y.id) AS i, greatest(x.id, y.id) AS j FROM h JOIN a x ON x.pos = u JOIN a y ON y.pos = h.v WHERE layout = 'spiral'),
be AS (SELECT layout, kind, omitted, least(x.id, y.id) AS i, greatest(x.id, y.id) AS j FROM e JOIN b x ON x.pos = p JOIN b y ON y.pos = q WHERE NOT x.own AND NOT y.own)
SELECT layout, kind, omitted, count(*) AS n_second, count(ea.i) AS n_both FROM be LEFT JOIN ea USING (kind, i, j) GROUP BY layout, kind, omitted""")
def overlap_omission_scan(spark, sf_dir):
    """For each item left out of the second ordering: its neighbours in each layout that are neighbours in the first ordering's spiral as well."""
    return overlaps.omission_overlaps(*both_orders(spark, sf_dir), "spiral")
