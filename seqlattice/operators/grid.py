"""Square grids: layouts of an ordering, neighbouring cells, and scores of placements.

A grid for n items has the smallest side that holds them; cells from n on stay
empty and have no edges.  Layouts are closed forms, so a cell's ordinal needs no
walk over the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine

_DIAGONAL = "if({t} < n, {t} * ({t} + 1) div 2, n * n - (2 * n - 1 - {t}) * (2 * n - {t}) div 2) + if({t} % 2 = 0, r - greatest(0, {t} - n + 1), least({t}, n - 1) - r)"
_RING = "least(r, c, n - 1 - r, n - 1 - c)"

#: Ordinals of the cell (r, c) of a grid of side n, 0-based.
ORDINALS = {
    "row_major": "r * n + c",
    "row_serpentine": "r * n + if(r % 2 = 0, c, n - 1 - c)",
    "column_major": "c * n + r",
    "column_serpentine": "c * n + if(c % 2 = 0, r, n - 1 - r)",
    "diagonal_nw_se": _DIAGONAL.format(t="(r + c)"),
    "diagonal_ne_sw": _DIAGONAL.format(t="(r + n - 1 - c)"),
    "spiral": (
        f"4 * {_RING} * (n - {_RING}) + case when r = {_RING} then c - {_RING} when c = n - 1 - {_RING} then (n - 2 * {_RING} - 1) + r - {_RING} "
        f"when r = n - 1 - {_RING} then 2 * (n - 2 * {_RING} - 1) + (n - 1 - {_RING} - c) else 3 * (n - 2 * {_RING} - 1) + (n - 1 - {_RING} - r) end"),
}
#: Offsets of half of a cell's neighbours; kind 4 uses the first two, kind 8 all.
OFFSETS = ((1, 0), (0, 1), (1, 1), (1, -1))


def side_of(n: int) -> int:
    return math.isqrt(n - 1) + 1 if n > 0 else 0


def cells(spark: SparkSession, n_items: int) -> DataFrame:
    """layout, ordinal, r, c of all occupied cells."""
    n = side_of(n_items)
    grid = spark.range(n * n).selectExpr(f"{n}L as n", f"id div {max(n, 1)} as r", f"id % {max(n, 1)} as c")
    every = [F.struct(F.lit(k).alias("layout"), F.expr(e).cast("long").alias("ordinal")) for k, e in ORDINALS.items()]
    out = grid.select("r", "c", F.inline(F.array(*every)))
    return out.where(F.col("ordinal") < n_items).select("layout", "ordinal", "r", "c")


def edges(placed: DataFrame) -> DataFrame:
    """layout, kind (4 or 8 neighbours), u, v (ordinals of neighbouring cells, u < v); an equi-join on shifted cells."""
    steps = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(k >= 2).alias("slant")) for k, (dr, dc) in enumerate(OFFSETS)))
    here = placed.select("layout", F.col("ordinal").alias("a"), "r", "c", F.inline(steps)).select("layout", "a", (F.col("r") + F.col("dr")).alias("r"), (F.col("c") + F.col("dc")).alias("c"), "slant")
    # Spark takes cells, made from a range, for a few bytes and would broadcast all of them.
    both = here.join(placed.withColumnRenamed("ordinal", "b").hint("merge"), ["layout", "r", "c"])
    kinds = F.when(F.col("slant"), F.array(F.lit(8))).otherwise(F.array(F.lit(4), F.lit(8)))
    return both.select("layout", F.explode(kinds).alias("kind"), F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def with_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (i, j, ...) with the cosine of the items' vectors (id, v)."""
    left, right = vectors.select(F.col("id").alias("i"), F.col("v").alias("_x")), vectors.select(F.col("id").alias("j"), F.col("v").alias("_y"))
    return pairs.join(left, "i").join(right, "j").withColumn("cosine", cosine(F.col("_x"), F.col("_y"))).drop("_x", "_y")


def occupied(graph: DataFrame, seq: DataFrame) -> DataFrame:
    """Edges with the items (i, j) that sit in their cells, for a sequence (pos, id)."""
    return graph.join(seq.select(F.col("pos").alias("u"), F.col("id").alias("i")), "u").join(seq.select(F.col("pos").alias("v"), F.col("id").alias("j")), "v")


def check_full(base: DataFrame, swaps: DataFrame, n: int) -> None:
    """Raises unless each configuration fills the n ordinals, each with one item."""
    fixed = base.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ordinal", "id").alias("d"))
    put = swaps.groupBy("config", "group").agg(F.count(F.lit(1)).alias("n2"), F.countDistinct("ordinal").alias("d2"))
    twice = base.select("group", "ordinal").join(swaps.select("group", "ordinal").distinct(), ["group", "ordinal"], "left_semi").limit(1).count()
    bad = put.join(fixed, "group", "left").where(f"n is null or n + n2 <> {n} or d + d2 <> {n}").limit(1).count()
    if twice or bad:
        raise ValueError(f"a configuration doesn't fill the {n} cells, each with one item")
