"""Queries with principal components; there is no SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import pca
from ..sources import tables
from .registry import registered


@registered("pca_points")
def pca_points(spark, sf_dir):
    items = tables.items(spark, sf_dir)
    mean, loadings, _ = pca.components(items)
    return pca.projected(items, mean, loadings).join(items.select("id", "label"), "id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "label")


@registered("pca_explained")
def pca_explained(spark, sf_dir):
    shares = pca.components(tables.items(spark, sf_dir))[2]
    return spark.createDataFrame([(k + 1, round(float(s), 6)) for k, s in enumerate(shares)], "component int, share double")


@registered("pca_label_centroids")
def pca_label_centroids(spark, sf_dir):
    items = tables.items(spark, sf_dir)
    mean, loadings, _ = pca.components(items)
    points = pca.projected(items, mean, loadings).join(items.select("id", "label"), "id")
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@registered("joint_pca")
def joint_pca(spark, sf_dir):
    """The first ordering and the second one's own items in one projection, with each own item's distance to its nearest place in the first."""
    first = tables.first_order(spark, sf_dir).select("id", "v", F.lit(False).alias("own"))
    own = tables.second_order(spark, sf_dir).where("own").select("id", "v", "own")
    both = first.unionByName(own)
    mean, loadings, _ = pca.components(both)
    points = pca.projected(both, mean, loadings).join(both, "id")
    left = points.where("own").select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("v").alias("v0"))
    right = points.where("not own").select(F.col("id").alias("other"), "x", "y", "v")
    pairs = right.join(F.broadcast(left)).select("id", "other", F.sqrt((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2).alias("distance"), cosine(F.col("v"), F.col("v0")).alias("cosine"))
    best = pairs.groupBy("id").agg(F.min(F.struct(F.round("distance", 6).alias("distance"), "other", F.round("cosine", 6).alias("cosine"))).alias("m"))
    return best.select("id", "m.other", "m.distance", "m.cosine")
