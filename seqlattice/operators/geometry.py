"""Paths through points in the plane: displacement by lag, length, sweep and turns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrapped(angle: Column) -> Column:
    """The same turn in (-pi, pi]."""
    return F.when(angle > math.pi, angle - 2 * math.pi).when(angle <= -math.pi, angle + 2 * math.pi).otherwise(angle)


def displacement(path: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """keys, lag, msd: mean squared distance of points lag places apart, for paths (keys, pos, x, y)."""
    left = path.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), "pos", F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    left = left.withColumn("pos", F.col("pos") + F.col("lag"))
    both = left.join(path, [*keys, "pos"])
    square = (F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2
    return both.groupBy(*keys, "lag").agg(F.avg(square).alias("msd"))


def steps(path: DataFrame, keys: list[str]) -> DataFrame:
    """Each point with the next one (nx, ny) and the one after (mx, my), by two equi-joins on place."""
    later = lambda k, a, b: path.select(*keys, (F.col("pos") - k).alias("pos"), F.col("x").alias(a), F.col("y").alias(b))
    return path.join(later(1, "nx", "ny"), [*keys, "pos"], "left").join(later(2, "mx", "my"), [*keys, "pos"], "left")


def path_statistics(path: DataFrame, keys: list[str]) -> DataFrame:
    """keys, length, sweep (rotations about the centroid), turns (rotations of the heading)."""
    centre = path.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")) if keys else path.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    walk = steps(path, keys)
    walk = walk.join(centre, keys) if keys else walk.join(F.broadcast(centre))
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    sweep = wrapped(F.atan2(F.col("ny") - F.col("cy"), F.col("nx") - F.col("cx")) - F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    turn = wrapped(F.atan2(F.col("my") - F.col("ny"), F.col("mx") - F.col("nx")) - F.atan2(dy, dx))
    sums = [F.sum(F.sqrt(dx * dx + dy * dy)).alias("length"), (F.sum(F.abs(sweep)) / (2 * math.pi)).alias("sweep"), (F.sum(F.abs(turn)) / (2 * math.pi)).alias("turns")]
    return walk.groupBy(*keys).agg(*sums) if keys else walk.agg(*sums)


