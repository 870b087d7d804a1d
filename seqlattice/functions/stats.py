"""Comparison of an observed statistic with a sample of its null distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def z_score(value: Column, mean: Column, sd: Column) -> Column:
    """Null where the sample doesn't vary."""
    return (value - mean) / F.nullif(sd, F.lit(0.0))


def against_null(observed: DataFrame, null: DataFrame, keys: list[str], value: str = "mean", sample: str = "mean", digits: int = 6) -> DataFrame:
    """keys, mean, random_mean, random_sd (population), z_score, percentile (share of the sample at or below the value).

    An observed key without a sample gets a percentile of 0 and nulls.
    """
    extra = [c for c in observed.columns if c not in (*keys, value)]
    left = observed.withColumnRenamed(value, "_v")
    right = null.select(*keys, F.col(sample).alias("_s"))
    both = left.join(right, keys, "left") if keys else left.withColumn("_k", F.lit(0)).join(right.withColumn("_k", F.lit(0)), "_k", "left")
    out = both.groupBy(*keys, *extra, "_v").agg(
        F.avg("_s").alias("_m"), F.stddev_pop("_s").alias("_sd"),
        F.coalesce(F.sum((F.col("_s") <= F.col("_v")).cast("int")) / F.nullif(F.count("_s"), F.lit(0)), F.lit(0.0)).alias("_p"))
    return out.select(
        *keys, *extra, F.round("_v", digits).alias("mean"), F.round("_m", digits).alias("random_mean"), F.round("_sd", digits).alias("random_sd"),
        F.round(z_score(F.col("_v"), F.col("_m"), F.col("_sd")), 4).alias("z_score"), F.round("_p", digits).alias("percentile"))


def rank_quantile(df: DataFrame, keys: list[str], value: str, p: float, alias: str) -> DataFrame:
    """The value whose 0-based rank in its group is floor(p * n): one rank above percentile_disc where p * n is whole."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumns({"_r": F.row_number().over(by.orderBy(value)), "_n": F.count(F.lit(1)).over(by)})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") * p) + 1).select(*keys, F.col(value).alias(alias))


def rank_of_z(z: Column) -> Column:
    """For ordering by z: null and exactly 0 count as minus infinity."""
    return F.coalesce(F.nullif(z, F.lit(0.0)), F.lit(float("-inf")))
