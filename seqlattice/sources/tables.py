"""The Parquet tables, and the two orderings of embedded items derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles

OWN, MISSING = 4, 3
#: The second ordering is that of the digests of this and an id.
SECOND = b"B:"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ordinal(df: DataFrame, *keys: str | Column, name: str = "pos") -> DataFrame:
    """Adds dense 0-based ranks by the keys, which must be unique.

    Rows are sorted by ranges; a partition's ranks start behind the rows of the
    partitions before it, of which only the counts meet in one place.
    """
    cols = df.columns
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()).persist()
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    out = ranged.withColumn("_p", part).join(starts, "_p")
    return out.select(*cols, (F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embedded items: id, v, label."""
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), as_doubles(F.col("embedding")).alias("v"), "label")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items in the order of their ids: pos, id, v, label."""
    return with_ordinal(items(spark, sf_dir), "id")


def own_ids(all_items: DataFrame) -> DataFrame:
    """The items that only the second ordering has: the last ones by id."""
    return all_items.select("id").orderBy(F.desc("id")).limit(OWN)


def missing_ids(all_items: DataFrame) -> DataFrame:
    """The items that only the first ordering has: those first by digest, among the others."""
    rest = all_items.select("id").join(own_ids(all_items), "id", "left_anti")
    return rest.orderBy(F.md5(F.concat(F.lit("A:"), F.col("id").cast("string")))).limit(MISSING)


def is_own(variant: bool = False) -> Column:
    """Whether a row of the second ordering (hyakunin_id, variant_group) has no counterpart in the first; if asked, also where its group says so."""
    id_ = F.col("hyakunin_id").cast("string")
    absent = id_.isNull() | (F.trim(id_) == "")
    return absent | F.coalesce(F.col("variant_group") == "shuka_only", F.lit(False)) if variant else absent


def first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ordering: pos, id, v, label."""
    every = items(spark, sf_dir)
    return with_ordinal(every.join(own_ids(every), "id", "left_anti"), "id")


def second_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second ordering: pos, id, v, label, own (not in the first)."""
    every = items(spark, sf_dir)
    own = own_ids(every).withColumn("own", F.lit(True))
    rest = every.join(missing_ids(every), "id", "left_anti").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    keyed = rest.withColumn("_key", F.md5(F.concat(F.lit(SECOND.decode()), F.col("id").cast("string"))))
    return with_ordinal(keyed, "_key").drop("_key")
