"""Seeded, stratified splits and folds by entity, never by row; equal in Spark and SQL through md5."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 4096


def entity_strata(df: DataFrame, entity: str, stratum: str) -> DataFrame:
    """(entity, stratum) once per entity: the smallest stratum of its rows."""
    return df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(stratum).alias(stratum))


def _place(entities: DataFrame, entity: str, stratum: str, seed: int) -> DataFrame:
    """entities with their place (from 1) in the seeded order of their stratum and the stratum's size.

    Strata are few and large: places are counted within shards of the hash order and shards are added up.
    """
    keyed = entities.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(entity).cast("string")))).withColumn("_s", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    shards = keyed.groupBy(stratum, "_s").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(stratum).orderBy("_s")
    sums = shards.select(
        F.col(stratum).alias("_g"), F.col("_s").alias("_t"),
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(stratum)).alias("size"),
    )
    own = F.row_number().over(Window.partitionBy(stratum, "_s").orderBy("_h", entity))
    joined = keyed.withColumn("_own", own).join(sums, F.col(stratum).eqNullSafe(F.col("_g")) & (F.col("_s") == F.col("_t")))
    return joined.withColumn("place", F.col("_own") + F.col("_before")).drop("_h", "_s", "_own", "_g", "_t", "_before")


def stratified_split(entities: DataFrame, entity: str, stratum: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """(entity, stratum, split): in each stratum the rounded share `test` of the entities is test, the rest train."""
    placed = _place(entities, entity, stratum, seed)
    return placed.select(entity, stratum, F.when(F.col("place") <= F.floor(F.col("size") * test + 0.5), "test").otherwise("train").alias("split"))


def stratified_folds(entities: DataFrame, entity: str, stratum: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """(entity, stratum, fold): folds from 0, alike in every stratum."""
    return _place(entities, entity, stratum, seed).select(entity, stratum, F.pmod(F.col("place") - 1, F.lit(folds)).cast("int").alias("fold"))
