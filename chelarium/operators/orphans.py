"""References to records that do not exist: run-compressed parent keys and an as-of match.

Parent ids are read as (stem, integer): the trailing digits without leading zeros are the integer.
Sorted integers of a stem are compressed into contiguous runs; every distinct reference is matched
as of the preceding run start and is an orphan when it lies beyond that run's end. References inside
a run are then held against the time their parent existed.

Scale: references are reduced to distinct ids with a map-side combine before anything is sorted, so a
hot id costs one row. The sort key is cut into blocks of BLOCK integers, which bounds every window
group by twice BLOCK rows. Rows of hot ids meet the verdicts through a broadcast whose size is bounded
by HOT_IDS (an id is hot if it holds 1/HOT_IDS of all rows), other rows through a shuffle join whose
keys are, for the same reason, never large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelarium.functions.ids import id_key

BLOCK = 1 << 16
HOT_IDS = 2000

_TAIL = "([1-9][0-9]{0,17}|0)$"


def split_key(key: Column) -> tuple[Column, Column, Column]:
    """(stem, integer, block) of a canonical key; a key without trailing digits is a stem with integer -1."""
    digits = F.regexp_extract(key, _TAIL, 1)
    has = digits != ""
    stem = F.when(has, F.concat(F.lit("#"), F.regexp_replace(key, _TAIL, ""))).otherwise(key)
    n = F.when(has, digits.cast("long")).otherwise(F.lit(-1).cast("long"))
    return stem, n, F.floor(n / BLOCK).cast("long")


def parent_lifetimes(parents: DataFrame, key: str, loaded: str, deleted: str) -> DataFrame:
    """(id, born, dead): one row per parent id, present from born until, exclusively, dead (null: for ever)."""
    return (
        parents.select(id_key(key).alias("id"), F.col(loaded).alias("l"), F.col(deleted).alias("d"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("l").alias("born"), F.min("d").alias("dead"))
    )


def key_runs(ids: DataFrame) -> DataFrame:
    """(stem, block, start, end): maximal runs of contiguous integers among distinct ids, cut at blocks."""
    stem, n, block = split_key(F.col("id"))
    keyed = ids.select(stem.alias("stem"), n.alias("n"), block.alias("block"))
    w = Window.partitionBy("stem", "block").orderBy("n")
    return (
        keyed.withColumn("island", F.col("n") - F.row_number().over(w))
        .groupBy("stem", "block", "island")
        .agg(F.min("n").alias("start"), F.max("n").alias("end"))
        .drop("island")
    )


def match_runs(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """ids (distinct, column id, others kept) with `beyond`: true where no run covers the id."""
    stem, n, block = split_key(F.col("id"))
    rest = [c for c in ids.columns]
    refs = ids.select(stem.alias("stem"), block.alias("block"), n.alias("n"), F.lit(None).cast("long").alias("end"), F.struct(*rest).alias("ref"))
    starts = runs.select("stem", "block", F.col("start").alias("n"), "end", F.lit(None).cast(refs.schema["ref"].dataType).alias("ref"))
    w = Window.partitionBy("stem", "block").orderBy("n", F.col("end").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        refs.unionByName(starts)
        .withColumn("run_end", F.last("end", ignorenulls=True).over(w))
        .where("ref IS NOT NULL")
        .select("ref.*", (F.col("run_end").isNull() | (F.col("n") > F.col("run_end"))).alias("beyond"))
    )


def find_orphans(refs: DataFrame, parents: DataFrame, parent_key: str, loaded: str, deleted: str, total: int) -> DataFrame:
    """(src_table, row_id, reason, load_month): the rows of refs whose id names no parent present at loaded_at.

    refs: src_table string, row_id bigint, ref string, loaded_at timestamp. total: about the number of rows of refs.
    reason: `missing` (no such parent), `late` (loaded before the parent), `deleted`.
    Null, blank and placeholder references name nothing and give no row. A row without loaded_at can only be
    `missing`, its month is null. A parent without any loaded_at counts as present from the beginning. Repeated
    rows come out as often as they go in. Either side may be empty. Other columns are not looked at.
    """
    rows = refs.select("src_table", "row_id", id_key("ref").alias("id"), "loaded_at").where("id IS NOT NULL")
    lives = parent_lifetimes(parents, parent_key, loaded, deleted)
    distinct = rows.groupBy("id").agg(F.min("loaded_at").alias("first"), F.max("loaded_at").alias("last"), F.count("*").alias("n_rows"))
    matched = match_runs(distinct, key_runs(lives.select("id")))
    suspects = (
        matched.join(lives, "id", "left")
        .where(F.col("beyond") | (F.col("first") < F.col("born")) | (F.col("last") >= F.col("dead")))
        .select("id", "beyond", "born", "dead", "n_rows")
    )
    hot = F.col("n_rows") >= max(1000, total // HOT_IDS)
    parts = [
        rows.join(F.broadcast(suspects.where(hot)), "id"),
        rows.join(suspects.where(~hot), "id"),
    ]
    reason = (
        F.when(F.col("beyond"), "missing")
        .when(F.col("loaded_at") < F.col("born"), "late")
        .when(F.col("loaded_at") >= F.col("dead"), "deleted")
    )
    out = [
        p.select("src_table", "row_id", reason.alias("reason"), F.date_format("loaded_at", "yyyy-MM").alias("load_month")).where("reason IS NOT NULL")
        for p in parts
    ]
    return out[0].unionByName(out[1])


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month and reason."""
    return orphans.groupBy("src_table", "load_month", "reason").agg(F.count("*").alias("n_rows"))
