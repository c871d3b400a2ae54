"""Ranks and rank correlations that hold for groups of any size.

A rank needs the order of a whole group, which may be a third of all rows. Values are first reduced to counts
per distinct value, then range-partitioned; each partition ranks its own values and adds the rows of the
partitions before it, of which only one total per partition and group is moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chelarium.session import settle


def average_ranks(df: DataFrame, group: str, x: str) -> DataFrame:
    """(group, x, rank, times): the average rank of each distinct x within its group; equal values share it.

    Rows with a null or NaN x are left out, a null group is a group. An empty table gives no row.
    """
    counted = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(group, x).agg(F.count("*").alias("times"))
    parts = settle(counted.repartitionByRange(F.col(group), F.col(x)).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(group, "part").agg(F.sum("times").alias("held")).withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0)))
    within = Window.partitionBy("part", group).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("upto", F.sum("times").over(within))
    o = offsets.select(F.col(group).alias("_g"), F.col("part").alias("_p"), "offset")
    joined = ranked.join(o, (F.col("part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(group, x, (F.col("offset") + F.col("upto") - (F.col("times") - 1) / 2).alias("rank"), "times")


def grouped_spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, n, rho): rank correlation of x and y per group over rows that have both.

    rho is null for groups of fewer than two rows and for those where x or y is constant.
    """
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double")))
    pairs = settle(rows.groupBy(group, x, y).agg(F.count("*").alias("k")))
    expand = rows.select(group, x, y)
    rank = lambda c, out: average_ranks(expand, group, c).select(F.col(group).alias("_g"), F.col(c).alias("_v"), F.col("rank").alias(out))
    both = pairs
    for c, out in ((x, "rx"), (y, "ry")):
        r = rank(c, out)
        both = both.join(r, (F.col(c) == F.col("_v")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_g", "_v")
    sizes = pairs.groupBy(F.col(group).alias("_g")).agg(F.sum("k").alias("n"))
    k, mean = F.col("k"), (F.col("n") + 1) / 2
    dx, dy = F.col("rx") - mean, F.col("ry") - mean
    out = (
        both.join(sizes, F.col(group).eqNullSafe(F.col("_g")))
        .groupBy(group)
        .agg(F.max("n").alias("n"), F.sum(k * dx * dy).alias("xy"), F.sum(k * dx * dx).alias("xx"), F.sum(k * dy * dy).alias("yy"))
    )
    return out.select(group, "n", F.when(F.col("n") > 1, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))).alias("rho"))


def macro_spearman(per_group: DataFrame) -> DataFrame:
    """(macro_rho, n_groups, n_skipped): unweighted mean of the groups' rho; groups without one are skipped."""
    return per_group.agg(F.avg("rho").alias("macro_rho"), F.count("rho").alias("n_groups"), F.count(F.when(F.col("rho").isNull(), 1)).alias("n_skipped"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """(n, rmse, mae, r2) over rows that have both; r2 is 1 or 0 for a constant y with or without residuals of zero."""
    e = F.col(y) - F.col(p)
    a = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("var")
    )
    flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    return a.select("n", F.sqrt("mse").alias("rmse"), "mae", F.when(F.col("var") > 0, 1 - F.try_divide(F.col("mse"), F.col("var"))).when(F.col("n") > 0, flat).alias("r2"))


def numbered(df: DataFrame, order: list[str], name: str, prefix: str, digits: int) -> DataFrame:
    """df with `name`: prefix and a running number from 1 in the given total order, without one task holding all rows.

    Rows are range-partitioned by the order; each partition numbers its own and adds the sizes of those before it.
    """
    parts = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    held = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    offsets = held.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_row", within).join(offsets, "_part").withColumn(name, F.format_string(f"{prefix}%0{digits}d", F.col("_row") + F.col("_before"))).drop("_part", "_row", "_before")
