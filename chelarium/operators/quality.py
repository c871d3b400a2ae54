"""Constraints as one pass: every row keeps its reasons, valid rows and rejects are filters of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelarium.functions import exprs, protein, vocab

SOURCE_TYPES = ("primary", "cited_from_earlier_work")


def variant_rules() -> dict[str, Column]:
    """Name of each rule on a variant record and the condition that breaks it."""
    seq = F.upper(exprs.strip("sequence"))
    return {
        "no_id": exprs.clean_cell("variant_id").isNull(),
        "no_organism": exprs.clean_cell("source_organism").isNull(),
        "short_sequence": F.length("sequence") < 10,
        "bad_alphabet": ~seq.rlike(f"^[{protein.CANONICAL}]*$"),
        "ef_hand_count_range": ~F.col("ef_hand_count").between(0, 10),
        "cluster_range": ~F.col("selectivity_cluster").between(0, 10),
        "unknown_construct": ~F.coalesce(F.col("construct_type").isin(*vocab.CONSTRUCT_TYPES), F.lit(False)),
        "blank_scaffold": F.col("parent_scaffold").isNotNull() & exprs.clean_cell("parent_scaffold").isNull(),
    }


def measurement_rules() -> dict[str, Column]:
    """Name of each rule on a measurement record and the condition that breaks it."""
    molar, ph = F.col("value_in_molar"), F.col("conditions_ph")
    given = lambda c: c.isNotNull() & ~F.isnan(c)
    return {
        "no_id": exprs.clean_cell("variant_id").isNull(),
        "no_value": F.col("value").isNull() | F.isnan("value"),
        "element_group": exprs.is_element_group("target_element"),
        "unknown_element": exprs.element_name("target_element").isNull() & ~exprs.is_element_group("target_element"),
        "molar_range": given(molar) & ~((molar > 0) & (molar < 1e-2)),
        "ph_range": given(ph) & ~((ph > 0) & (ph < 14)),
        "unknown_source_type": ~F.coalesce(F.col("value_source_type").isin(*SOURCE_TYPES), F.lit(False)),
    }


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `reasons`: the names of the rules a row breaks, empty for a valid row."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items()))))


def valid_and_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    c = checked(df, rules)
    return c.where(F.size("reasons") == 0).drop("reasons"), c.where(F.size("reasons") > 0)


def reject_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(reason, n_rows) of all broken rules."""
    return checked(df, rules).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


def groups_in_several(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, n_splits): keys with rows in more than one split; null splits don't count."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def unmatched(facts: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of facts that dimension lacks."""
    return facts.select(*keys).distinct().join(dimension, keys, "left_anti")


def require_empty(df: DataFrame, what: str, column: str, shown: int = 20) -> None:
    """Raises with the first values in order if there is any row."""
    bad = [str(r[0]) for r in df.select(column).orderBy(column).limit(shown).collect()]
    if bad:
        raise ValueError(f"{what}: {bad}")
