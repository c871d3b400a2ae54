"""Frozen one-hot encoding: categories are fitted on training rows only and kept as plain data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING = "MISSING"
MAX_CATEGORIES = 1000


def fit_categories(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """Sorted categories of each column, null as MISSING; refuses an empty table and columns that are no categories."""
    filled = [F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).alias(c) for c in columns]
    distinct = train.agg(*(F.approx_count_distinct(c).alias(c) for c in columns), F.count("*").alias("n_")).first()
    if not distinct["n_"]:
        raise ValueError("cannot fit on an empty table")
    if wide := [c for c in columns if distinct[c] > MAX_CATEGORIES]:
        raise ValueError(f"too many categories: {wide}")
    row = train.agg(*filled).first()
    return {c: sorted(row[c]) for c in columns}


def one_hot(categories: dict[str, list[str]]) -> list[Column]:
    """A 0/1 column per frozen category, named column_category; an unseen value gives zeros throughout."""
    return [F.when(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, vs in categories.items() for v in vs]


def encode(df: DataFrame, categories: dict[str, list[str]], numerics: list[str]) -> DataFrame:
    """Encoded columns, then the numeric ones; other columns first."""
    kept = [c for c in df.columns if c not in categories and c not in numerics]
    return df.select(*kept, *one_hot(categories), *numerics)


def align(df: DataFrame, names: list[str], kept: list[str]) -> DataFrame:
    """kept columns, then exactly the frozen names in their order: absent ones are 0, others are gone."""
    return df.select(*kept, *(F.col(f"`{c}`").cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in names))
