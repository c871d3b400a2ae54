"""Repair of nested extractions: canonical ids, parents for orphans, merged duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chelarium.functions import exprs
from chelarium.session import settle

LONGEST = ("source_organism", "sequence", "taxonomy", "notes")
FIRST_FILLED = ("parent_variant_id", "mutation_notation", "ef_hand_count", "selectivity_cluster")
EARLIEST = ("construct_type", "parent_scaffold", "source_paper")


def merge_aggregates(pos: str, columns: list[str]) -> list[Column]:
    """How the fields of duplicate records merge: the longest text, the first filled value, the earliest, all mutations in order."""
    p = F.col(pos)
    out = []
    for c in columns:
        v = F.col(c)
        if c in LONGEST:
            out.append(F.max_by(v, F.when(F.length(v) > 0, F.struct(F.length(v), -p))).alias(c))
        elif c in FIRST_FILLED:
            out.append(F.min_by(v, F.when(v.isNotNull(), p)).alias(c))
        elif c == "mutations":
            lists = F.array_sort(F.collect_list(F.struct(p.alias("p"), F.coalesce(v, F.array().cast("array<string>")).alias("m"))))
            out.append(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["m"]))).alias(c))
        elif c in EARLIEST:
            out.append(F.min_by(F.struct(v), p).getField(c).alias(c))
    return out


def merge_duplicates(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One record per key. pos must differ within a key; an empty text counts as no text, no text at all gives null.

    Only `mutations` are gathered, one short list per record; a key holds the repeats of one variant in one paper.
    """
    fields = [c for c in df.columns if c in (*LONGEST, *FIRST_FILLED, *EARLIEST, "mutations")]
    return df.groupBy(*keys).agg(*merge_aggregates(pos, fields), F.count("*").alias("n_records"))


def enriched_names(*frames: tuple[DataFrame, str]) -> DataFrame:
    """(raw, e): every distinct name once, read once and kept, as names are few beside the records that use them."""
    names = reduce(lambda a, b: a.unionByName(b), [df.select(F.col(c).alias("raw")) for df, c in frames]).distinct()
    return settle(exprs.with_enriched_variant(names, "raw", "e"))


def enrich_variants(variants: DataFrame, names: DataFrame) -> DataFrame:
    """variants (paper_id, pos, variant_id, ...) with their old id as raw_id and canonical id, class and scaffold; dropped names are gone."""
    e = variants.withColumnRenamed("variant_id", "raw_id").join(names.withColumnRenamed("raw", "raw_id").where("e.canonical_id IS NOT NULL"), "raw_id")
    return e.withColumns({"variant_id": F.col("e.canonical_id"), "construct_type": F.col("e.construct_type"), "parent_scaffold": F.col("e.parent_scaffold")}).drop("e")


def enrich_measurements(measurements: DataFrame, enriched: DataFrame, names: DataFrame) -> DataFrame:
    """measurements with the canonical id that their paper gave the name, else the name's own; dropped names are gone."""
    given = enriched.groupBy("paper_id", "raw_id").agg(F.min("variant_id").alias("_given"))
    m = measurements.withColumnRenamed("variant_id", "raw_id").join(given, ["paper_id", "raw_id"], "left")
    m = m.join(names.select(F.col("raw").alias("raw_id"), F.col("e.canonical_id").alias("_own")), "raw_id", "left")
    return m.withColumn("variant_id", F.coalesce("_given", "_own")).where("variant_id IS NOT NULL").drop("_given", "_own")


def created_parents(measurements: DataFrame, enriched: DataFrame, names: DataFrame) -> DataFrame:
    """(paper_id, variant_id, construct_type, parent_scaffold): variants that a paper measures but does not list."""
    orphans = measurements.select("paper_id", "variant_id", "raw_id").join(enriched.select("paper_id", "variant_id"), ["paper_id", "variant_id"], "left_anti")
    e = orphans.join(names.withColumnRenamed("raw", "raw_id"), "raw_id")
    return e.groupBy("paper_id", "variant_id").agg(F.min("e.construct_type").alias("construct_type"), F.min("e.parent_scaffold").alias("parent_scaffold"))


def repair(variants: DataFrame, measurements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, measurements) after enrichment, with parents for orphans and duplicates merged."""
    names = enriched_names((variants, "variant_id"), (measurements, "variant_id"))
    v = enrich_variants(variants, names)
    m = enrich_measurements(measurements, v, names)
    # no listed variant has the key of a created one, so their place decides nothing
    made = created_parents(m, v, names).withColumns({"source_organism": F.lit("(auto-created from measurement)"), "pos": F.lit(0), "source_paper": F.col("paper_id")})
    return merge_duplicates(v.drop("raw_id").unionByName(made, allowMissingColumns=True), ["paper_id", "variant_id"], "pos").drop("n_records"), m


def repair_counts(variants: DataFrame, measurements: DataFrame) -> DataFrame:
    """One row with the eight counters of a repair run."""
    names = enriched_names((variants, "variant_id"), (measurements, "variant_id"))
    v = enrich_variants(variants, names)
    m = enrich_measurements(measurements, v, names)
    n_in = variants.agg(F.count("*").alias("a"), F.count_distinct("paper_id").alias("papers"))
    n_v = v.agg(F.count("*").alias("b"), F.count_distinct("paper_id", "variant_id").alias("c"), F.coalesce(F.sum((F.col("raw_id") != F.col("variant_id")).cast("long")), F.lit(0)).alias("d"))
    n_m, n_all = m.agg(F.count("*").alias("e")), measurements.agg(F.count("*").alias("f"))
    n_made = created_parents(m, v, names).agg(F.count("*").alias("g"))
    one = n_in.crossJoin(n_v).crossJoin(n_m).crossJoin(n_all).crossJoin(n_made)  # one row each
    return one.select(
        F.col("papers").alias("papers_processed"), F.col("c").alias("variants_kept"), (F.col("a") - F.col("b")).alias("variants_dropped"),
        F.col("d").alias("variants_canonicalized"), F.col("g").alias("variants_auto_created"), (F.col("b") - F.col("c")).alias("variants_merged"),
        F.col("e").alias("measurements_kept"), (F.col("f") - F.col("e")).alias("measurements_dropped"),
    )
