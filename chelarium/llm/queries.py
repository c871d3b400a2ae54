"""Queries of the text and corpus problems (p4-p9) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelarium.llm import encoding, leakage, neardup, overlap, reading, residues, splits
from chelarium.llm.queries_sql import ORACLES  # noqa: F401
from chelarium.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _variant_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residues.variant_residues(table(spark, sf_dir, "protein_variants")).select(F.col("variant_id").alias("id"), "residues")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_variant_residues(spark, sf_dir)).select(F.col("id_a").alias("variant_id_a"), F.col("id_b").alias("variant_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicate_summary(_variant_residues(spark, sf_dir)).withColumnRenamed("id", "variant_id")


_LINKS = ["source_paper", "submitter"]


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "ml_ready_features")
    return rows, settle(splits.entity_names(rows, "variant_id", table(spark, sf_dir, "protein_variants")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _features(spark, sf_dir)
    return splits.linked_groups(rows, "variant_id", _LINKS, names).select(F.col("name").alias("variant_id"), "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, names = _features(spark, sf_dir)
    return splits.split_groups(rows, "variant_id", _LINKS, "selectivity_cluster", names).withColumnRenamed("name", "variant_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, sf_dir, "ml_ready_features"), table(spark, sf_dir, "protein_variants"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(p6_found(spark, sf_dir), table(spark, sf_dir, "ml_ready_features"))


def p6_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked record with the fraction of its residues that a training record covers."""
    return overlap.covered_records(table(spark, sf_dir, "ml_ready_features"), table(spark, sf_dir, "protein_variants"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("item_id", "doc_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found in documents where up to two letters of the passage may have been put in, left out or changed."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), edits=2)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per suite: items, leaked items, and the documents that hold them."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    held = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.join(held, "item_id", "left").groupBy("suite").agg(F.count("*").alias("n_items"), F.count("n_docs").alias("n_leaked"), F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_links"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per source and level."""
    source = table(spark, sf_dir, "documents").select("doc_id", "source")
    return p9_found(spark, sf_dir).join(source, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("n_docs"))


QUERIES = {
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p6_found": p6_found,
    "p6_report": p6_report,
    "p6_covered": p6_covered,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_near": p8_near,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_profile": p9_profile,
}


