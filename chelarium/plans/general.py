"""Queries of the general data problems (p1-p3) over the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelarium.functions.ids import id_key_sql
from chelarium.operators import nested, orphans, units
from chelarium.session import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.shred(table(spark, sf_dir, "paper_extractions"), "extraction_id", "payload")


_FLAT = "kind IN ({})".format(", ".join(f"'{k}'" for k in nested.KINDS.values()))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.link_nodes(_p1_nodes(spark, sf_dir), _FLAT).select("extraction_id", "kind", "parent_pos", "pos", "item")


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object of every document with its interval and the object around it."""
    return nested.link_nodes(_p1_nodes(spark, sf_dir)).select("extraction_id", "kind", "pre", "post", "level", "pos", "parent_kind", "parent_pre")


def p1_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat variant table."""
    rows = nested.link_nodes(_p1_nodes(spark, sf_dir), _FLAT).where("kind = 'variant'")
    return rows.select("extraction_id", "pre", "post", "pos", "variant_id")


def p1_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat mutation table, each row with its place and parent variant."""
    rows = nested.link_nodes(_p1_nodes(spark, sf_dir), _FLAT).where("kind = 'mutation'")
    return rows.select("extraction_id", "pre", "pos", "parent_pre", "parent_pos", F.col("item").alias("mutation"))


def p1_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat measurement table, each row with its document, place and parent variant."""
    rows = nested.link_nodes(_p1_nodes(spark, sf_dir), _FLAT).where("kind = 'measurement'")
    return rows.select("extraction_id", "pre", "pos", "parent_pos", F.col("item").alias("target_element"), "variant_id", "value", "units")


def p1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads without a complete document, with the reason."""
    return nested.unreadable(table(spark, sf_dir, "paper_extractions"), "extraction_id", "payload")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.wrong_molar(units.to_common_unit(table(spark, sf_dir, "literature_binding_data")))


def p2_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversion found for every unit notation, with the number of links that speak for it."""
    return units.conversions(settle(units.read_notations(table(spark, sf_dir, "literature_binding_data"))))


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    m, v = table(spark, sf_dir, "binding_measurements"), table(spark, sf_dir, "protein_variants")
    refs = m.select(F.lit("binding_measurements").alias("src_table"), "row_id", F.col("variant_id").alias("ref"), "loaded_at").unionByName(
        v.select(F.lit("protein_variants").alias("src_table"), F.col("record_id").alias("row_id"), F.col("parent_variant_id").alias("ref"), "loaded_at")
    )
    return refs, v, m.count() + v.count()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, v, total = _references(spark, sf_dir)
    return orphans.find_orphans(refs, v, "variant_id", "loaded_at", "deleted_at", total)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(p3_found(spark, sf_dir))


QUERIES = {
    "p1_found": p1_found,
    "p1_nodes": p1_nodes,
    "p1_variants": p1_variants,
    "p1_mutations": p1_mutations,
    "p1_measurements": p1_measurements,
    "p1_rejects": p1_rejects,
    "p2_found": p2_found,
    "p2_conversions": p2_conversions,
    "p3_found": p3_found,
    "p3_report": p3_report,
}

_P3 = f"""
WITH lives AS (
  SELECT {id_key_sql("variant_id")} AS id, min(loaded_at) AS born, min(deleted_at) AS dead
  FROM protein_variants GROUP BY 1),
refs AS (
  SELECT 'binding_measurements' AS src_table, row_id, {id_key_sql("variant_id")} AS id, loaded_at FROM binding_measurements
  UNION ALL
  SELECT 'protein_variants', record_id, {id_key_sql("parent_variant_id")}, loaded_at FROM protein_variants),
orphans AS (
  SELECT src_table, row_id,
    CASE WHEN l.id IS NULL THEN 'missing' WHEN loaded_at < born THEN 'late' WHEN loaded_at >= dead THEN 'deleted' END AS reason,
    strftime(loaded_at, '%Y-%m') AS load_month
  FROM refs r LEFT JOIN lives l ON r.id = l.id WHERE r.id IS NOT NULL)
"""

ORACLES = {
    "p2_found": units.P2_SQL,
    "p3_found": _P3 + "SELECT * FROM orphans WHERE reason IS NOT NULL",
    "p3_report": _P3 + "SELECT src_table, load_month, reason, count(*) AS n_rows FROM orphans WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
