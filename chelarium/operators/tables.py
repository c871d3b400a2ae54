"""Assembly of the long tables: unpivot, lookups with a defined winner, coverage and profile aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chelarium.functions import exprs, vocab
from chelarium.operators.ranks import numbered

# Columns of the screening sheet and of both long tables.
SCREENING_RENAMES = {"ID-4": "id_4", "ID-6": "id_6", "Sequence..SP.Removed.": "sequence_sp_removed"}
TAXONOMY = ("phylum", "class", "order", "family", "genus")
SCREENING_COLUMNS = (
    "measurement_id", "variant_id", "source_organism", "sequence", "taxonomy", "ef_hand_count", "selectivity_cluster",
    "target_element", "value", "value_type", "source_paper",
)
LITERATURE_COLUMNS = (
    "measurement_id", "variant_id", "construct_type", "parent_scaffold", "source_organism", "sequence", "target_element", "value",
    "value_units", "value_type", "measurement_family", "is_molar_affinity_candidate", "value_in_molar", "conditions_pH",
    "conditions_notes", "value_source_type", "source_paper",
)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def rename_screening(df: DataFrame) -> DataFrame:
    """Columns of the screening sheet under plain names; `X` and `X.1` become the mean and deviation of element X."""
    names = SCREENING_RENAMES | {s: f"{s}_norm_logd" for s in vocab.SCREENED} | {f"{s}.1": f"{s}_norm_logd_sd" for s in vocab.SCREENED}
    return df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns))


def screening_variants(sheet: DataFrame, source_paper: str) -> DataFrame:
    """Variant records of the renamed sheet; rows without sequence, organism or whole number id are left out."""
    need = [*("id_6", "sequence_sp_removed", "source_original", "EFhands", "agglomerative_cluster"), *(f"{s}_norm_logd" for s in vocab.SCREENED)]
    if gone := missing_columns(sheet, need):
        raise ValueError(f"columns are missing: {gone}")
    parts = {t: f"{t}_original" for t in TAXONOMY if f"{t}_original" in sheet.columns}
    return sheet.select(
        F.concat(F.lit("o-"), exprs.safe_int("id_6").cast("string")).alias("variant_id"),
        exprs.clean_cell("source_original").alias("source_organism"),
        exprs.clean_cell("sequence_sp_removed").alias("sequence"),
        exprs.taxonomy_text(parts).alias("taxonomy"),
        exprs.safe_int("EFhands").alias("ef_hand_count"),
        exprs.safe_int("agglomerative_cluster").alias("selectivity_cluster"),
        F.lit("ortholog").alias("construct_type"),
        F.lit("Lanmodulin").alias("parent_scaffold"),
        F.lit(source_paper).alias("source_paper"),
        *(F.col(f"{s}_norm_logd").cast("double").alias(s) for s in vocab.SCREENED),
    ).where("variant_id IS NOT NULL AND source_organism IS NOT NULL AND sequence IS NOT NULL")


def unpivot_measures(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per id row and filled measure column, in column order of no meaning; null and NaN cells give none."""
    return df.unpivot(ids, columns, name, value).where(F.col(value).isNotNull() & ~F.isnan(value))


def screening_long(variants: DataFrame) -> DataFrame:
    """The long screening table: one row per variant and measured element, numbered in sheet column order per variant."""
    ids = [c for c in variants.columns if c not in vocab.SCREENED]
    long = unpivot_measures(variants, ids, list(vocab.SCREENED), "symbol", "value")
    order = {s: i for i, s in enumerate(vocab.SCREENED)}
    long = long.withColumn("target_element", exprs.choose(F.col("symbol"), vocab.TRIVALENT)).withColumn("place", exprs.choose(F.col("symbol"), order)).withColumn("value_type", F.lit("normalized_logD"))
    return numbered(long, ["variant_id", "place"], "measurement_id", "moesm3_", 5).select(*SCREENING_COLUMNS)


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last in the given order, found by an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def left_lookup(facts: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """facts with the columns of dimension (one row per key); no match gives nulls."""
    return facts.join(dimension, keys, "left")


def literature_long(extractions: DataFrame) -> DataFrame:
    """The long literature table of (paper_id, variants, measurements, notes) documents.

    Measurements are numbered by paper and place before they are sorted; each finds the last variant of its paper
    with its id.
    """
    variants = extractions.select("paper_id", F.posexplode("variants").alias("vpos", "v"))
    v = latest_wins(variants.select("paper_id", F.col("v.variant_id").alias("variant_id"), "vpos", *(F.col(f"v.{c}").alias(c) for c in ("construct_type", "parent_scaffold", "source_organism", "sequence"))), ["paper_id", "variant_id"], [F.col("vpos")]).drop("vpos")
    m = numbered(extractions.select("paper_id", F.posexplode("measurements").alias("pos", "m")), ["paper_id", "pos"], "measurement_id", "lit_", 4)
    flat = m.select("measurement_id", "paper_id", "m.*").withColumnsRenamed({"units": "value_units", "measurement_type": "value_type"})
    full = left_lookup(flat, v, ["paper_id", "variant_id"])
    return full.withColumn("measurement_family", exprs.measurement_family("value_type")).withColumn(
        "is_molar_affinity_candidate", exprs.is_affinity_candidate("value_type", "value_in_molar")
    ).select(*LITERATURE_COLUMNS)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """(column, n_rows), most frequent first, null counted; the first `top` if given."""
    out = df.groupBy(column).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), F.asc_nulls_last(column))
    return out.limit(top) if top else out


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_rows, n_filled, share): how many rows have a value in each column, in one pass."""
    counts = df.agg(F.count("*").alias("n"), *(F.count(F.when(F.col(c).isNotNull() & (F.lit(True) if t not in ("double", "float") else ~F.isnan(c)), 1)).alias(f"_{i}") for i, (c, t) in enumerate((c, dict(df.dtypes)[c]) for c in columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"_{i}").alias("n_filled")) for i, c in enumerate(columns))))
    return counts.select(rows.alias("r")).select("r.*", F.try_divide(F.col("r.n_filled"), F.col("r.n_rows")).alias("share"))


def saturation_profile(df: DataFrame, group: str, value: str, high: float = 0.95, full: float = 1.0) -> DataFrame:
    """Per group: rows, mean, deviation, shares at or above `high` and equal to `full`, median and upper quartile."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.avg((v >= high).cast("int")).alias("share_high"), F.avg((v == full).cast("int")).alias("share_full"),
        F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.75)).alias("p75"),
    )


def strict_tier(df: DataFrame, excluded: tuple[str, ...] = vocab.EXCLUDED_PAPERS) -> DataFrame:
    """The rows of headline comparisons: affinity candidates measured by the source itself, of no excluded source and not of calcium.

    A null source or element is neither excluded nor calcium; calcium counts in every spelling.
    """
    source, element = F.coalesce("source_paper", F.lit("")), F.coalesce(exprs.element_name("target_element"), F.lit(""))
    return df.where(F.col("is_molar_affinity_candidate") & (F.col("value_source_type") == "primary") & ~source.isin(*excluded) & (element != "Calcium"))


def changed_rows(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n_changed): rows whose two columns differ, null being equal to null."""
    return df.agg(F.coalesce(F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")), F.lit(0)).alias("n_changed"))


def first_rank(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """Rank 1.. within small groups (the predictions of one sequence); ties go by the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))
