"""The feature matrix: sequence features once per distinct sequence, element features by broadcast, encoded and aligned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chelarium.functions import exprs, protein, vocab
from chelarium.operators import encode, quality
from chelarium.session import settle

METADATA = ("measurement_id", "variant_id", "target_element", "selectivity_cluster", "value", "split")
CATEGORICAL = tuple(f"ef{k}_motif_pos{p}" for k in range(1, protein.SHOWN_MOTIFS + 1) for p in protein.MOTIF_PLACES)
# Names in the frozen schema that differ from those of the expressions.
FROZEN_NAMES = {"pct_d": "pct_D", "pct_e": "pct_E", "pct_n": "pct_N", "pct_t": "pct_T", "pct_k": "pct_K", "pct_r": "pct_R", "charge_at_ph7": "charge_at_pH7", "ionic_radius_pm": "ionic_radius_pm_cn8", "charge_density": "charge_density_z_per_pm3"}
ABSENT_NUMBER = -1.0
INSTABILITY = "instability_index"


def sequence_features(df: DataFrame, column: str = "sequence", weights: dict[str, float] | None = None) -> DataFrame:
    """(column, features): one row per distinct canonical sequence; sequences with other letters have none.

    weights: of the instability index, by dipeptide; without them that feature is left out.
    """
    seq = F.upper(exprs.strip(column))
    distinct = df.select(F.col(column), seq.alias("_s")).where(F.col("_s").rlike(f"^[{protein.CANONICAL}]+$")).distinct()
    with_hits = distinct.withColumn("_h", protein.motifs(F.col("_s")))
    made = protein.sequence_numbers(F.col("_s")) | protein.motif_letters(F.col("_h")) | protein.motif_numbers(F.col("_h"), F.col("_s"))
    if weights:
        made[INSTABILITY] = protein.instability(F.col("_s"), weights)
    named = {f"ef{k}_pos{p}": f"ef{k}_motif_pos{p}" for k in range(1, protein.SHOWN_MOTIFS + 1) for p in protein.MOTIF_PLACES} | FROZEN_NAMES
    return with_hits.select(column, *(c.alias(named.get(n, n)) for n, c in made.items()))


def numeric_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in CATEGORICAL and c != "sequence"]


def feature_rows(measurements: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """measurements (sequence, target_element, ...) with all raw features. A row without a canonical sequence or with an unknown
    element is an error; see left_out for those rows."""
    elements = _elements(measurements)
    quality.require_empty(left_out(measurements).select(F.concat_ws(": ", "reason", "target_element", F.substring("sequence", 1, 20)).alias("bad")).distinct(), "rows that have no features", "bad")
    # 17 rows
    per_sequence = settle(sequence_features(measurements.select("sequence"), weights=weights))
    return measurements.join(per_sequence, "sequence").join(F.broadcast(elements), "target_element")


def _elements(df: DataFrame) -> DataFrame:
    return exprs.element_table(df.sparkSession).withColumnRenamed("element", "target_element").withColumnsRenamed(FROZEN_NAMES)


def left_out(measurements: DataFrame) -> DataFrame:
    """measurements that have no features, with `reason`: no_sequence, bad_alphabet or unknown_element."""
    seq = F.upper(exprs.strip("sequence"))
    reason = (
        F.when(F.coalesce(seq, F.lit("")) == "", "no_sequence")
        .when(~seq.rlike(f"^[{protein.CANONICAL}]+$"), "bad_alphabet")
        .when(~F.coalesce(F.col("target_element").isin(*(e[0] for e in vocab.ELEMENTS)), F.lit(False)), "unknown_element")
    )
    return measurements.withColumn("reason", reason).where("reason IS NOT NULL")


def build_matrix(measurements: DataFrame, weights: dict[str, float] | None = None) -> tuple[DataFrame, dict[str, list[str]], list[str]]:
    """(matrix, categories, feature names): metadata and encoded features; categories come from the training split only."""
    # read several times below and by every later fit
    rows = settle(feature_rows(measurements, weights))
    quality.require_empty(rows.where("split IS NULL"), "variants without a split", "variant_id")
    categories = encode.fit_categories(rows.where("split = 'train'"), list(CATEGORICAL))
    numerics = [c for c in rows.columns if c not in METADATA and c not in CATEGORICAL and c != "sequence"]
    encoded = encode.encode(rows, categories, numerics)
    names = [f"{c}_{v}" for c, vs in categories.items() for v in vs] + numerics
    return encode.align(encoded, names, [c for c in METADATA if c in encoded.columns]), categories, names


def profile_rows(sequences: DataFrame, categories: dict[str, list[str]], names: list[str], elements: tuple[str, ...], weights: dict[str, float] | None = None) -> DataFrame:
    """sequences (seq_id, sequence) by every element, with features as in training: same functions, frozen categories, aligned.

    Invalid sequences stay out; see protein.validated_sequence for why. weights: those of the training matrix, if it had any.
    """
    if (INSTABILITY in names) != bool(weights):
        raise ValueError(f"{INSTABILITY} needs the weights of the training matrix, and only if that has it")
    spark = sequences.sparkSession
    if unknown := sorted(set(elements) - {e[0] for e in vocab.ELEMENTS}):
        raise ValueError(f"unknown elements: {unknown}")
    checked = sequences.withColumn("_v", protein.validated_sequence("sequence")).where("_v.is_valid").select("seq_id", F.col("_v.sequence").alias("sequence"))
    listed = spark.createDataFrame([(e, i) for i, e in enumerate(elements)], "target_element string, element_place int").join(_elements(sequences), "target_element")
    per_sequence = settle(sequence_features(checked.select("sequence"), weights=weights))
    # a sequence by the listed elements, 17 at most, is the wanted result
    rows = checked.join(per_sequence, "sequence").crossJoin(F.broadcast(listed))
    numerics = [c for c in rows.columns if c not in ("seq_id", "sequence", "target_element", "element_place") and c not in CATEGORICAL]
    return encode.align(encode.encode(rows, categories, numerics), names, ["seq_id", "target_element", "element_place"])
