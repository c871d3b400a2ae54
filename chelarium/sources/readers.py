"""Sources and sinks: text corpora, extraction documents, long tables, feature matrices, tuning results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chelarium.functions import exprs
from chelarium.session import exists

# Files beside the papers that are none.
SKIPPED_TEXTS = (".gitkeep", ".ds_store", "readme.md", "prompt.md")

VARIANT = (
    "struct<variant_id:string,source_organism:string,sequence:string,parent_variant_id:string,mutations:array<string>,"
    "mutation_notation:string,taxonomy:string,ef_hand_count:int,selectivity_cluster:int,construct_type:string,"
    "parent_scaffold:string,notes:string,source_paper:string>"
)
MEASUREMENT = (
    "struct<variant_id:string,target_element:string,measurement_type:string,value:double,units:string,value_in_molar:double,"
    "conditions_pH:double,conditions_notes:string,value_source_type:string,source_paper:string>"
)
EXTRACTION = f"variants array<{VARIANT}>, measurements array<{MEASUREMENT}>, notes string"


def _stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def read_corpus(spark: SparkSession, folder: str, skipped: tuple[str, ...] = SKIPPED_TEXTS) -> DataFrame:
    """(paper_id, text): every .txt file of a folder whole and stripped; hidden, skipped and empty files are left out."""
    name = F.col("_metadata.file_name")
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[tT][xX][tT]").select(_stem().alias("paper_id"), name.alias("file"), exprs.strip("value").alias("text"))
    return raw.where(~F.lower("file").isin(*skipped) & ~F.col("file").startswith(".") & (F.col("text") != "")).select("paper_id", "text")


def list_corpus(spark: SparkSession, folder: str, skipped: tuple[str, ...] = SKIPPED_TEXTS) -> DataFrame:
    """(paper_id, n_bytes) of the same files, the empty ones included, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return files.where(~F.lower("file").isin(*skipped) & ~F.col("file").startswith(".")).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("paper_id"), F.col("length").alias("n_bytes"))


def read_extractions(spark: SparkSession, folder: str) -> DataFrame:
    """(paper_id, variants, measurements, notes): one document per JSON file, missing lists are empty; a missing folder has no documents."""
    if not exists(spark, folder):
        return spark.createDataFrame([], f"paper_id string, {EXTRACTION}")
    raw = spark.read.schema(EXTRACTION).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return raw.select(
        _stem().alias("paper_id"),
        F.coalesce("variants", F.array().cast(f"array<{VARIANT}>")).alias("variants"),
        F.coalesce("measurements", F.array().cast(f"array<{MEASUREMENT}>")).alias("measurements"),
        "notes",
    )


def write_extractions(extractions: DataFrame, folder: str) -> int:
    """One folder per paper with its document as JSON; returns the number of papers."""
    extractions.write.mode("overwrite").partitionBy("paper_id").json(folder)
    return extractions.select("paper_id").distinct().count()


def write_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each given table as CSV with a header below folder; returns the paths."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{folder}/{name}"
        df.write.mode("overwrite").option("header", True).option("escape", '"').csv(out[name])
    return out


def write_matrix(matrix: DataFrame, categories: dict[str, list[str]], names: list[str], folder: str) -> None:
    """The matrix as parquet with its frozen schema and categories as plain JSON beside it; refuses an empty matrix."""
    if matrix.isEmpty():
        raise ValueError("refusing to save an empty matrix")
    matrix.write.mode("overwrite").parquet(f"{folder}/matrix")
    about = json.dumps({"features": names, "categories": categories})
    matrix.sparkSession.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/schema")


def read_matrix(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, list[str]], list[str]]:
    held = json.loads(spark.read.text(f"{folder}/schema").first()["value"])
    matrix = spark.read.parquet(f"{folder}/matrix")
    if gone := sorted(set(held["features"]) - set(matrix.columns)):
        raise ValueError(f"the matrix lacks {gone}")
    return matrix, held["categories"], held["features"]

