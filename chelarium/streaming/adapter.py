"""Structured Streaming over arriving extraction documents: the batch transformations on a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chelarium.functions import exprs
from chelarium.sources.readers import EXTRACTION


def stream_measurements(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Flat, unit-normalised measurements of JSON documents as they arrive in a folder."""
    docs = spark.readStream.schema(EXTRACTION).option("multiLine", True).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    m = docs.select(F.explode("measurements").alias("m")).select("m.*")
    return m.withColumns(
        {
            "element": exprs.element_name("target_element"),
            "measurement_family": exprs.measurement_family("measurement_type"),
            "value_in_molar": exprs.to_molar("value", "units"),
        }
    )


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Starts a query that appends to parquet until all files there are read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
