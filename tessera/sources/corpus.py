"""Documents from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modified, text and source_hash of every file below a folder, each read whole."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return files.withColumn("source_hash", F.sha2("text", 256))
