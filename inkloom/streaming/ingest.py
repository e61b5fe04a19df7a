"""Structured Streaming: packages and paragraphs as they arrive. An extension; the batch plans are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.sources.docx import entities


def package_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Entities of packages that are dropped into folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.docx").load(folder)
    return entities(files.select(F.col("path").alias("doc_id"), "content"))


def change_counts(changes: DataFrame, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Changes by kind in windows of their date; late ones count until the watermark passes."""
    return changes.withWatermark("date", late).groupBy(F.window("date", window), "change_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "change_type", "n")


def write_entities(stream: DataFrame, folder: str, checkpoint: str):
    """Appends entities to Parquet, partitioned by kind."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start()
