"""Progress of a running crawl: counts over result parts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

PART = "crawl_id string, url string, status bigint"


def read_parts(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Stream of finished JSON-lines parts of a crawl folder."""
    return spark.readStream.schema(PART).option("maxFilesPerTrigger", max_files).json(folder)


def running_counts(parts: DataFrame) -> DataFrame:
    """Rows so far per crawl and status. State is one row per crawl and status."""
    return parts.groupBy("crawl_id", F.coalesce(F.col("status").cast("string"), F.lit("null")).alias("status")).agg(
        F.count("*").alias("pages"))


def follow(parts: DataFrame, checkpoint: str, sink_path: str):
    """Write the counts of every micro-batch as one table version per batch."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return (
        running_counts(parts).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(save).start())


def latest(spark: SparkSession, sink_path: str) -> DataFrame:
    """Counts as of the newest batch."""
    versions = spark.read.parquet(sink_path)
    newest = versions.agg(F.max("batch").alias("batch"))
    return versions.join(newest, "batch").drop("batch")
