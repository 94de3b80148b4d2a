"""An extension: run logs as a stream, routed and counted as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayscore.sources.logs import LOG_SCHEMA, last_of_each, normalised


def stream_logs(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    raw = (
        spark.readStream.schema(LOG_SCHEMA)
        .option("multiLine", True)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
    return normalised(raw.where("_corrupt is null"))


def hourly_labels(logs: DataFrame, late: str = "1 day") -> DataFrame:
    """Outputs by model, prompt and hour of the log's own timestamp, late logs within the watermark."""
    timed = logs.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 hour"), "model", "prompt").agg(F.count("*").alias("runs"), F.sum("output_label").alias("positive"))


def ingested(spark: SparkSession, path: str, table: str, recursive: bool = True) -> DataFrame:
    """All logs below ``path`` as ``read_logs`` gives them, from a table that is brought up to date first.

    A stream over the files runs until it has what is there: each file is parsed
    once, whichever run sees it first, and a run that dies in between adds nothing twice.
    """
    raw = (
        spark.readStream.schema(LOG_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    rows = raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("filename"))
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{table}/progress").trigger(availableNow=True).start(f"{table}/parsed")
    query.awaitTermination()
    return last_of_each(spark.read.schema(rows.schema).parquet(f"{table}/parsed"))
