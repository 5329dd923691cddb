"""Event streams: windowed counts with watermarks, latest-per-key upserts, and as-of reads of a static history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    """A stream of Parquet files of events that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by window and type; events later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
    )


def session_counts(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by user and session; a session ends after a gap."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count("*").alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def upsert_latest(target: str):
    """A foreachBatch function that keeps the latest event of each user in a Parquet table.

    A batch writes the table's next version beside it (``v=<batch>``), so a batch
    that runs again writes the same version.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")
        if number > 0:
            newest = newest.unionByName(spark.read.parquet(f"{target}/v={number - 1}"))
        newest.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*").write.mode("overwrite").parquet(f"{target}/v={number}")

    return upsert


def enrich_as_of(events: DataFrame, daily: DataFrame) -> DataFrame:
    """Events with the statistics of the day before theirs (user_id, day, ...): nothing of the same day is seen."""
    return events.withColumn("day", F.date_sub(F.to_date("ts"), 1)).join(daily, ["user_id", "day"], "left")
