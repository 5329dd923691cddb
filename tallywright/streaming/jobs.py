"""Stateful streams that run to the end of what has arrived: a job machine, sessions, and sliding windows with late rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallywright.sources.shared import fresh_path

#: What an event does to a job: from which states, to which.
STEPS = {
    "view": ((None,), "pending"),
    "click": (("pending",), "processing"),
    "purchase": (("processing",), "completed"),
    "error": (("pending", "processing"), "failed"),
}


def in_slices(rows: DataFrame, number: Column, slices: int, run: Callable[[DataFrame, str, str], DataFrame], sink: Callable[[DataFrame, int], None], mode: str) -> None:
    """Let rows arrive slice by slice; after each, the stream runs until it has read all, then stops and keeps its checkpoint.

    number: 0 .. slices - 1, the slice of a row. run makes the result of a stream of
    rows. The sink gets each micro-batch with its number and must bear the same
    batch twice. Input files and checkpoint lie in the shared folder.
    """
    spark = rows.sparkSession
    folder, checkpoint = fresh_path(spark, "arriving"), fresh_path(spark, "checkpoint")
    numbered = rows.withColumn("slice", number)
    for k in range(slices):
        numbered.where(F.col("slice") == k).drop("slice").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        running = run(stream).writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
        running.awaitTermination()


def job_states(events: DataFrame) -> DataFrame:
    """(job, state, started, ended, seen): the state of every job after the events of a micro-batch.

    events: job, event_id, ts, event_type. Events count in the order of (ts, event_id)
    within a micro-batch; those that do not fit a job's state change nothing. started
    is the time of the first step, ended that of the last one into an end state.
    """
    out = "job string, state string, started timestamp, ended timestamp, seen long"
    held = "state string, started timestamp, ended timestamp, seen long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, started, ended, seen = state.get if state.exists else (None, None, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, kind in zip(rows["ts"], rows["event_type"], strict=True):
            seen += 1
            before, after = STEPS.get(kind, ((), None))
            if now in before:
                now, started = after, started if started is not None else ts.to_pydatetime()
                ended = ts.to_pydatetime() if after in ("completed", "failed") else None
        state.update((now, started, ended, seen))
        yield pd.DataFrame({"job": [key[0]], "state": [now], "started": pd.to_datetime([started]), "ended": pd.to_datetime([ended]), "seen": [seen]})

    return events.groupBy("job").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.NoTimeout)


def sliding_counts(events: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """(start, event_type, n) of windows that overlap; rows behind the watermark are dropped from windows that are over."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def latest_batches(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes every micro-batch to its own folder, once whatever is retried."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write
