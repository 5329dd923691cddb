"""Stateful streams: the job machine event by event, retried batches, and late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallywright.sources.shared import fresh_path
from tallywright.sources.versioned import VersionedTable
from tallywright.streaming import jobs
from tallywright.streaming.events import event_stream, upsert_latest

SCHEMA = "job string, event_id long, ts timestamp, event_type string, slice int"


def at(minutes):
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


CASES = {
    "done": ([("view", 0), ("click", 0), ("purchase", 1)], "completed"),
    "stuck": ([("view", 0), ("click", 2)], "processing"),
    "waiting": ([("purchase", 0), ("click", 0), ("view", 1)], "pending"),
    "failed early": ([("view", 0), ("error", 0), ("click", 1), ("purchase", 2)], "failed"),
    "failed late": ([("view", 0), ("click", 1), ("error", 2), ("purchase", 2)], "failed"),
    "done for good": ([("view", 0), ("click", 0), ("purchase", 0), ("error", 1), ("view", 2)], "completed"),
    "nothing": ([("signup", 0), ("error", 1)], None),
}


def test_job_machine(spark):
    rows, n = [], 0
    for job, (events, _) in CASES.items():
        for kind, part in events:
            rows.append((job, n, at(n), kind, part))
            n += 1
    frame = spark.createDataFrame(rows, SCHEMA)
    table = VersionedTable(spark, fresh_path(spark, "jobs"), ["job"])

    def twice(batch, number):  # a micro-batch that is retried changes nothing
        for _ in range(2):
            table.upsert(batch, f"batch-{number}")

    jobs.in_slices(frame.drop("slice").join(frame.select("event_id", "slice"), "event_id").select("job", "event_id", "ts", "event_type", "slice"), F.col("slice"), 3, jobs.job_states, twice, "update")
    got = {r.job: r for r in table.read().collect()}
    assert {j: r.state for j, r in got.items()} == {j: state for j, (_, state) in CASES.items()}
    assert {j: r.seen for j, r in got.items()} == {j: len(e) for j, (e, _) in CASES.items()}
    first = {j: next((t for k, _, t, kind, _ in rows if k == j and kind == "view"), None) for j in CASES}
    assert {j: r.started for j, r in got.items()} == first
    assert all((r.ended is not None) == (r.state in ("completed", "failed")) for r in got.values())


@pytest.mark.parametrize("late, kept", [("1 hour", 3), ("3 days", 4)])
def test_late_rows_of_windows_that_are_over(spark, late, kept):
    rows = [("a", 1, at(0), "view", 0), ("a", 2, at(10), "view", 0), ("a", 3, at(5), "view", 1), ("a", 4, at(2880), "view", 0), ("a", 5, at(2890), "view", 1), ("a", 6, at(20), "view", 0), ("a", 7, at(9000), "view", 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    folder = fresh_path(spark, "windows")
    jobs.in_slices(frame, F.col("slice"), 3, lambda s: jobs.sliding_counts(s, "1 hour", "1 hour", late), jobs.latest_batches(spark, folder), "append")
    got = {r.start: r.n for r in spark.read.schema("start timestamp, event_type string, n long").parquet(f"{folder}/batch=*").collect()}
    assert got[at(0)] == kept and got[at(2880)] == 2 and at(9000) not in got


def test_upserts_of_a_stream_keep_the_latest(spark):
    rows = [(1, at(1), 7, "view"), (2, at(5), 7, "click"), (3, at(3), 7, "error"), (4, at(2), 8, "view")]
    source, target, checkpoint = (fresh_path(spark, x) for x in ("in", "out", "check"))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, "event_id long, ts timestamp, user_id long, event_type string").withColumns({"value": F.lit(1.0), "props": F.lit("")}).write.mode("append").parquet(source)
        event_stream(spark, source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert_latest(target)).start().awaitTermination()
    assert {(r.user_id, r.event_id, r.event_type) for r in spark.read.parquet(f"{target}/v=1").collect()} == {(7, 2, "click"), (8, 4, "view")}
