"""Streams as queries: they read what has arrived, stop, and are compared with SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.plans.base import Registry, read
from tallywright.sources.shared import fresh_path
from tallywright.sources.versioned import VersionedTable
from tallywright.streaming import jobs
from tallywright.streaming.events import enrich_as_of, session_counts, tumbling_counts

R = Registry()

SLICES = 4
#: The quarter of January in which an event happens.
QUARTER = "least((day(ts) - 1) // 8, 3)"


def _quarter():
    return F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")


JOBS_SQL = """WITH e AS (SELECT concat(user_id, '/', event_id % 3) AS job, event_type, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS o, ts FROM events), s AS (SELECT job, min(o) AS o FROM e WHERE event_type = 'view' GROUP BY 1),
 f AS (SELECT job, min(e.o) AS o FROM e JOIN s USING (job) WHERE event_type = 'error' AND e.o > s.o GROUP BY 1), p AS (SELECT job, min(e.o) AS o FROM e JOIN s USING (job) WHERE event_type = 'click' AND e.o > s.o GROUP BY 1), c AS (SELECT job, min(e.o) AS o FROM e JOIN p USING (job) WHERE event_type = 'purchase' AND e.o > p.o GROUP BY 1),
 j AS (SELECT job, count(*) AS seen, any_value(s.o) AS so, any_value(f.o) AS fo, any_value(p.o) AS po, any_value(c.o) AS co FROM e LEFT JOIN s USING (job) LEFT JOIN f USING (job) LEFT JOIN p USING (job) LEFT JOIN c USING (job) GROUP BY 1),
 k AS (SELECT *, CASE WHEN so IS NULL THEN NULL WHEN co IS NOT NULL AND (fo IS NULL OR co < fo) THEN 'completed' WHEN fo IS NOT NULL THEN 'failed' WHEN po IS NOT NULL THEN 'processing' ELSE 'pending' END AS state FROM j)
SELECT k.job, state, a.ts AS started, b.ts AS ended, seen FROM k LEFT JOIN e a ON a.job = k.job AND a.o = so LEFT JOIN e b ON b.job = k.job AND b.o = CASE state WHEN 'completed' THEN co WHEN 'failed' THEN fo END"""


@R.query("stm4_job_machine", JOBS_SQL)
def stm4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from pending over processing to completed or failed, by a keyed state that outlives restarts, into a versioned table."""
    rows = _events(spark, sf_dir).withColumn("job", F.concat_ws("/", "user_id", F.col("event_id") % 3))
    table = VersionedTable(spark, fresh_path(spark, "jobs"), ["job"])
    jobs.in_slices(rows, _quarter(), SLICES, jobs.job_states, lambda batch, number: table.upsert(batch, f"batch-{number}"), "update")
    return table.read()


@R.query("stm1_profile_sync", f"SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {QUARTER} DESC, ts DESC, event_id DESC) = 1")
def stm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept in a versioned table by micro-batches."""
    table = VersionedTable(spark, fresh_path(spark, "profiles"), ["user_id"])

    def sync(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "e.*")
        table.upsert(newest, f"batch-{number}")

    jobs.in_slices(_events(spark, sf_dir), _quarter(), SLICES, lambda stream: stream, sync, "append")
    return table.read()


@R.query(
    "stm2_as_of_history",
    "SELECT e.event_id, e.user_id, CAST(e.ts AS DATE) - 1 AS day, h.n AS n_before FROM events e LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) h ON h.user_id = e.user_id AND h.day = CAST(e.ts AS DATE) - 1",
)
def stm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving events with their user's count of the day before, read from the history: nothing of the same day is seen."""
    rows = _events(spark, sf_dir)
    daily = rows.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n_before"))
    folder = fresh_path(spark, "enriched")
    jobs.in_slices(rows, _quarter(), SLICES, lambda stream: enrich_as_of(stream, daily), jobs.latest_batches(spark, folder), "append")
    return spark.read.parquet(folder).select("event_id", "user_id", "day", "n_before")


@R.query(
    "stm5_session_counts",
    """WITH e AS (SELECT user_id, ts, sum(CASE WHEN last IS NULL OR ts >= last + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS last FROM events))
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM e GROUP BY user_id, s""",
)
def stm5_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with gaps of six hours, complete after the last slice."""
    folder, last = fresh_path(spark, "sessions"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/v={number}")
        last.append(number)

    jobs.in_slices(_events(spark, sf_dir), _quarter(), SLICES, lambda stream: session_counts(stream, "6 hours", "1 hour"), keep, "complete")
    return spark.read.parquet(f"{folder}/v={last[-1]}")


LATE_SLICE = "CASE WHEN event_id % 10 = 3 THEN least(q + 1, 3) ELSE q END"
SLIDING_SQL = f"""WITH e AS (SELECT event_type, ts, {LATE_SLICE} AS slice FROM (SELECT *, {QUARTER} AS q FROM events)), top AS (SELECT slice, max(ts) AS high FROM e GROUP BY 1),
 mark AS (SELECT s.slice, (SELECT max(high) FROM top WHERE top.slice < s.slice) - INTERVAL 2 DAY AS w FROM (SELECT DISTINCT slice FROM e) s), last AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM e),
 spread AS (SELECT event_type, slice, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 12 HOUR AS start FROM e, (VALUES (0), (1)) v(k))
SELECT start, event_type, count(*) AS n FROM spread JOIN mark USING (slice) WHERE (w IS NULL OR start + INTERVAL 1 DAY > date_trunc('millisecond', w)) AND start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', w) FROM last) GROUP BY ALL"""


@R.query("stm5_sliding_late", SLIDING_SQL)
def stm5_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that slide by half a day, with a tenth of the rows a slice late: what is behind the watermark of two days is dropped, windows come out when they are over."""
    own = _quarter()
    late = F.when(F.col("event_id") % 10 == 3, F.least(own + 1, F.lit(3))).otherwise(own)
    folder = fresh_path(spark, "sliding")
    jobs.in_slices(_events(spark, sf_dir), late, SLICES, lambda stream: jobs.sliding_counts(stream, "1 day", "12 hours", "2 days"), jobs.latest_batches(spark, folder), "append")
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{folder}/batch=*")


@R.query("stm5_tumbling_stream", "SELECT * FROM (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts) - INTERVAL 30 MINUTE) FROM events)")
def stm5_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type as a stream, as far as the watermark has come."""
    folder = fresh_path(spark, "tumbling")
    jobs.in_slices(_events(spark, sf_dir), _quarter(), SLICES, tumbling_counts, jobs.latest_batches(spark, folder), "append")
    return spark.read.schema("hour timestamp, event_type string, n long").parquet(f"{folder}/batch=*")


QUERIES, ORACLES = R.queries, R.oracles
