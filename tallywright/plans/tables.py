"""Versioned sinks and caches as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.plans.base import Registry, read
from tallywright.sources.shared import fresh_path
from tallywright.sources.versioned import VersionedTable, cached

R = Registry()


@R.query("snk2_append", "SELECT o_orderkey, o_custkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS batch FROM orders")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended in three batches by status; a batch that comes twice is written once."""
    orders = read(spark, sf_dir, "orders")
    batch = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    rows = orders.select("o_orderkey", "o_custkey", "o_totalprice", batch.alias("batch"))
    table = VersionedTable(spark, fresh_path(spark, "orders"), ["o_orderkey"])
    for number in (0, 1, 1, 2, 0):
        table.append(rows.where(F.col("batch") == number), f"status-{number}")
    return table.read()


DAYS = 10
LATEST_SQL = f"""WITH e AS (SELECT *, (day(ts) - 1) // {DAYS} AS batch FROM events), newest AS (SELECT user_id, batch, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM e GROUP BY ALL),
 last AS (SELECT user_id, batch, event_id, event_type FROM newest QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY batch DESC) = 1) SELECT user_id, batch, event_id, event_type FROM last WHERE event_type <> 'error'"""


@R.query("snk3_upsert_delete", LATEST_SQL)
def snk3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, put in place batch by batch; users whose batch ends in an error are taken away until they come again."""
    events = read(spark, sf_dir, "events").withColumn("batch", F.floor((F.dayofmonth("ts") - 1) / DAYS))
    newest = events.groupBy("user_id", "batch").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")).select("user_id", "batch", "e.*")
    table = VersionedTable(spark, fresh_path(spark, "latest"), ["user_id"])
    for number in range(-(-31 // DAYS)):
        own = newest.where(F.col("batch") == number)
        table.upsert(own, f"upsert-{number}")
        table.delete(own.where("event_type = 'error'"), f"delete-{number}")
    return table.read()


@R.query("src7_cache_checks", "SELECT code, n, step FROM (SELECT p_brand AS code, count(*) AS n FROM part GROUP BY 1), (VALUES ('made'), ('reused')) s(step) UNION ALL SELECT p_brand, count(*), 'made again' FROM part WHERE p_size > 3 GROUP BY 1 HAVING count(*) > 0 AND p_brand <> 'Brand#1'")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache by brand: made, found valid by its count and key hash, and made again when the wanted keys have changed."""
    part = read(spark, sf_dir, "part")
    table = VersionedTable(spark, fresh_path(spark, "cache"), ["code"])
    every = part.groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("n"))
    fewer = part.where("p_size > 3 and p_brand <> 'Brand#1'").groupBy(F.col("p_brand").alias("code")).agg(F.count("*").alias("n"))
    out = None
    for frame in (every, every, fewer):
        before = len(table.versions())
        found, made = cached(table, frame, lambda frame=frame: frame)
        step = "made again" if made and before else "made" if made else "reused"
        found = found.withColumn("step", F.lit(step))
        out = found if out is None else out.unionByName(found)
    table.check()
    return out


QUERIES, ORACLES = R.queries, R.oracles
