"""Pairs of a query lie in one task: what is computed for each query moves no pair, and history that no query reaches is left out."""

import re

import pytest
from pyspark.sql import functions as F
from test_queries import SF

from tallywright import catalog
from tallywright.operators import temporal, topk
from tallywright.plans import channels
from tallywright.plans.base import EVAL_FROM

QUERIES = catalog.queries()
ONCE = "div3_mmr fil13_state_pruning rrk3_hybrid_rerank rrk4_multi_aspect win8_price_support rel1_reliability agg12_pool_distribution cfi1_interval mth10_graded_gain str5_token_jaccard rrk7_reranker_features".split()


@pytest.mark.parametrize("name", ONCE)
def test_pairs_do_not_move(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"Exchange hashpartitioning\(([^)]*)\)?", plan)
    assert moved and not [m for m in moved if re.match(r"q#", m)]


def test_rows_out_of_reach_are_left_out(spark):
    rows = spark.range(400).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("row_key"), F.expr("cast(id % 2 as string)").alias("k"), F.expr("date_add(date'2000-01-01', cast(id div 7 as int))").alias("d"))
    since = "2000-02-20"
    asks = F.col("d") >= F.lit(since).cast("date")
    kept = temporal.reachable(rows, ["k"], 10, since)
    assert kept.where(~asks).count() == 20 and kept.where(asks).count() == rows.where(asks).count()
    whole, cut = (temporal.latest_prior(rows, asks, ["k"], 10, ["row_key", "d"], since=s).select("q_row_key", "c_row_key", "pool_rank").collect() for s in (None, since))
    assert sorted(whole) == sorted(cut) and cut


@pytest.mark.parametrize("name", ["chi_commodity_uom", "chj_quantity_band"])
def test_channels_cut_their_history(spark, monkeypatch, name):
    cut = []
    whole = temporal.reachable

    def watched(*args, **named):
        cut.append(whole(*args, **named))
        return cut[-1]

    monkeypatch.setattr(channels, "reachable", watched)
    monkeypatch.setattr(temporal, "reachable", watched)
    QUERIES[name](spark, SF)
    old = F.col("d") < F.lit(EVAL_FROM).cast("date")
    lists = [c for c in ("code", "family", "uom", "key", "level", "spot") if c in cut[0].columns]
    assert cut[0].where(old).groupBy(*[F.col(c) for c in lists]).count().agg(F.max("count")).first()[0] <= channels.TOP


def test_dots_of_small_pairs_are_dealt(spark):
    vectors = spark.createDataFrame([(i, [(i % 3, 1.0)]) for i in range(12)], "id long, terms array<struct<t: long, w: double>>")
    pairs = vectors.select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).coalesce(1)
    got = topk._with_dots(pairs, vectors)
    assert got.where("dot = 1").count() == 4 and got.count() == 12
    assert got.rdd.getNumPartitions() >= 4
