"""Order statistics of as-of frames against sorting each frame."""

import random

import numpy as np
import pytest

from tallywright.operators import orderstat, temporal


def made(spark, rng, sizes, kinds):
    rows = [(k, i + 1, float(rng.choice(kinds)) if kinds else rng.uniform(-5, 5)) for k, n in sizes.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "key string, nth long, price double").repartition(3)


@pytest.mark.parametrize("seed, block, kinds", [(1, 4096, None), (2, 7, [1, 2, 2, 3]), (3, 50, None)])
def test_every_rank(spark, seed, block, kinds, monkeypatch):
    monkeypatch.setattr(orderstat, "BLOCK", block)
    rng = random.Random(seed)
    sizes = {"a": 1, "b": 16, "c": 17, "d": 300, "e": 40}
    rows, frame = made(spark, rng, sizes, kinds)
    asks = {(k, lo, hi, rng.randint(1, max(1, hi - lo))) for k, n in sizes.items() for _ in range(40) for lo, hi in [sorted((rng.randint(0, n), rng.randint(0, n)))]} | {("none", 0, 3, 1), ("d", 0, 300, 300), ("d", 299, 300, 1)}
    got = {(r.key, r.lo, r.hi, r.r): r.value for r in orderstat.order_statistics(frame, spark.createDataFrame(sorted(asks), "key string, lo long, hi long, r int"), "price").collect()}
    values = {k: [v for key, _, v in rows if key == k] for k in sizes}
    want = {(k, lo, hi, r): sorted(values[k][lo:hi])[r - 1] for k, lo, hi, r in asks if k in sizes and 1 <= r <= hi - lo}
    assert got == want


def test_quantiles(spark):
    rng = random.Random(9)
    rows, frame = made(spark, rng, {"a": 90, "b": 3}, None)
    values = {k: [v for key, _, v in rows if key == k] for k in "ab"}
    asks = [("a", lo, hi) for lo in range(0, 90, 9) for hi in range(lo, 91, 10)] + [("b", 0, 0), ("b", 0, 1), ("b", 1, 3)]
    shares = {"low": 0.25, "med": 0.5, "high": 0.75, "top": 1.0}
    got = {(r.key, r.lo, r.hi): r for r in orderstat.quantiles(frame, spark.createDataFrame(asks, "key string, lo long, hi long"), shares, "price").collect()}
    assert set(got) == set(asks)
    for (key, lo, hi), row in got.items():
        for name, share in shares.items():
            assert row[name] == (pytest.approx(np.quantile(values[key][lo:hi], share)) if hi > lo else None)


def test_empty(spark):
    rows = spark.createDataFrame([], "key string, nth long, value double")
    asks = spark.createDataFrame([("a", 0, 2, 1)], "key string, lo long, hi long, r int")
    assert orderstat.order_statistics(rows, asks).collect() == []


def test_no_table_is_sent_to_the_driver(spark):
    """Tables that grow with the rows are small as files; their joins must not be broadcasts for that."""
    rows = spark.createDataFrame([("k", i, float(i % 7)) for i in range(1, 60)], "key string, nth long, value double")
    frames = spark.createDataFrame([("k", 0, 59), ("k", 10, 30)], "key string, lo long, hi long")
    plan = orderstat.quantiles(rows, frames, {"med": 0.5})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_months_of_many_keys_are_not_sent_to_the_driver(spark):
    rows = spark.range(200).selectExpr("cast(id as string) as row_key", "id % 50 as k", "date_add(date'2000-01-01', cast(id as int)) as d")
    for frame in (temporal.ranked_history(rows, ["k"]), temporal.counts_before(rows, rows.select("k", "d"), ["k"])):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
