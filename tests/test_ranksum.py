"""Quantiles and areas under curves of whole tables against NumPy and counting pairs."""

import random

import numpy as np
import pytest

from tallywright.operators import ranksum

SCHEMA = "key string, value double, hit int"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = [("a", float(rng.randint(0, 6)), rng.randint(0, 1)) for _ in range(301)] + [("b", rng.gauss(0, 1), int(rng.random() < 0.2)) for _ in range(200)] + [("c", 4.0, 1), ("d", None, 1), (None, 1.0, 0), ("e", 1.0, 0), ("e", 1.0, 0)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_quantiles(table):
    rows, frame = table
    shares = {"low": 0.0, "q1": 0.25, "med": 0.5, "p95": 0.95, "top": 1.0}
    got = {r.key: r for r in ranksum.exact_quantiles(frame, ["key"], "value", shares).collect()}
    assert set(got) == {"a", "b", "c", "e"}
    for key, row in got.items():
        values = [v for k, v, _ in rows if k == key]
        assert [row[n] for n in shares] == pytest.approx([np.quantile(values, s) for s in shares.values()])


def test_counts_before(table):
    rows, frame = table
    counted = frame.groupBy("key", "value").count().withColumnRenamed("count", "n")
    for r in ranksum.cumulative(counted, ["key"], "value").collect():
        values = [v for k, v, _ in rows if k == r.key and v is not None]
        assert (r.before, r.total) == (sum(v < r.value for v in values), len(values))


def test_area_counts_pairs(table):
    rows, frame = table
    got = {r.key: r.auc for r in ranksum.area_under_curve(frame, ["key"], "value", "hit").collect()}
    for key in ("a", "b"):
        hits, misses = ([v for k, v, h in rows if k == key and h == x] for x in (1, 0))
        assert got[key] == pytest.approx(np.mean([(x > y) + 0.5 * (x == y) for x in hits for y in misses]))
    assert got["c"] is None and got["e"] is None
