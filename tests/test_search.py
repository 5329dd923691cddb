"""Exact top-k of cosines and newest rows within a band, against brute force."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallywright.operators import temporal, topk


def unit_vectors(rng, n, vocabulary, most, stores):
    out = {}
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(1, most))
        weights = {w: rng.choice([0.5, 1.0, 1.0, 2.0]) * (1 + len(w)) for w in words}
        size = math.sqrt(sum(x * x for x in weights.values()))
        out[i] = (rng.choice(stores), {w: x / size for w, x in weights.items()})
    for i in range(0, n - 1, 9):  # equal vectors, so that scores tie
        out[i + 1] = out[i]
    return out


def wanted(vectors, weight, k, floor):
    """Pairs (a, b) while those with larger dots weigh fewer than k rows together."""
    found = {}
    for a, (store, va) in vectors.items():
        dots = sorted(((sum(w * vb.get(t, 0) for t, w in va.items()), b) for b, (other, vb) in vectors.items() if other == store), reverse=True)
        for dot, b in dots:
            above = sum(weight.get(c, 0) for d, c in dots if d > dot + 1e-9)
            if above < k and dot >= floor:
                found[a, b] = dot
    return found


@pytest.mark.parametrize("seed, most, short", [(1, 5, 12), (2, 5, 0), (3, 25, 12), (4, 2, 12)])
def test_nearest_loses_nothing(spark, seed, most, short, monkeypatch):
    monkeypatch.setattr(topk, "SHORT", short)
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "ccc"] + [f"w{i}" for i in range(20)] + [f"rare{i}" for i in range(150)]
    vectors = unit_vectors(rng, 150, vocabulary, most, ["x", "x", "y"])
    weight = {i: rng.choice([0, 1, 1, 3]) for i in vectors if i % 11}
    frame = spark.createDataFrame([(i, s, t, w) for i, (s, v) in vectors.items() for t, w in v.items()], "id long, store string, term string, w double")
    got = {(r.a, r.b): r.dot for r in topk.nearest(frame, spark.createDataFrame(list(weight.items()), "id long, n long"), 6, 0.1).collect()}
    want = wanted(vectors, weight, 6, 0.1)
    assert not set(want) - set(got)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_pairs_that_meet_follow_the_rows(spark):
    """Eight times the vectors of one fixed vocabulary, at most 15 times the pairs that meet, where all pairs would be 64 times as many."""
    def met(n):
        rng = random.Random(7)
        rows = []
        for i in range(n):
            v = {f"size {rng.randrange(50)}": 3.9, f"a{rng.randrange(8)}": 2.1, f"b{rng.randrange(8)}": 2.1, f"kind {rng.randrange(6)}": 1.8, "size": 1.0}
            size = math.sqrt(sum(x * x for x in v.values()))
            rows += [(i, "s", t, w / size) for t, w in v.items()]
        index = topk.materialized(topk._index(spark.createDataFrame(rows, "id long, store string, term string, w double")))
        whole = index.groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("terms"))
        seeds = topk._with_dots(topk._seeds(index, 4, 3), whole).withColumn("n", F.lit(10))
        return topk.meetings(topk.entries(index, True), topk.thresholds(seeds, 30, 0.1)).count()

    few, many = met(250), met(2000)
    assert many <= 15 * few


def test_nearest_needs_a_floor(spark):
    with pytest.raises(ValueError):
        topk.nearest(spark.createDataFrame([], "id long, store string, term string, w double"), spark.createDataFrame([], "id long, n long"), 3, 0.0)
    assert topk.nearest(spark.createDataFrame([], "id long, store string, term string, w double"), spark.createDataFrame([], "id long, n long"), 3, 0.1).collect() == []


@pytest.mark.parametrize("half, values", [(0.5, [1, 2, 3, 5, 10, 50]), (0.5, None), (0.01, None), (3.0, None)])
def test_newest_within_a_band(spark, half, values):
    rng = random.Random(int(half * 100))
    rows = [(f"r{i:04}", date(2000, 1, 1) + timedelta(days=rng.randrange(400)), rng.choice("ab"), float(rng.choice(values)) if values else 10 ** rng.uniform(-0.2, 3), rng.random() < 0.4) for i in range(500)]
    rows += [("null", date(2000, 5, 1), "a", None, True), ("nokey", date(2000, 5, 1), None, 3.0, True)]
    frame = spark.createDataFrame(rows, "row_key string, d date, key string, qty double, ask boolean")
    got = defaultdict(list)
    axis = F.log10("qty")
    for r in temporal.latest_in_band(frame, F.col("ask"), "key", axis, half, 7).collect():
        got[r.q].append((r.k, r.c))
    want = {}
    for key, d, group, qty, ask in rows:
        if ask and qty is not None and group is not None:
            fits = [(e, c) for c, e, g, x, _ in rows if g == group and e < d and x is not None and abs(math.log10(x) - math.log10(qty)) <= half]
            if fits:
                want[key] = [(k, c) for k, (_, c) in enumerate(sorted(fits, reverse=True)[:7], 1)]
    assert {q: sorted(x) for q, x in got.items()} == want
