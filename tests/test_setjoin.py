"""Minimum overlaps, containment and longest keys against every pair; market rejections one by one."""

import random

import pytest
from pyspark.sql import functions as F

from tallywright.operators import setjoin
from tallywright.plans import market


def sets(rng, n, most):
    words = ["the"] * 30 + ["pump", "valve"] * 10 + [f"w{i}" for i in range(60)]
    return {i: sorted(set(rng.choices(words, k=rng.randint(0, most)))) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps(spark, seed):
    rng = random.Random(seed)
    a, b = sets(rng, 80, 9), sets(rng, 120, 14)
    need = {q: rng.randint(1, max(1, len(s))) for q, s in a.items()}
    asks = spark.createDataFrame([(q, s, need[q]) for q, s in a.items()], "q long, tokens array<string>, k int")
    offers = spark.createDataFrame(list(b.items()), "e long, tokens array<string>")
    got = {(r.q, r.e, r.overlap) for r in setjoin.overlapping(asks, offers, F.col("k")).collect()}
    assert got == {(q, e, len(set(s) & set(t))) for q, s in a.items() for e, t in b.items() if len(set(s) & set(t)) >= need[q]}
    inside = {(r.q, r.e) for r in setjoin.containing(asks, offers, "tokens").collect()}
    assert inside == {(q, e) for q, s in a.items() for e, t in b.items() if s and set(s) <= set(t)}


def test_longest_keys(spark):
    keys = [("pune", 1, 1.0), ("newpune", 1, 2.0), ("goa", 1, 3.0), ("maharashtra", 2, 4.0), ("a", 2, 5.0), ("", 1, 6.0), ("ago", 1, 7.0)]
    texts = [(1, "plotinnewpunemaharashtra"), (2, "goago"), (3, "maharashtra"), (4, "xyz"), (5, ""), (6, None), (7, "ba")]
    found = setjoin.longest_keys(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(keys, "key string, pass int, lat double"))
    assert {r.id: (r.key, r["pass"], r.lat) for r in found.collect()} == {1: ("newpune", 1, 2.0), 2: ("ago", 1, 7.0), 3: ("maharashtra", 2, 4.0), 7: ("a", 2, 5.0)}


OFFERS = [(1, "Dell Latitude 5420 laptop 16GB", "usd", "EA", 900.0), (2, "Dell Latitude 5520 laptop 16GB", "USD", "each", 950.0), (3, "leather backpack black large", "USD", "piece", 40.0), (4, "leather backpack black large", "EUR", "set", 41.0), (5, "leather backpack black large", "USD", None, 42.0), (6, "leather backpack black large", "", "ea", 43.0), (7, "leather backpack black large", "USD", "ea", 0.0), (8, "Precision dock leather large black", "USD", "ea", 5.0)]
ASKS = [
    ("latitude 5420 notebook", None, None, [1]),
    ("latitude 5420", None, None, []),
    ("Latitude 5999 laptop", None, None, []),
    ("large black leather backpack", None, None, [3, 4]),
    ("large black leather backpack", " usd", None, [3]),
    ("large black leather backpack", None, "SET", [4]),
    ("black backpack cotton red small tiny", None, None, []),
    ("backpack", None, None, [3, 4]),
    ("backpack wooden", None, None, []),
    ("large black leather", None, None, []),
    ("latitude docking leather large", None, None, []),
    ("", None, None, []),
    (None, None, None, []),
]


def test_rejections(spark):
    offers = spark.createDataFrame(OFFERS, "e int, text string, currency string, unit string, price double")
    asks = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ASKS)], "q int, text string, currency string, unit string")
    found = {}
    for r in market.search_market(asks, offers).orderBy("q", "place").collect():
        found.setdefault(r.q, []).append(r.e)
    assert {i: found.get(i, []) for i in range(len(ASKS))} == {i: a[3] for i, a in enumerate(ASKS)}
