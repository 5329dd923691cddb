"""Maximal marginal relevance of many pools at a time against one pool by plain loops."""

import random

import pytest
from test_queries import SF

from tallywright.operators import diversity
from tallywright.plans import base, retrieval


def greedy(rows, k=10, balance=0.6):
    rows = sorted(rows, key=lambda x: x[1])
    scores = [x[2] for x in rows]
    span = max(scores) - min(scores)
    norm = [1.0 if span < 1e-12 else (s - min(scores)) / span for s in scores]

    def alike(i, j):
        a, b = set(rows[i][5]), set(rows[j][5])
        return 0.5 * (rows[i][3] == rows[j][3]) + 0.3 * (rows[i][4] == rows[j][4]) + 0.2 * (len(a & b) / len(a | b) if a & b else 0.0)

    taken, left = [0], set(range(1, len(rows)))
    while left and len(taken) < k:
        best = max(left, key=lambda i: (balance * norm[i] - (1 - balance) * max(alike(i, j) for j in taken), -i))
        taken.append(best)
        left.remove(best)
    return [(rows[i][0], place) for place, i in enumerate(taken, 1)]


def test_many_pools_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(diversity, "AT_ONCE", 7)
    rng = random.Random(5)
    pools = {}
    for q in range(40):
        n = rng.choice([1, 2, 5, 12, 30])
        order = rng.sample(range(1, n + 1), n)
        pools[f"q{q}"] = [(f"{q}-{i}", order[i], rng.choice([0.5, 0.5, rng.random()]), rng.choice(["m", "n", None]), rng.randrange(4), rng.choices(["a", "b", "c", "d"], k=rng.randrange(4))) for i in range(n)]
    frame = spark.createDataFrame([(q, *row) for q, rows in pools.items() for row in rows], "q string, c string, r int, score double, identity string, po long, tokens array<string>")
    got = {}
    for r in diversity.mmr(frame).collect():
        got.setdefault(r.q, []).append((r.c, r.place))
    assert {q: sorted(x, key=lambda y: y[1]) for q, x in got.items()} == {q: greedy(rows) for q, rows in pools.items()}


def test_selective_mmr_gathers_once(spark, monkeypatch):
    """The candidates of all queries are neither written nor joined again."""
    monkeypatch.setattr(retrieval, "materialized", lambda *a: pytest.fail("candidates are written"))
    got = {}
    for r in retrieval.div4_selective_mmr(spark, SF).collect():
        got.setdefault(r.q, {})[r.place] = r.c
    rows = {}
    for r in retrieval.mmr_input(spark, SF).collect():
        rows.setdefault(r.q, []).append((r.c, r.r, r.score, r.identity, r.po, r.tokens))
    near = {q: s for q, s in retrieval.mmr_input(spark, SF).groupBy("q").agg(retrieval.pair_similarity().alias("s")).collect()}
    assert set(got) == set(rows) and base.TOGETHER[-1] == "q"
    for q, own in rows.items():
        plain = {r[1]: r[0] for r in own if r[1] <= 10}
        assert got[q] == ({p: c for c, p in greedy(own)} if len(own) > 10 and near[q] <= 0.98 else plain)
