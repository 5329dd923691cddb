"""Bootstrap intervals and the tuned gate against plain versions."""

import random

import numpy as np
import pytest

from tallywright.plans import resampling as S


def test_intervals_against_drawing_rows(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), int(rng.random() < 0.5)) for _ in range(400)] + [(None, 1)]
    got = S.bootstrap(spark.createDataFrame(rows, "a int, b int")).first()
    data = np.array(rows[:-1])
    draws = np.random.default_rng(1).integers(0, 400, (4000, 400))
    a, b = data[draws, 0].mean(1), data[draws, 1].mean(1)
    assert got.queries == 400 and got.a == data[:, 0].mean() and got.b == data[:, 1].mean() and got.delta == pytest.approx(data[:, 1].mean() - data[:, 0].mean())
    for name, values in (("a", a), ("b", b), ("delta", b - a)):
        assert got[f"{name}_low"] == pytest.approx(np.percentile(values, 2.5), abs=0.012)
        assert got[f"{name}_high"] == pytest.approx(np.percentile(values, 97.5), abs=0.012)
    again = S.bootstrap(spark.createDataFrame(rows, "a int, b int").repartition(5)).first()
    assert tuple(got) == tuple(again)
    empty = S.bootstrap(spark.createDataFrame([], "a int, b int")).first()
    assert empty.queries == 0 and empty.a is None and empty.delta_low is None


def tuned(train, test):
    sims = [r[1] for r in train]
    rules = [(t, None) for t in sorted({round(float(np.quantile(sims, s)), 4) for s in S.SHARES} | set(S.LANDMARKS))] + [(t, p) for t in S.LANDMARKS for p in S.ORDERS]
    best = None
    for t, p in rules:
        gain = sum(d - b for _, sim, orders, b, d in train if sim <= t and (p is None or orders >= p))
        if best is None or gain > best[0]:
            best = (gain, t, p)
    gain, t, p = best
    fired = [sim <= t and (p is None or orders >= p) for _, sim, orders, _, _ in test]
    return ("sim_only" if p is None else "composite_sim_and_po", t, p, gain, len(test), sum(fired), sum(r[3] for r in test), sum(r[4] for r in test), sum(r[4] if f else r[3] for r, f in zip(test, fired, strict=True)))


def test_gate_in_two_folds(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        sim, orders = rng.choice([0.5, 0.9273, 0.98, rng.random()]), rng.randint(3, 10)
        rows.append((rng.randint(1, 2), sim, orders, int(rng.random() < 0.4), int(rng.random() < (0.6 if sim < 0.8 else 0.3))))
    got = {r.fold: tuple(r)[1:] for r in S.tune_gate(spark.createDataFrame(rows, "fold int, sim double, orders int, base int, diverse int")).collect()}
    one, two = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 2]
    assert got == {1: tuned(two, one), 2: tuned(one, two)}


def test_gate_without_rows(spark):
    got = S.tune_gate(spark.createDataFrame([], "fold int, sim double, orders int, base int, diverse int")).collect()
    assert [(r.rule, r.queries, r.selective_hits) for r in got] == [("none", 0, 0)] * 2
