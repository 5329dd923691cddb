"""Huber fits against the loss itself."""

import random

import numpy as np
import pytest

from tallywright.operators import robust
from tallywright.plans.retrieval import price_slopes


def loss(x, y, slope, intercept, scale, bend=1.35, ridge=1e-4):
    z = np.abs(y - intercept - slope * x) / scale
    return (scale + scale * np.where(z <= bend, z * z, 2 * bend * z - bend * bend)).sum() + ridge * slope * slope


def test_no_step_lowers_the_loss(spark):
    rng = random.Random(4)
    groups = {"clean": (80, 0.0), "outliers": (120, 0.2), "few": (5, 0.0)}
    rows = [(g, x, 3 - 0.3 * x + rng.gauss(0, 0.2) + (rng.choice([-6, 9]) if rng.random() < bad else 0)) for g, (n, bad) in groups.items() for x in [rng.uniform(0, 4) for _ in range(n)]]
    rows += [("flat", 2.0, float(v)) for v in (1, 2, 3)] + [("null", None, 1.0), (None, 1.0, 1.0)]
    got = {r["g"]: r for r in robust.huber_fits(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), "g", rounds=40).collect()}
    assert set(got) == {*groups, "flat"} and got["flat"].slope == 0.0
    for g in groups:
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        r = got[g]
        best = loss(x, y, r.slope, r.intercept, r.scale)
        for ds in (-0.01, 0, 0.01):
            for di in (-0.01, 0, 0.01):
                for dk in (0.97, 1, 1.03):
                    assert best <= loss(x, y, r.slope + ds, r.intercept + di, r.scale * dk) + 1e-4 * best
    assert got["outliers"].slope == pytest.approx(-0.3, abs=0.06)


def test_slopes_stay_within_bounds(spark):
    rng = random.Random(1)
    rows = [(f, q, 50 * q**b * rng.uniform(0.95, 1.05)) for f, b, n in (("steep", -0.9, 60), ("up", 0.5, 60), ("mid", -0.2, 60), ("small", -0.9, 20)) for q in [rng.uniform(1, 50) for _ in range(n)]]
    got = {r.family: r.beta for r in price_slopes(spark.createDataFrame(rows, "family string, qty double, price double"), 12).collect()}
    assert got["steep"] == -0.40 and got["up"] == 0.05 and got["mid"] == pytest.approx(-0.2, abs=0.02)
    assert -0.35 <= got["small"] <= 0.02
