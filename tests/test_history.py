"""Queries over whole histories against plain loops: nothing is cut at the pool's 30 rows."""

import math
import statistics

import pytest

from tallywright import catalog as C
from tallywright.plans.base import EVAL_FROM, catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return catalog(spark, SF).collect()


def queries(rows):
    return [r for r in rows if str(r.d) >= EVAL_FROM]


def test_identity_statistics_of_all_prior_rows(spark, rows):
    got = {r.q: r for r in C.queries()["agg10_identity_history"](spark, SF).collect()}
    asked = queries(rows)
    assert set(got) == {q.row_key for q in asked}
    for q in asked:
        prior = [c for c in rows if (c.code, c.uom, c.model) == (q.code, q.uom, q.model) and c.d < q.d]
        recent = [c for c in prior if (q.d - c.d).days <= 365]
        assert (got[q.row_key].n_prior, got[q.row_key].n_recent) == (len(prior), len(recent))
        if prior:
            assert abs(got[q.row_key].med - statistics.median(c.price for c in recent or prior)) < 1e-3
            assert abs(got[q.row_key].confidence - min(1, math.sqrt(len(prior)) / 5)) < 1e-3
    assert max(r.n_prior for r in got.values()) > 30


def test_quantity_band_is_filtered_before_the_cut(spark, rows):
    got = {}
    for r in C.queries()["chj_quantity_history"](spark, SF).collect():
        got.setdefault(r.q, []).append((r.k, r.c))
    for q in queries(rows):
        fits = [c for c in rows if c.code == q.code and c.d < q.d and abs(math.log10(c.qty) - math.log10(q.qty)) <= 0.5]
        newest = sorted(fits, key=lambda c: (c.d, c.row_key), reverse=True)[:30]
        assert sorted(got.get(q.row_key, [])) == [(k, c.row_key) for k, c in enumerate(newest, 1)]
