"""Truncated SVD over Spark against a dense one."""

import numpy as np
import pytest

from tallywright.operators import svd
from tallywright.plans import vectors

SF = "/root/testdata/sf0.001"


def frame_of(spark, dense):
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(dense)]
    return spark.createDataFrame(rows, "id long, cols array<int>, weights array<double>").repartition(3)


@pytest.mark.parametrize("shape, rank, chunk", [((200, 90), 10, 50_000), ((60, 700), 8, 40), ((5, 3), 8, 10)])
def test_subspace_values_and_error(spark, shape, rank, chunk, monkeypatch):
    monkeypatch.setattr(svd, "CHUNK", chunk)
    rng = np.random.default_rng(shape[0])
    dense = (rng.standard_normal((shape[0], 12)) * 0.7 ** np.arange(12)) @ rng.standard_normal((12, shape[1])) * (rng.random(shape) < 0.4)
    found = svd.truncated_svd(frame_of(spark, dense), shape[1], rank, rounds=7)
    _, values, right = np.linalg.svd(dense, full_matrices=False)
    r = min(rank, min(shape))
    assert np.allclose(found.values[:r], values[:r], rtol=2e-2)
    best = np.linalg.norm(dense - dense @ right[:r].T @ right[:r])
    mine = np.linalg.norm(dense - dense @ found.right @ found.right.T)
    assert mine <= 1.02 * best + 1e-9
    few = min(4, r)
    assert np.linalg.svd(right[:few] @ found.right)[1].min() > 0.999  # the first right vectors lie in the subspace
    assert np.allclose(found.right.T @ found.right, np.eye(found.right.shape[1]), atol=1e-9)
    assert (found.right[np.abs(found.right).argmax(0), np.arange(found.right.shape[1])] > 0).all()
    got = {r.id: np.array(r.vector) for r in svd.project(frame_of(spark, dense), found).collect()}
    want = dense @ found.right
    for i, row in enumerate(want):
        size = np.linalg.norm(row)
        assert np.allclose(got[i], row / size if size > 1e-12 else row)


def test_composite(spark):
    word = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, vector array<double>")
    char = spark.createDataFrame([(1, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.6, 0.8])], "id long, vector array<double>")
    got = {r.id: r.vector for r in svd.composite(word, char).collect()}
    assert got[1] == pytest.approx([0.5**0.5] * 2) and got[2] == [0.0, 1.0] and got[3] == [0.0, 0.0] and got[4] == pytest.approx([0.6, 0.8])


def test_parts_keep_their_neighbours(spark):
    """Cosines of the parts' vectors of 64 dimensions follow those of the full weights."""
    weights = vectors.part_weights(spark, SF, "char").toPandas()
    ids = sorted(weights["id"].unique())
    dense = np.zeros((len(ids), weights["col"].max() + 1))
    dense[np.searchsorted(ids, weights["id"]), weights["col"]] = weights["weight"]
    found = {r.id: r.vector for r in vectors.part_vectors(spark, SF, "char").collect()}
    low = np.array([found[i] for i in ids])
    assert np.allclose(np.linalg.norm(low, axis=1), 1)
    _, _, right = np.linalg.svd(dense, full_matrices=False)
    plain = dense @ right[:64].T
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    assert np.abs(low @ low.T - plain @ plain.T).max() < 0.05
    assert np.abs(low @ low.T - dense @ dense.T).mean() < 0.1
