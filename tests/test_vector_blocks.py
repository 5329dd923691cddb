"""The embedding channel in blocks against all pairs."""

import numpy as np
import pandas as pd

from tallywright.plans import retrieval


def test_blocks_find_the_best_of_all_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 7)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4)).astype("float32")
    frame = pd.DataFrame({"vec_id": np.arange(60), "label": np.arange(60) % 2, "embedding": list(v)})
    frame.to_parquet(f"{tmp_path}/embeddings.parquet", index=False)
    got = sorted((r.q, r.c, r.sim) for r in retrieval.chg_embedding_channel(spark, str(tmp_path)).collect())
    d = v.astype(float)
    want = []
    for q in range(60):
        sims = [(np.floor(d[q] @ d[c] / np.sqrt(d[q] @ d[q]) / np.sqrt(d[c] @ d[c]) * 10000 + 0.500001) / 10000, c) for c in range(q) if c % 2 == q % 2]
        want += [(q, c, s) for s, c in sorted(sims, reverse=True)[:10] if s >= 0.10]
    assert got == sorted(want)


def test_a_block_steps_through_its_vectors(monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(9, 3))
    frame = pd.DataFrame({"vec_id": np.arange(9), "v": list(v), "norm": np.sqrt((v * v).sum(axis=1))})
    whole = retrieval._best_of_blocks((), frame, frame)
    monkeypatch.setattr(retrieval, "VECTOR_STEP", 2)
    pd.testing.assert_frame_equal(whole.reset_index(drop=True), retrieval._best_of_blocks((), frame, frame).reset_index(drop=True))
    assert (whole.c < whole.q).all() and len(retrieval._best_of_blocks((), frame, frame.head(0))) == 0
