"""Greedy diversity over small candidate pools."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Queries that a task compares at a time.
AT_ONCE = 512


def _codes(values: pa.Array) -> np.ndarray:
    """Equal values have equal numbers; null is a value."""
    return pd.factorize(values.to_pandas(), use_na_sentinel=False)[0]


def _pick(pools: pa.ListArray, k: int, balance: float) -> pa.ListArray:
    """The rows taken of each pool, all pools of a slice a step at a time: tables of pool by row, and of the words' numbers by place."""
    size = np.diff(pools.offsets.to_numpy())
    rows = pools.flatten()
    of = np.repeat(np.arange(len(pools)), size)
    r, score, words = rows.field("r").to_numpy(zero_copy_only=False), rows.field("score").to_numpy(zero_copy_only=False), rows.field("tokens")
    order = np.lexsort((r, of))
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    shape = (len(pools), max(1, int(size.max(initial=0))))

    def table(values: np.ndarray, empty: float, kind: type) -> np.ndarray:
        out = np.full(shape, empty, dtype=kind)
        out[of, at] = values[order]
        return out

    row, scores = table(np.arange(len(of)), -1, np.int64), table(score, np.nan, float)
    identity, po = table(_codes(rows.field("identity")), -1, np.int64), table(_codes(rows.field("po")), -1, np.int64)
    held = row >= 0
    low, high = np.nanmin(scores, axis=1, keepdims=True), np.nanmax(scores, axis=1, keepdims=True)
    flat = high - low < 1e-12
    norm = np.where(flat, 1.0, (scores - low) / np.where(flat, 1.0, high - low))
    many = np.diff(words.offsets.to_numpy())
    padded = np.full((len(of), max(1, int(many.max(initial=0)))), -1, dtype=np.int32)
    padded[np.repeat(np.arange(len(of)), many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)] = _codes(words.flatten())
    # a word counts once
    padded.sort(axis=1)
    padded[:, 1:][padded[:, 1:] == padded[:, :-1]] = -1
    tokens, count = padded[row], np.where(held, (padded >= 0).sum(axis=1)[row], 0)
    every, taken, near = np.arange(len(pools)), [], None
    left = held.copy()
    for step in range(min(k, shape[1])):
        worth = np.where(left, norm if near is None else balance * norm - (1 - balance) * near, -np.inf)
        best = np.zeros(len(pools), dtype=np.int64) if step == 0 else worth.argmax(axis=1)
        taken.append(np.where(left[every, best], row[every, best], -1))
        left[every, best] = False
        mine = tokens[every, best]
        both = np.zeros(shape, dtype=np.int64)
        for word in range(mine.shape[1]):
            one = mine[:, word]
            both += ((tokens == one[:, None, None]) & (one >= 0)[:, None, None]).any(axis=2)
        union = count + count[every, best][:, None] - both
        share = np.where(both > 0, both / np.maximum(union, 1), 0.0)
        alike = 0.5 * (identity == identity[every, best][:, None]) + 0.3 * (po == po[every, best][:, None]) + 0.2 * share
        near = alike if near is None else np.maximum(near, alike)
    chosen = np.stack(taken, axis=1)
    found = chosen >= 0
    place = np.broadcast_to(np.arange(1, chosen.shape[1] + 1), chosen.shape)
    kept = pa.StructArray.from_arrays([rows.field("c").take(pa.array(chosen[found])), pa.array(place[found].astype(np.int32))], ["c", "place"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(found.sum(axis=1))].astype(np.int32)), kept)


def picked_batches(name: str, k: int = 10, balance: float = 0.6):
    """For mapInArrow: batches whose column ``name`` (arrays of c, r, score, identity, po, tokens) is replaced by what ``mmr`` takes of it, an array of c and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(low, AT_ONCE)
                i = batch.schema.get_field_index(name)
                columns = [pa.concat_arrays([c]) for c in batch.columns]
                columns[i] = _pick(columns[i], k, balance)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


PICKED = "array<struct<c: string, place: int>>"


def with_picked(pools: DataFrame, name: str = "rows", k: int = 10, balance: float = 0.6) -> DataFrame:
    """pools (a row for each query) with column ``name``, as ``candidates`` makes it, replaced by what ``mmr`` takes: an array of c and place."""
    kept = ", ".join(f"`{f.name}` {PICKED if f.name == name else f.dataType.simpleString()}" for f in pools.schema)
    return pools.mapInArrow(picked_batches(name, k, balance), kept)


def candidates() -> Column:
    """The rows of a group as ``with_picked`` reads them."""
    return F.collect_list(F.struct("c", "r", "score", "identity", "po", "tokens"))


def mmr(pool: DataFrame, k: int = 10, balance: float = 0.6, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """Maximal marginal relevance within each query's pool (at most 30 rows by construction).

    pool: q, c, r (rank by score), score, identity, po, tokens (array). The first
    is rank 1; each next maximises balance * minmax(score) less (1 - balance) * the
    largest similarity to those taken; the earlier rank wins ties. Similarity is
    0.5 same identity + 0.3 same order + 0.2 Jaccard of tokens.
    by: columns that name a query, q among them, where rows lie together by more than q.
    Returns q, c, place.
    """
    gathered = pool.groupBy(*by).agg(candidates().alias("rows")).select("q", "rows")
    return with_picked(gathered, "rows", k, balance).select("q", F.inline("rows"))
