"""Truncated SVD of sparse rows: randomised range finder with power iterations over Spark.

Rows stay where they are. What moves is the term side, features x (rank + extra)
numbers, whose size the parameters bound (about 20 MB at 35,000 features and rank 64):
it goes to the tasks as a broadcast, and each task returns its share of A'(A B), which
is summed by blocks of terms. The driver only orthogonalises that matrix. Signs are
fixed: the entry of largest size of every right vector is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.sources.shared import materialized

#: Entries of rows that are multiplied at once.
CHUNK = 50_000
#: Terms whose sums travel together.
BLOCK = 512


@dataclass
class Factors:
    """Singular values, and right vectors as columns (features x rank)."""

    values: np.ndarray
    right: np.ndarray


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """(columns, weights, row of each entry, first row, rows) of consecutive rows with about CHUNK entries."""
    cols, weights = batch.column("cols"), batch.column("weights")
    ends = np.asarray(cols.offsets, np.int64)
    c, w = np.asarray(cols.values, np.int64), np.asarray(weights.values, np.float64)
    at, n = 0, len(cols)
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1)
        to = min(to, n)
        own = slice(ends[at], ends[to])
        yield c[own], w[own], np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), at, to - at
        at = to


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed by key, for keys below n."""
    out = np.zeros((n, values.shape[1]))
    if len(keys):
        order = np.argsort(keys, kind="stable")
        found, first = np.unique(keys[order], return_index=True)
        out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


def _products(batch: pa.RecordBatch, basis: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Chunks with A B of their rows."""
    for c, w, row, first, n in _chunks(batch):
        yield c, w, row, _sums(row, w[:, None] * basis[c], n), first


def _round(basis, features: int):
    """Each task's share of A'(A B), by blocks of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        total = np.zeros((features, b.shape[1]))
        for batch in batches:
            for c, w, row, y, _ in _products(batch, b):
                total += _sums(c, w[:, None] * y[row], features)
        blocks = range(0, features, BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([total[k : k + BLOCK].tobytes() for k in blocks], pa.binary())], ["block", "part"])

    return run


def _gram(basis):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = basis.value
        total = np.zeros((b.shape[1], b.shape[1]))
        for batch in batches:
            for *_, y, _ in _products(batch, b):
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "part"])

    return run


def _total(parts: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"block": [parts["block"].iloc[0]], "part": [sum(np.frombuffer(p) for p in parts["part"]).tobytes()]})


def _summed(rows: DataFrame, make, width: int) -> np.ndarray:
    parts = rows.mapInArrow(make, "block int, part binary").groupBy("block").applyInPandas(_total, "block int, part binary").collect()
    return np.concatenate([np.frombuffer(r["part"]).reshape(-1, width) for r in sorted(parts, key=lambda r: r["block"])]) if parts else np.zeros((0, width))


def truncated_svd(rows: DataFrame, features: int, rank: int = 64, extra: int = 8, rounds: int = 5, seed: int = 42) -> Factors:
    """Factors of the sparse matrix whose rows are (cols array<int>, weights array<double>), columns 0 .. features-1.

    rank is cut to the number of features. A matrix without rows has values of zero.
    """
    context = rows.sparkSession.sparkContext
    width = min(features, rank + extra)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    for _ in range(rounds):
        held = context.broadcast(basis)
        total = _summed(rows, _round(held, features), width)
        held.unpersist()
        if len(total):
            basis = np.linalg.qr(total)[0]
    held = context.broadcast(basis)
    gram = _summed(rows, _gram(held), width)
    held.unpersist()
    values, turn = np.linalg.eigh(gram if len(gram) else np.zeros((width, width)))
    order = np.argsort(values)[::-1][: min(rank, width)]
    right = basis @ turn[:, order]
    right *= np.where(right[np.abs(right).argmax(0), np.arange(right.shape[1])] < 0, -1.0, 1.0)
    return Factors(np.sqrt(np.maximum(values[order], 0)), right)


def project(rows: DataFrame, factors: Factors) -> DataFrame:
    """id, vector: each row times the right vectors, scaled to length one; a row without weight gives zeros."""
    held = rows.sparkSession.sparkContext.broadcast(factors.right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, y, first in _products(batch, held.value):
                size = np.linalg.norm(y, axis=1, keepdims=True)
                y = y / np.where(size > 1e-12, size, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, len(y)), pa.array(list(y), pa.list_(pa.float64()))], ["id", "vector"])

    return rows.select("id", "cols", "weights").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>")


def tfidf(texts: DataFrame, rows: int, least: int, most: int) -> DataFrame:
    """id, copies, e: sublinear TF-IDF of unit length, an array of (term, col, weight), over the terms of at least ``least`` rows, the ``most`` most used of them.

    texts: id, copies (rows that have this text) and term, one row for each use, those
    of an id in one task. col numbers the terms kept, a table that ``most`` bounds; it
    goes to the uses, so that a common term's uses do not meet in one task. An id
    without any such term has no row.
    """
    from pyspark.sql import Window

    uses = texts.groupBy("id", "copies", "term").agg(F.count("*").alias("tf"))
    seen = uses.groupBy("term").agg(F.sum("copies").alias("df"), F.sum(F.col("tf") * F.col("copies")).alias("n")).where(F.col("df") >= least).orderBy(F.desc("n"), "term").limit(most)
    kept = seen.select("term", "df", (F.row_number().over(Window.orderBy("term")) - 1).alias("col"))  # at most ``most`` rows
    x = (1 + F.log("tf")) * (F.log(F.lit(1.0 + rows) / (1 + F.col("df"))) + 1)
    weighted = uses.join(F.broadcast(kept), "term").select("id", "copies", "term", "col", x.alias("x"))
    whole = weighted.groupBy("id", "copies").agg(F.array_sort(F.collect_list(F.struct("col", "term", "x"))).alias("e"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    return whole.select("id", "copies", F.transform("e", lambda t: F.struct(t["term"].alias("term"), t["col"].alias("col"), (t["x"] / F.col("size")).alias("weight"))).alias("e"))


def embed(weights: DataFrame, rank: int = 64) -> tuple[DataFrame, Factors, DataFrame]:
    """Unit vectors (id, vector) of the rows of weights (id, copies, e with col and weight) in the first ``rank`` right vectors; the factors and the rows behind them.

    A row with copies weighs in the factors as all of them, by the root of their number
    as a factor of its own weights; its vector is made once.
    """
    rows = materialized(weights.select("id", "copies", F.col("e.col").cast("array<int>").alias("cols"), F.col("e.weight").alias("weights")), "sparse")
    features = (rows.agg(F.max(F.array_max("cols"))).first()[0] or 0) + 1
    heavy = rows.select("cols", F.transform("weights", lambda w: w * F.sqrt("copies")).alias("weights"))
    factors = truncated_svd(heavy, features, rank)
    return project(rows, factors), factors, rows


def composite(word: DataFrame, char: DataFrame) -> DataFrame:
    """id, vector: the mean of two unit vectors, scaled to length one; a row that has one of them alone keeps it."""
    both = word.select("id", F.col("vector").alias("x")).join(char.select("id", F.col("vector").alias("y")), "id", "full")
    size = F.greatest(F.size("x"), F.size("y"))
    none = F.array_repeat(F.lit(0.0), size)
    mean = F.zip_with(F.coalesce("x", none), F.coalesce("y", none), lambda a, b: 0.5 * a + 0.5 * b)
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, v: s + v * v))
    return both.withColumn("mean", mean).withColumn("length", length).select("id", F.when(F.col("length") > 1e-12, F.transform("mean", lambda v: v / F.col("length"))).otherwise(F.col("mean")).alias("vector"))
