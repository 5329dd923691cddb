"""Exact weighted top-k of cosines without all pairs: inverted index, suffix norms, seeded thresholds.

Vectors are sparse, of unit length, and meet only within their store. A vector's terms
stand in the order of the store, rarest first. From a term on, the norm of what is left
(its tail) bounds the dot product with any vector that shares no term before it. So a
vector whose k-th score is known to be t or more asks only for the terms with a tail of
t or more, and of those lists only for the entries whose own tail can make up the rest:
lists are split in bands of tails, and bands are joined by equality.

The threshold t comes from seeds: the neighbours of a vector in lists sorted by the
terms that follow, whose dots are computed exactly. Seeds decide what the search costs,
never what it finds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.shared import materialized

#: Bands of tails in an inverted list.
BANDS = 20
#: Terms of a vector, on average, up to which lists are made by pairs of terms.
SHORT = 12
#: Room for scores that are rounded to six places before they are compared.
SLACK = 2e-6
#: Vectors for each task over which small rows with much work are dealt, and numbers of the table in which a task multiplies.
EACH, CELLS = 2000, 1 << 21


def _index(vectors: DataFrame) -> DataFrame:
    """id, store, t (number of the term in its store), w, place (1: rarest term), tail."""
    terms = vectors.groupBy("store", "term").agg(F.count("*").alias("df")).withColumn("t", F.monotonically_increasing_id())
    rows = vectors.join(materialized(terms, "terms"), ["store", "term"])
    rarest = Window.partitionBy("id").orderBy("df", "t")
    rest = rarest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.select("id", "store", "t", "df", "w", F.row_number().over(rarest).alias("place"), F.sqrt(F.sum(F.col("w") * F.col("w")).over(rest)).alias("tail"))


def _short(index: DataFrame) -> bool:
    """Whether vectors have so few terms that lists of pairs of terms are short enough."""
    terms, ids = index.agg(F.count("*"), F.approx_count_distinct("id")).first()
    return terms <= SHORT * max(1, ids)


def _tasks(whole: DataFrame) -> int:
    """Tasks over which small rows with much work are dealt: by the number of vectors, as each task that writes has a file for every one that reads."""
    return max(4 * whole.sparkSession.sparkContext.defaultParallelism, whole.count() // EACH)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the row of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with ta, wa, tb, wb (terms and weights of two vectors) replaced by their dot product, some rows at a time in a table of row by term."""
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], schema=batch.schema)
        (ta, ra), (tb, rb) = _lists(batch.column("ta")), _lists(batch.column("tb"))
        wa, wb = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("wa", "wb"))
        codes, known = pd.factorize(np.concatenate([ta, tb]))
        ca, cb, wide = codes[: len(ta)], codes[len(ta) :], max(1, len(known))
        rows = max(1, min(batch.num_rows, CELLS // wide))
        table, dots = np.zeros(rows * wide), np.zeros(batch.num_rows)
        for low in range(0, batch.num_rows, rows):
            (i, j), (k, m) = np.searchsorted(ra, [low, low + rows]), np.searchsorted(rb, [low, low + rows])
            at = (ra[i:j] - low) * wide + ca[i:j]
            table[at] = wa[i:j]
            part = np.bincount(rb[k:m] - low, table[(rb[k:m] - low) * wide + cb[k:m]] * wb[k:m], minlength=rows)
            dots[low : low + rows] = part[: batch.num_rows - low]
            table[at] = 0.0
        kept = [c for c in batch.schema.names if c not in ("ta", "wa", "tb", "wb")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(dots)], names=[*kept, "dot"])


def _with_dots(pairs: DataFrame, whole: DataFrame, tasks: int | None = None) -> DataFrame:
    """pairs (a, b) with the dot product of their vectors. whole: id, terms (array of t and w). tasks: over which pairs are dealt."""
    left = whole.select(F.col("id").alias("a"), F.col("terms.t").alias("ta"), F.col("terms.w").alias("wa"))
    right = whole.select(F.col("id").alias("b"), F.col("terms.t").alias("tb"), F.col("terms.w").alias("wb"))
    # pairs are few bytes and much work: dealt by number, so that they are not put together again by their size
    both = pairs.repartition(tasks or _tasks(whole), "a").join(left, "a").join(right, "b")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in both.schema if f.name not in ("ta", "wa", "tb", "wb"))
    return both.mapInArrow(_multiply, f"{kept}, dot double")


def _seeds(index: DataFrame, lists: int, beside: int) -> DataFrame:
    """(a, b): each vector and its neighbours in the lists of its first terms, sorted by the terms that follow."""
    order = Window.partitionBy("id").orderBy("place").rowsBetween(1, 8)
    after = index.where("df > 1").withColumn("after", F.collect_list("t").over(order)).withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("place"))).where(F.col("nth") <= lists)
    # the term that follows is part of the key, so that no list is sorted in one task
    near = Window.partitionBy("store", "t", F.coalesce(F.get("after", F.lit(0)), F.lit(-1))).orderBy("after", "id")
    steps = [i for i in range(-beside, beside + 1) if i]
    found = after.select(F.col("id").alias("a"), F.array(*[F.lag("id", i).over(near) for i in steps]).alias("b")).select("a", F.explode("b").alias("b"))
    alone = index.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return found.where("b is not null").union(alone).distinct()


def thresholds(seeds: DataFrame, k: int, floor: float) -> DataFrame:
    """a, least: a score that the first k of a reach for sure. seeds: a, dot, n (rows that b stands for)."""
    by_dot = Window.partitionBy("a").orderBy(F.desc("dot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = seeds.withColumn("run", F.sum("n").over(by_dot))
    return run.groupBy("a").agg(F.greatest(F.max(F.when(F.col("run") >= k, F.col("dot"))), F.lit(floor)).alias("least"))


def entries(index: DataFrame, pairs: bool) -> DataFrame:
    """id, store, t, u, reach: the lists in which a vector stands, and what a dot with a vector met there is bounded by.

    By single terms (u is -1), t is the first shared term and reach the tail from it.
    By pairs, t and u are the first two shared terms and reach the norm of t and the
    tail from u; or t is the only shared term, u is -1 and reach its weight. A dot is
    at most the product of both reaches, whichever list the two vectors meet in first.
    """
    if not pairs:
        return index.select("id", "store", "t", F.lit(-1).cast("long").alias("u"), F.col("tail").alias("reach"))
    alone = index.select("id", "store", "t", F.lit(-1).cast("long").alias("u"), F.col("w").alias("reach"))
    later = Window.partitionBy("id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    with_later = index.withColumn("next", F.collect_list(F.struct("t", "tail")).over(later)).select("id", "store", "t", "w", F.explode("next").alias("x"))
    return alone.unionByName(with_later.select("id", "store", "t", F.col("x.t").alias("u"), F.sqrt(F.col("w") * F.col("w") + F.col("x.tail") * F.col("x.tail")).alias("reach")))


def meetings(lists: DataFrame, least: DataFrame, tasks: int | None = None) -> DataFrame:
    """(a, b, least) of the pairs that meet in a list where their reaches make up the threshold of a; pairs may repeat. tasks: over which lists are dealt by vector."""

    def band(reach: Column) -> Column:
        return F.least(F.floor(reach * BANDS), F.lit(BANDS - 1)).cast("int")

    lists = lists.repartition(tasks or _tasks(lists), "id")
    asking = lists.join(least, lists["id"] == least["a"]).where(F.col("reach") >= F.col("least") - SLACK)
    needed = F.greatest((F.col("least") - SLACK) / F.col("reach") - 1e-9, F.lit(0.0))
    asking = asking.select("a", "store", "t", "u", "least", "reach", F.explode(F.sequence(band(needed), F.lit(BANDS - 1))).alias("band"))
    listed = lists.select("store", "t", "u", F.col("id").alias("b"), F.col("reach").alias("reach_b"), band(F.col("reach")).alias("band"))
    return asking.join(listed, ["store", "t", "u", "band"]).where(F.col("reach") * F.col("reach_b") >= F.col("least") - SLACK).select("a", "b", "least")


def nearest(vectors: DataFrame, weights: DataFrame, k: int, floor: float = 0.0, lists: int = 4, beside: int = 3) -> DataFrame:
    """(a, b, dot) of every pair of one store that may be among the first of a.

    vectors: id, store, term, w of unit vectors with weights above zero; weights: id,
    n, the rows that a vector stands for. b may be among the first of a while the
    vectors with larger dots stand for fewer than k rows together; all such pairs
    with a dot of ``floor`` or more are returned, ties and the pair of a vector with
    itself among them, and some pairs beyond. Ids without terms are in no pair.
    floor must be above zero, or vectors without a common term would count too.
    """
    if floor <= 0:
        raise ValueError("floor must be above zero")
    index = materialized(_index(vectors), "index")
    whole = materialized(index.groupBy("id").agg(F.collect_list(F.struct("t", "w")).alias("terms")), "whole")
    tasks = _tasks(whole)
    seeds = _with_dots(_seeds(index, lists, beside), whole, tasks).join(weights.select(F.col("id").alias("b"), "n"), "b", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = materialized(thresholds(seeds, k, floor), "least")
    met = meetings(materialized(entries(index, _short(index)), "lists"), least, tasks).distinct()
    return _with_dots(met, whole, tasks).where(F.col("dot") >= F.col("least") - SLACK).select("a", "b", "dot")
