"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import discard, materialize

#: Parts that the neighbours of one node are dealt into.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (u, m). The neighbours of a hub are dealt over several keys."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    copies = least.withColumn("salt", F.explode(F.array(*[F.lit(salt).cast("long") for salt in range(SALTS)])))
    return salted.join(copies, ["u", "salt"]).select("u", "v", "m")


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal for equal sets of edges."""
    folded: Column = F.xxhash64("u", "v").cast("decimal(38, 0)")
    return tuple(edges.agg(F.count("*"), F.sum(folded)).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b: long, not null).

    component is the smallest id reachable. The smallest neighbour of each node is a
    partial aggregate, joined back to the edges by node and salt, so that no task
    holds all neighbours of a hub. Every round is written to the shared folder, and
    the round before is deleted. Repeated edges and loops do not matter; an empty
    table gives an empty result.
    """
    current = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(current)
    while mark[0]:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(after)
        discard(current)
        current = after
        if mark == before:
            break
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(current.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
