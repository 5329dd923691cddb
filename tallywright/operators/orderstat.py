"""As-of order statistics: the r-th smallest value among the rows lo+1 .. hi of a key, in time order.

A tree over the values' ranks, FANOUT children a node. In every node the rows stand in
time order, and each place holds how many of the rows up to it go to each child. The
counts at two places give the children's counts between them, so a query goes down by
two lookups a level: no frame is ever sorted, and a median costs as much over a
million rows as over its logarithm. Places are counted in blocks of time with offsets,
so the root of a hot key is spread over tasks. All tables grow with the rows, and their files
are far smaller than their rows (counts compress well), so joins say that they merge;
by the files' sizes Spark would send them whole through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.shared import materialized

FANOUT = 16
#: Rows of a key, in time order, that are counted in one task.
BLOCK = 4096


def ranks(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """rows with rank (from 0), the place within the key in the order of by: one range sort, then counts of its parts as offsets."""
    parts = rows.repartitionByRange(key, *by).sortWithinPartitions(key, *by)
    held = materialized(parts.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "ranks")
    counts = held.groupBy(key, "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return held.join(offsets, [key, "part"]).withColumn("rank", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _level(rows: DataFrame, size: int) -> DataFrame:
    """key, node, pos, counts: for the nodes of so many ranks, the rows up to each place by child."""
    child = F.pmod(F.floor(F.col("rank") * FANOUT / size), F.lit(FANOUT))
    placed = rows.select("key", F.floor(F.col("rank") / size).alias("node"), child.alias("child"), "nth", F.floor((F.col("nth") - 1) / BLOCK).alias("block"))
    flags = [F.when(F.col("child") == i, 1).otherwise(0) for i in range(FANOUT)]
    run = Window.partitionBy("key", "node", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.select("key", "node", "block", F.row_number().over(run.orderBy("nth")).alias("at"), F.array(*[F.sum(f).over(run) for f in flags]).alias("inside"))
    earlier = Window.partitionBy("key", "node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("key", "node", "block").agg(F.count("*").alias("n"), *[F.sum(f).alias(f"n{i}") for i, f in enumerate(flags)])
    offsets = totals.select("key", "node", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.array(*[F.coalesce(F.sum(f"n{i}").over(earlier), F.lit(0)) for i in range(FANOUT)]).alias("before"))
    joined = inside.join(offsets.hint("merge"), ["key", "node", "block"])
    return joined.select("key", "node", (F.col("offset") + F.col("at")).alias("pos"), F.zip_with("before", "inside", lambda a, b: a + b).alias("counts"))


def _running(counts: Column) -> Column:
    """Sums of the first 1, 2, ... of an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(FANOUT)), lambda i: F.aggregate(F.slice(counts, F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x))


def order_statistics(rows: DataFrame, asks: DataFrame, value: str = "value") -> DataFrame:
    """asks (key, lo, hi, r) with the r-th smallest value of the rows lo+1 .. hi of the key.

    rows: key, nth (1, 2, ... in time order within the key), value. 1 <= r <= hi - lo
    must hold; other asks, and asks for keys without rows, are left out. Null values
    are smallest. Equal values may stand in any order, the result is the same.
    """
    ranked = materialized(ranks(rows.select("key", "nth", F.col(value).alias("value")), "key", ["value", "nth"]), "ranked")
    most = ranked.agg(F.max("rank")).first()[0]
    depth = 1
    while FANOUT**depth <= (most or 0):
        depth += 1
    wanted = asks.select("key", "lo", "hi", "r").distinct()
    now = wanted.where("r >= 1 and r <= hi - lo").select("key", F.col("lo").alias("lo0"), F.col("hi").alias("hi0"), F.col("r").alias("r0"), "lo", "hi", F.col("r").cast("long").alias("r"), F.lit(0).cast("long").alias("node"))
    none = F.array_repeat(F.lit(0).cast("long"), FANOUT)
    for level in range(depth):
        table = materialized(_level(ranked, FANOUT ** (depth - level)), "level")
        low = table.select("key", "node", F.col("pos").alias("lo"), F.col("counts").alias("low"))
        high = table.select("key", "node", F.col("pos").alias("hi"), F.col("counts").alias("high"))
        both = now.join(high.hint("merge"), ["key", "node", "hi"]).join(low.hint("merge"), ["key", "node", "lo"], "left").withColumn("low", F.coalesce("low", none))
        both = both.withColumn("run", _running(F.zip_with("high", "low", lambda a, b: a - b)))
        both = both.withColumn("child", F.size(F.filter("run", lambda x: x < F.col("r"))))
        now = both.select(
            "key", "lo0", "hi0", "r0", F.get("low", F.col("child")).alias("lo"), F.get("high", F.col("child")).alias("hi"),
            (F.col("r") - F.when(F.col("child") > 0, F.get("run", F.col("child") - 1)).otherwise(0)).alias("r"), (F.col("node") * FANOUT + F.col("child")).alias("node"),
        )
    found = now.join(ranked.select("key", F.col("rank").alias("node"), "value").hint("merge"), ["key", "node"])
    return asks.join(found.select("key", F.col("lo0").alias("lo"), F.col("hi0").alias("hi"), F.col("r0").alias("r"), "value").hint("merge"), ["key", "lo", "hi", "r"])


def quantiles(rows: DataFrame, frames: DataFrame, shares: dict[str, float], value: str = "value") -> DataFrame:
    """frames (key, lo, hi) with a column for each share: its quantile by linear interpolation between two order statistics; null for empty frames."""
    frames = frames.select("key", "lo", "hi").distinct()
    point = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(p) * (F.col("hi") - F.col("lo") - 1)).alias("at")) for n, p in shares.items()])
    asked = frames.where("hi > lo").select("key", "lo", "hi", F.explode(point).alias("x")).select("key", "lo", "hi", "x.name", "x.at", F.floor("x.at").alias("below"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.col("below") + 1, F.least(F.col("below") + 2, F.col("hi") - F.col("lo"))))).alias("r"))
    share = F.when(F.col("r") == F.col("below") + 1, F.when(F.col("below") + 1 == F.col("hi") - F.col("lo"), 1.0).otherwise(1.0 - (F.col("at") - F.col("below")))).otherwise(F.col("at") - F.col("below"))
    found = order_statistics(rows, asked, value).withColumn("part", share * F.col("value"))
    wide = found.groupBy("key", "lo", "hi").agg(*[F.sum(F.when(F.col("name") == n, F.col("part"))).alias(n) for n in shares])
    return frames.join(wide.hint("merge"), ["key", "lo", "hi"], "left")
