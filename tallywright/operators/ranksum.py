"""Exact quantiles and rank sums of whole tables: counts by value, a range sort, and counts of its parts as offsets.

Rows are first counted by (key, value), so equal values travel as one. The counts are
sorted by range; each part adds up its own, and parts get the sums before them. A
quantile is then the one or two values whose counts reach its place. Neither a sort of
all rows in one task nor a map of all values of a group is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.shared import materialized


def cumulative(counted: DataFrame, keys: list[str], value: str, n: str = "n") -> DataFrame:
    """counted with ``before``, the rows of the key with smaller values, and ``total``, all rows of the key.

    counted: one row for each (keys, value), with n, the rows that have it. Rows with
    a null key or value are left out.
    """
    known = counted.dropna(subset=[*keys, value])
    parts = known.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33))
    held = materialized(parts, "values")
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*keys, "part").agg(F.sum(n).alias("in_part"))
    sums = sums.select(*keys, "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("offset"), F.sum("in_part").over(whole).alias("total"))
    inside = Window.partitionBy(*keys, "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    run = held.withColumn("inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(sums, [*keys, "part"])
    return run.withColumn("before", F.col("offset") + F.col("inside")).drop("row", "part", "offset", "inside")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys with a column for each share: the quantile of value by linear interpolation. Null values do not count; a key without values is not there."""
    found = cumulative(rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")), keys, value)
    own = F.col(value).cast("double")

    def part(share: float):
        at = F.lit(share) * (F.col("total") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("total") - 1)

        def holds(place):
            return (F.col("before") <= place) & (place < F.col("before") + F.col("n"))

        return F.when(holds(low), own * (1 - (at - low))).otherwise(0.0) + F.when(holds(high), own * (at - low)).otherwise(0.0)

    return found.groupBy(*keys).agg(*[F.sum(part(share)).alias(name) for name, share in shares.items()])


def area_under_curve(rows: DataFrame, keys: list[str], score: str, hit: str) -> DataFrame:
    """keys, auc: the chance that a hit scores above a miss, ties counting half; null where hits or misses are missing."""
    counted = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
    ranked = cumulative(counted, keys, score).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.sum(F.col("hits") * F.col("rank")).alias("ranks"))
    misses = F.col("n") - F.col("hits")
    return sums.select(*keys, F.when((F.col("hits") > 0) & (misses > 0), (F.col("ranks") - F.col("hits") * (F.col("hits") + 1) / 2) / (F.col("hits") * misses)).alias("auc"))
