"""Huber regression of y on x by group, slope, intercept and scale together, from sums over Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.sources.shared import materialized


def huber_fits(rows: DataFrame, group: str, x: str = "x", y: str = "y", bend: float = 1.35, ridge: float = 1e-4, rounds: int = 20) -> DataFrame:
    """group, n, slope, intercept, scale of the line that minimises the sum of scale + scale * H(residual / scale), plus ridge * slope ** 2.

    H is the square up to ``bend`` and linear beyond. Each round reweighs the rows by
    the line and scale before it and adds up six sums a group; a group's rows are
    never together in one task, and a group of any size costs one row a round.
    Groups start from least squares; groups of one value of x get a slope of zero.
    Rows with nulls are left out.
    """
    held = materialized(rows.select(group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(), "points")

    def line(sums: DataFrame, extra: Column) -> DataFrame:
        w, over = F.col("w"), F.col("w") * F.col("sxx") - F.col("sx") ** 2 + extra * F.col("w")
        slope = F.when(over > 1e-12, (F.col("w") * F.col("sxy") - F.col("sx") * F.col("sy")) / over).otherwise(0.0)
        return sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / w)

    def sums(frame: DataFrame, weight: Column, *more: Column) -> DataFrame:
        parts = {"w": weight, "sx": weight * F.col("x"), "sy": weight * F.col("y"), "sxx": weight * F.col("x") ** 2, "sxy": weight * F.col("x") * F.col("y")}
        return frame.groupBy(group).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in parts.items()], *more)

    start = line(sums(held, F.lit(1.0)), F.lit(0.0)).select(group, "slope", "intercept")
    off = F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")
    spread = held.join(start, group).groupBy(group).agg(F.greatest(F.sqrt(F.avg(off * off)), F.lit(1e-9)).alias("scale"))
    fit = materialized(start.join(spread, group), "fit")
    for _ in range(rounds):
        far = F.abs(off) > bend * F.col("scale")
        weight = F.when(far, bend * F.col("scale") / F.abs(off)).otherwise(1.0)
        near_squares, n_far = F.sum(F.when(~far, off * off).otherwise(0.0)).alias("near"), F.sum(far.cast("double")).alias("far")
        found = sums(held.join(fit, group), weight, near_squares, n_far, F.first("scale").alias("scale"))
        room = F.col("n") - bend**2 * F.col("far")
        scale = F.when(room > 0, F.greatest(F.sqrt(F.col("near") / room), F.lit(1e-9))).otherwise(F.col("scale"))
        fit = materialized(line(found, ridge * F.col("scale")).select(group, "n", "slope", "intercept", scale.alias("scale")), "fit")
    return fit
