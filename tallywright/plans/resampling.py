"""Bootstrap intervals from outcome cells, and a diversity gate tuned in two folds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.operators.diversity import candidates, with_picked
from tallywright.operators.ranksum import exact_quantiles
from tallywright.plans.base import TOGETHER, Registry, top10
from tallywright.plans.retrieval import mmr_input, pair_similarity, q4
from tallywright.sources.shared import materialized

R = Registry()

REPLICATES, SEED = 1000, 42


def bootstrap(outcomes: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """One row: rates of a and b, of their difference, and 2.5 and 97.5 percentiles over resamples of the rows.

    outcomes: a and b, 0 or 1, of the same query under two rankings. Drawing n rows
    with replacement draws the counts of the four outcomes from a multinomial
    distribution, so a replicate costs four numbers, whatever the rows. Replicate k
    uses the generator seeded by (seed, k). Without rows all is null.
    """
    cells = {(r["a"], r["b"]): r["count"] for r in outcomes.where("a is not null and b is not null").groupBy("a", "b").count().collect()}  # four rows
    counts = np.array([[cells.get((a, b), 0) for b in (0, 1)] for a in (0, 1)], np.int64)
    n = int(counts.sum())
    spark = outcomes.sparkSession

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            drawn = np.array([np.random.default_rng([seed, k]).multinomial(n, counts.ravel() / n) if n else [0, 0, 0, 0] for k in frame["id"]]).reshape(-1, 4) / max(n, 1)
            yield pd.DataFrame({"a": drawn[:, 2] + drawn[:, 3], "b": drawn[:, 1] + drawn[:, 3], "delta": drawn[:, 1] - drawn[:, 2]})

    rates = spark.range(replicates if n else 0).mapInPandas(draw, "a double, b double, delta double")
    own = {"a": counts[1].sum(), "b": counts[:, 1].sum(), "delta": counts[0, 1] - counts[1, 0]}
    out = [F.lit(float(own[c]) / n if n else None).cast("double").alias(c) for c in own]
    for c in own:
        out += [F.percentile(c, F.lit(p)).alias(f"{c}_{name}") for name, p in (("low", 0.025), ("high", 0.975))]
    return rates.agg(F.lit(n).cast("long").alias("queries"), *out)


def _hit() -> Column:
    return (F.abs(F.col("c_price") - F.col("q_price")) <= 0.10 * F.col("q_price")).cast("int")


@R.query("agg25_bootstrap")
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rates of the first rank and of the median-priced candidate, and of the difference, with 95 % intervals of 1000 resamples."""
    every = Window.partitionBy("q")
    rows = top10(spark, sf_dir).select("q", "rank", _hit().alias("hit"), F.row_number().over(every.orderBy("c_price", "rank")).alias("place"), F.count("*").over(every).alias("n"))
    pairs = rows.groupBy("q").agg(F.max(F.when(F.col("rank") == 1, F.col("hit"))).alias("a"), F.max(F.when(F.col("place") == F.floor((F.col("n") + 1) / 2), F.col("hit"))).alias("b"))
    found = bootstrap(pairs)
    return found.select("queries", *[q4(F.col(c)).alias(c) for c in found.columns if c != "queries"])


# Shares whose quantiles are tried, landmarks, and least numbers of orders.
SHARES = (0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90)
LANDMARKS, ORDERS = (0.9273, 0.9619, 0.9892), (7, 8)


def tune_gate(signals: DataFrame) -> DataFrame:
    """One row for each fold: the rule that gains most hits on the other fold, and what it does on this one.

    signals: fold (1 or 2), sim (largest similarity of two of the first ten), orders
    (distinct orders among them), base and diverse (whether either ten hold a hit). A
    rule takes the diverse ten where sim is at most a threshold, and orders, if asked
    for, at least a number. All thresholds are summed in one pass; the first of equal
    gains wins, smaller thresholds first, rules on orders last. A fold without rows to
    learn from takes no rule.
    """
    held = materialized(signals, "signals")
    quantiles = {r["fold"]: [r[f"s{i}"] for i in range(len(SHARES))] for r in exact_quantiles(held, ["fold"], "sim", {f"s{i}": s for i, s in enumerate(SHARES)}).collect()}  # two rows
    gain = F.col("diverse") - F.col("base")
    rules = {}
    for fold, values in quantiles.items():
        thresholds = sorted({round(float(t), 4) for t in (*values, *LANDMARKS)})
        rules[fold] = [("sim_only", t, None) for t in thresholds] + [("composite_sim_and_po", t, p) for t in LANDMARKS for p in ORDERS]

    def fires(rule: tuple) -> Column:
        return (F.col("sim") <= rule[1]) & (F.lit(True) if rule[2] is None else F.col("orders") >= rule[2])

    best = {}
    for fold, tried in rules.items():
        sums = held.where(F.col("fold") == fold).agg(*[F.sum(F.when(fires(r), gain).otherwise(0)).alias(f"r{i}") for i, r in enumerate(tried)]).first()
        top = max(range(len(tried)), key=lambda i: (sums[f"r{i}"], -i))
        best[3 - fold] = (tried[top], sums[f"r{top}"])
    rows = []
    for fold in (1, 2):
        rule, net = best.get(fold, (("none", None, None), 0))
        test = held.where(F.col("fold") == fold)
        fired = fires(rule) if rule[1] is not None else F.lit(False)
        rows.append(test.agg(
            F.lit(fold).alias("fold"), F.lit(rule[0]).alias("rule"), F.lit(rule[1]).cast("double").alias("sim_threshold"), F.lit(rule[2]).cast("int").alias("order_threshold"), F.lit(net).cast("long").alias("train_gain"), F.count("*").alias("queries"),
            F.coalesce(F.sum(fired.cast("long")), F.lit(0)).alias("triggered"), F.coalesce(F.sum(F.col("base").cast("long")), F.lit(0)).alias("base_hits"), F.coalesce(F.sum(F.col("diverse").cast("long")), F.lit(0)).alias("diverse_hits"), F.coalesce(F.sum(F.when(fired, F.col("diverse")).otherwise(F.col("base")).cast("long")), F.lit(0)).alias("selective_hits"),
        ))
    return rows[0].unionByName(rows[1])


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``tune_gate`` reads, of every query; its candidates lie in one task and are gathered once."""
    first = F.col("r") <= 10
    one = mmr_input(spark, sf_dir, _hit().alias("hit")).groupBy(*TOGETHER).agg(
        pair_similarity(10).alias("sim"), F.size(F.collect_set(F.when(first, F.col("po")))).cast("long").alias("orders"), F.max(F.when(first, F.col("hit"))).alias("base"),
        candidates().alias("rows"), F.collect_list(F.struct("c", "hit")).alias("hits"),
    )
    one = with_picked(one.select("q", "sim", "orders", "base", "hits", "rows")).withColumn("taken", F.col("rows.c"))
    diverse = F.array_max(F.transform(F.filter("hits", lambda h: F.array_contains("taken", h["c"])), lambda h: h["hit"]))
    fold = (F.pmod(F.xxhash64("q", F.lit(SEED)), F.lit(2)) + 1).cast("int")
    return one.select("q", fold.alias("fold"), F.coalesce("sim", F.lit(0.0)).alias("sim"), "orders", "base", diverse.alias("diverse"))


@R.query("div5_tuned_gate")
def div5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of diversity tuned on one half of the queries and judged on the other, both ways."""
    return tune_gate(signals(spark, sf_dir))


QUERIES, ORACLES = R.queries, R.oracles
