"""Joins of sets and dictionaries by equality: minimum overlap by rarest members, and longest keys by runs of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlapping(asks: DataFrame, offers: DataFrame, need: Column, members: str = "tokens") -> DataFrame:
    """(q, e, overlap): pairs whose sets share at least ``need`` members.

    asks: q and a set; offers: e and a set; need: a column of asks of 1 or more. A set
    of n members that must share k with another has one of its n - k + 1 rarest in
    it, whichever they are; only these are joined, and the pairs found are counted
    on their whole sets. Frequent members are joined only by sets that hold little else.
    """
    heard = offers.select("e", F.explode(members).alias("member"))
    often = heard.groupBy("member").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("q").orderBy(F.coalesce("df", F.lit(0)), "member")
    said = asks.select("q", need.alias("need"), F.size(members).alias("n"), F.explode(members).alias("member")).join(often, "member", "left")
    first = said.withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.col("n") - F.col("need") + 1)
    pairs = first.select("q", "member").join(heard, "member").select("q", "e").distinct()
    both = pairs.join(asks.select("q", need.alias("need"), F.col(members).alias("a")), "q").join(offers.select("e", F.col(members).alias("b")), "e")
    return both.withColumn("overlap", F.size(F.array_intersect("a", "b"))).where(F.col("overlap") >= F.col("need")).select("q", "e", "overlap")


def containing(asks: DataFrame, offers: DataFrame, members: str = "ids") -> DataFrame:
    """(q, e): pairs where the set of q, which is not empty, lies within that of e."""
    asks = asks.where(F.size(members) > 0)
    return overlapping(asks, offers, F.size(members), members).select("q", "e")


def longest_keys(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """id with the key found in its text: the earliest pass, in it the longest key, then the first by order of characters.

    texts: id, text; keys: key, pass (small numbers first) and further columns, which
    come along. Every run of characters as long as some key is looked up by
    equality; the lengths of keys are few, whatever their number. Texts without a key
    are left out; a key counts once, in its earliest pass.
    """
    known = keys.where(F.col("key") != "")
    lengths = known.select(F.length("key").alias("size")).distinct()
    sizes = sorted(r["size"] for r in lengths.collect())  # one number for each length of a key
    if not sizes:
        return texts.select("id").join(known.select("*").limit(0), F.lit(False))
    runs = F.flatten(F.array(*[_runs(size) for size in sizes]))
    said = texts.select("id", F.explode(F.array_distinct(runs)).alias("key"))
    others = [c for c in known.columns if c not in ("key", "pass")]
    found = said.join(known, "key").groupBy("id").agg(F.min(F.struct("pass", (-F.length("key")).alias("short"), "key", *others)).alias("at"))
    return found.select("id", "at.key", "at.pass", *[F.col(f"at.{c}").alias(c) for c in others])


def _runs(size: int) -> Column:
    text = F.col("text")
    long = F.length(text) >= size
    return F.when(long, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))
