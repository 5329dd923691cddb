"""Rules that match volunteers with campaigns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the volunteer score and of categories.
DEFAULT_WEIGHTS = {"skill": 0.30, "proximity": 0.15, "availability": 0.15, "impact": 0.15, "attendance": 0.15, "verified": 0.10}
CATEGORY_WEIGHTS = {
    "medical": {"similarity": 0.35, "business": 0.65, "attendance": 0.20, "availability": 0.15, "impact": 0.25, "verified": 0.20},
    "environmental": {"similarity": 0.45, "business": 0.55, "attendance": 0.15, "availability": 0.10, "impact": 0.20, "verified": 0.10},
    "education": {"similarity": 0.40, "business": 0.60, "attendance": 0.15, "availability": 0.15, "impact": 0.25, "verified": 0.15},
}
UNKNOWN_CATEGORY = "environmental"
WEEKEND_WORDS = ("weekend", "saturday", "sunday")


def folded(values: Column) -> Column:
    """Entries trimmed and in lower case, without nulls and empty ones."""
    return F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), lambda x: F.lower(F.trim(x)))


def overlapping(a: Column, b: Column) -> Column:
    """One text contains the other."""
    return F.contains(a, b) | F.contains(b, a)


def skill_match(required: Column, skills: Column) -> tuple[Column, Column]:
    """(matched skills, ratio): for each requirement the first skill that overlaps it, each once.

    Without requirements the first three skills match and the ratio is 1. Skills
    keep their spelling. The ratio is rounded half-even to three places.
    """
    wanted = folded(required)
    first = F.transform(wanted, lambda r: F.get(F.filter(skills, lambda s: overlapping(F.lower(F.trim(s)), r)), F.lit(0)))
    matched = F.array_distinct(F.filter(first, lambda s: s.isNotNull()))
    none = F.size(wanted) == 0
    return F.when(none, F.slice(skills, 1, 3)).otherwise(matched), F.when(none, 1.0).otherwise(F.bround(F.size(matched) / F.size(wanted), 3))


def is_weekend(date: Column) -> Column:
    """Whether an ISO date, perhaps with a time, is a Saturday or Sunday; unreadable dates are not."""
    return F.coalesce(F.weekday(F.try_to_date(F.split_part(date, F.lit("T"), F.lit(1)), "yyyy-MM-dd")) >= 5, F.lit(False))


def is_available(availability: Column, weekend: Column) -> Column:
    """Free by the text: nothing said, available, flexible, or the kind of day named."""
    said = F.lower(F.coalesce(availability, F.lit("")))
    return (said == "") | F.contains(said, F.lit("available")) | F.contains(said, F.lit("flexible")) | F.when(weekend, F.contains(said, F.lit("weekend"))).otherwise(F.contains(said, F.lit("weekday")))


def availability_score(availability: Column, date: Column) -> Column:
    """1 where one text contains the other or both name a weekend; else, and where one is missing, 0.5."""
    a, d = F.trim(F.lower(F.coalesce(availability, F.lit("")))), F.trim(F.lower(F.coalesce(date, F.lit(""))))

    def weekend(x: Column) -> Column:
        return x.rlike("|".join(WEEKEND_WORDS))

    return F.when((a == "") | (d == ""), 0.5).when(overlapping(a, d) | (weekend(a) & weekend(d)), 1.0).otherwise(0.5)


def interest_share(interests: Column, text: Column) -> Column:
    """Share of interests that stand in the text; 0.5 without interests."""
    n = F.size(interests)
    return F.when(n == 0, 0.5).otherwise(F.size(F.filter(interests, lambda i: F.contains(F.lower(text), i))) / n)


def category_weight(category: Column, name: str, default: float) -> Column:
    """A weight of the category, or of the unknown category's; the default where categories have none of that name."""
    found = F.lit(CATEGORY_WEIGHTS[UNKNOWN_CATEGORY].get(name, default))
    for kind, weights in CATEGORY_WEIGHTS.items():
        found = F.when(F.lower(category) == kind, weights.get(name, default)).otherwise(found)
    return found


def business_score(category: Column, overlap: Column, km: Column, free: Column, impact: Column, attendance: Column, verified: Column) -> Column:
    """Weighted volunteer score in [0.1, 1]; a missing or zero impact counts as 85."""
    raw = F.when(impact.isNull() | (impact == 0), 85.0).otherwise(impact)
    parts = {
        "skill": overlap,
        "proximity": F.exp(-km / 35.0),
        "availability": F.when(free, 1.0).otherwise(0.5),
        "impact": F.when(raw > 1, raw / 100).otherwise(raw),
        "attendance": F.when(attendance <= 1, attendance).otherwise(attendance / 100),
        "verified": F.when(verified, 1.0).otherwise(0.7),
    }
    total = sum((category_weight(category, k, DEFAULT_WEIGHTS[k]) * v for k, v in parts.items()), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), total))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Kilometres between two places on a sphere of 6371 km."""
    p, q, dp, dl = F.radians(lat1), F.radians(lat2), F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.sin(dp / 2) ** 2 + F.cos(p) * F.cos(q) * F.sin(dl / 2) ** 2
    return 6371.0 * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def keep_or_all(rows: DataFrame, group: str, passes: Column, small: int = 0) -> DataFrame:
    """The rows of each group that pass; all rows of a group that has at most ``small``, or in which none passes.

    Rows are counted by a partial aggregate; the counts, one row a group, are joined back.
    """
    flagged = rows.withColumn("passes", passes.cast("int"))
    counts = flagged.groupBy(group).agg(F.count("*").alias("n_all"), F.sum("passes").alias("n_pass"))
    kept = flagged.join(counts, group).where((F.col("passes") == 1) | (F.col("n_all") <= small) | (F.col("n_pass") == 0))
    return kept.drop("passes", "n_all", "n_pass")


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with ``place`` in their group."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
