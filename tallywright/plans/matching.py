"""Volunteers (customers) matched with campaigns (nations). The oracles state each rule again in SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import matching as M
from tallywright.plans.base import Registry, read
from tallywright.plans.retrieval import q4, s4

R = Registry()

_VOLUNTEER = """c_custkey AS v, c_nationkey AS place_key, c_name AS name,
 {compact}([CASE WHEN c_custkey % 2 = 0 THEN 'Teaching' END, CASE WHEN c_custkey % 3 = 0 THEN 'First Aid' END, CASE WHEN c_custkey % 5 = 0 THEN ' Driving ' END, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN 'aid' END]) AS skills,
 CASE WHEN c_custkey % 11 = 0 THEN {empty} ELSE {compact}([lower(c_mktsegment), CASE WHEN c_custkey % 4 = 0 THEN 'education' END]) END AS interests,
 CASE c_custkey % 7 WHEN 1 THEN '' WHEN 2 THEN 'Weekends only' WHEN 3 THEN 'weekday evenings' WHEN 4 THEN 'Flexible' WHEN 5 THEN 'Available' WHEN 6 THEN 'mornings' END AS availability,
 CASE WHEN c_custkey % 19 <> 0 THEN (c_nationkey * 7) % 60 + (c_custkey % 13) * 0.05E0 END AS lat, CASE WHEN c_custkey % 19 <> 0 THEN c_nationkey * 5 + (c_custkey % 17) * 0.05E0 END AS lng,
 (c_custkey % 100) * 1.0E0 AS impact, CASE c_custkey % 3 WHEN 0 THEN 0.9E0 WHEN 1 THEN 75.0E0 ELSE 1.0E0 END AS attendance, c_custkey % 4 <> 0 AS verified, c_custkey % 4 AS active, (c_custkey * 37) % 100 / 100.0E0 AS sim"""
_CAMPAIGN = """n_nationkey AS k, concat('Help ', n_name) AS title, CASE n_nationkey % 4 WHEN 1 THEN ['first aid', 'driver'] WHEN 2 THEN ['Teaching ', 'baking'] WHEN 3 THEN ['aid', 'driving', 'furniture'] ELSE {empty} END AS required,
 CASE n_nationkey % 4 WHEN 0 THEN '2024-06-15' WHEN 1 THEN '2024-06-17T09:00' WHEN 2 THEN 'some weekend' ELSE '2024-06-16T10:00' END AS day, CASE n_nationkey % 5 WHEN 0 THEN 'Medical' WHEN 1 THEN 'Environmental' WHEN 2 THEN 'Education' WHEN 3 THEN 'Building' ELSE 'Other' END AS category,
 'education for furniture and machinery' AS description, (n_nationkey * 7) % 60 + 0.2E0 AS c_lat, n_nationkey * 5 + 0.2E0 AS c_lng"""


def _in_duck(columns: str) -> str:
    return columns.replace("{compact}([", "list_filter([").replace("])", "], lambda x: x IS NOT NULL)").replace("{empty}", "[]::VARCHAR[]")


KM = "6371 * 2 * atan2(sqrt(h), sqrt(1 - h))"
PAIRS = f"""pair AS (SELECT *, CASE WHEN h IS NULL THEN 5.0 ELSE {KM} END AS km, CASE WHEN h IS NOT NULL THEN {KM} END AS known_km FROM (SELECT *, power(sin(radians(lat - c_lat) / 2), 2) + cos(radians(c_lat)) * cos(radians(lat)) * power(sin(radians(lng - c_lng) / 2), 2) AS h
 FROM (SELECT {_in_duck(_VOLUNTEER)} FROM customer) v JOIN (SELECT {_in_duck(_CAMPAIGN)} FROM nation) c ON k = place_key))"""


def _in_spark(columns: str) -> str:
    return re.sub(r"\[([^\]]*)\]", r"array(\1)", columns).replace("{compact}", "array_compact").replace("{empty}", "cast(array() AS array<string>)")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every volunteer with the campaign of their place: one pair a volunteer."""
    v = read(spark, sf_dir, "customer").selectExpr(*_split(_in_spark(_VOLUNTEER)))
    c = read(spark, sf_dir, "nation").selectExpr(*_split(_in_spark(_CAMPAIGN)))
    far = M.haversine(F.col("c_lat"), F.col("c_lng"), F.col("lat"), F.col("lng"))
    return v.join(c, v["place_key"] == c["k"]).withColumns({"km": F.coalesce(far, F.lit(5.0)), "known_km": far})


def _split(columns: str) -> list[str]:
    """The select list's entries: commas outside parentheses and quotes divide them."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(columns):
        quoted ^= ch == "'"
        depth += 0 if quoted else (ch == "(") - (ch == ")")
        if ch == "," and not depth and not quoted:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


RULES = f"""{PAIRS}, wanted AS (SELECT *, list_transform(list_filter(required, lambda x: x <> ''), lambda x: lower(trim(x))) AS req FROM pair),
firsts AS (SELECT *, list_transform(req, lambda r: list_filter(skills, lambda s: contains(lower(trim(s)), r) OR contains(r, lower(trim(s))))[1]) AS f FROM wanted),
matched AS (SELECT *, CASE WHEN len(req) = 0 THEN skills[1:3] ELSE list_filter(f, lambda s, i: s IS NOT NULL AND list_position(f, s) = i) END AS hits FROM firsts),
ruled AS (SELECT *, CASE WHEN len(req) = 0 THEN 1.0 ELSE round_even(len(hits) / len(req)::DOUBLE, 3) END AS ratio, coalesce(isodow(TRY_CAST(split_part(day, 'T', 1) AS DATE)) >= 6, false) AS weekend FROM matched),
freed AS (SELECT *, coalesce(availability, '') = '' OR contains(lower(availability), 'available') OR contains(lower(availability), 'flexible') OR (weekend AND contains(lower(availability), 'weekend')) OR (NOT weekend AND contains(lower(availability), 'weekday')) AS free FROM ruled)"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, ratio = M.skill_match(F.col("required"), F.col("skills"))
    return pairs(spark, sf_dir).withColumns({"hits": hits, "ratio": ratio, "free": M.is_available(F.col("availability"), M.is_weekend(F.col("day")))})


@R.query("str2_skill_match", f"WITH {RULES} SELECT v, array_to_string(hits, '|') AS matched, len(hits) AS n, ratio FROM ruled")
def str2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills of each volunteer that a campaign's requirements overlap, and their share."""
    return _ruled(spark, sf_dir).select("v", F.array_join("hits", "|").alias("matched"), F.size("hits").alias("n"), "ratio")


SHARE = "CASE WHEN len(interests) = 0 THEN 0.5 ELSE len(list_filter(interests, lambda i: contains(lower(category || ' ' || title || ' ' || description), i))) / len(interests)::DOUBLE END"


def _share() -> F.Column:
    return M.interest_share(F.col("interests"), F.concat_ws(" ", "category", "title", "description"))


@R.query("str3_interest_share", f"WITH {PAIRS} SELECT v, {s4(SHARE)} AS share FROM pair")
def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a volunteer's interests that the campaign's texts name."""
    return pairs(spark, sf_dir).select("v", q4(_share()).alias("share"))


@R.query("dat2_availability_rule", f"WITH {RULES} SELECT v, weekend, free FROM freed")
def dat2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a volunteer's availability text allows the campaign's day."""
    weekend = M.is_weekend(F.col("day"))
    return pairs(spark, sf_dir).select("v", weekend.alias("weekend"), M.is_available(F.col("availability"), weekend).alias("free"))


FREE_SCORE = """CASE WHEN coalesce(trim(availability), '') = '' OR trim(day) = '' THEN 0.5 WHEN contains(lower(trim(day)), lower(trim(availability))) OR contains(lower(trim(availability)), lower(trim(day))) THEN 1.0
 WHEN regexp_matches(lower(availability), 'weekend|saturday|sunday') AND regexp_matches(lower(day), 'weekend|saturday|sunday') THEN 1.0 ELSE 0.5 END::DOUBLE"""


@R.query("dat3_availability_score", f"WITH {PAIRS} SELECT v, {FREE_SCORE} AS score FROM pair")
def dat3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability as a score of two texts."""
    return pairs(spark, sf_dir).select("v", M.availability_score(F.col("availability"), F.col("day")).alias("score"))


EVENT_SKILL = "CASE WHEN len(req) = 0 THEN 0.5 ELSE len(list_intersect(list_distinct(req), list_transform(skills, lambda s: lower(trim(s))))) / len(list_distinct(req))::DOUBLE END"


@R.query(
    "sco1_event_score",
    f"""WITH {RULES}, part AS (SELECT v, sim, {EVENT_SKILL} AS skill, {SHARE} AS interest, CASE WHEN known_km IS NULL THEN 0.5 ELSE exp(-known_km / 15) END AS near, {FREE_SCORE} AS free FROM wanted)
SELECT v, floor(greatest(0, least(100, 100 * (0.40 * sim + 0.30 * skill + 0.15 * interest + 0.10 * near + 0.05 * free))) * 100 + 0.500001) / 100 AS score, {s4('100 * skill')} AS skills, {s4('100 * interest')} AS interests, {s4('100 * near')} AS proximity, 100 * free AS availability FROM part""",
)
def sco1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event score of a volunteer with its breakdown; missing parts count as one half."""
    wanted = F.array_distinct(M.folded(F.col("required")))
    skill = F.when(F.size(wanted) == 0, 0.5).otherwise(F.size(F.array_intersect(wanted, M.folded(F.col("skills")))) / F.size(wanted))
    near = F.when(F.col("known_km").isNull(), 0.5).otherwise(F.exp(-F.col("known_km") / 15))
    parts = pairs(spark, sf_dir).select("v", "sim", skill.alias("skill"), _share().alias("interest"), near.alias("near"), M.availability_score(F.col("availability"), F.col("day")).alias("free"))
    total = 100 * (0.40 * F.col("sim") + 0.30 * F.col("skill") + 0.15 * F.col("interest") + 0.10 * F.col("near") + 0.05 * F.col("free"))
    shown = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)) * 100 + 0.500001) / 100
    return parts.select("v", shown.alias("score"), q4(100 * F.col("skill")).alias("skills"), q4(100 * F.col("interest")).alias("interests"), q4(100 * F.col("near")).alias("proximity"), (100 * F.col("free")).alias("availability"))


WEIGHTS = """weight(kind, w_sim, w_biz, w_att, w_free, w_imp, w_ver) AS (VALUES ('medical', 0.35, 0.65, 0.20, 0.15, 0.25, 0.20), ('environmental', 0.45, 0.55, 0.15, 0.10, 0.20, 0.10), ('education', 0.40, 0.60, 0.15, 0.15, 0.25, 0.15)),
scored AS (SELECT f.*, w.*, least(1.0, greatest(0.1, 0.30::DOUBLE * ratio + 0.15::DOUBLE * exp(-km / 35) + w_free::DOUBLE * CASE WHEN free THEN 1.0 ELSE 0.5 END + w_imp::DOUBLE * CASE WHEN impact = 0 THEN 0.85 WHEN impact > 1 THEN impact / 100 ELSE impact END + w_att::DOUBLE * CASE WHEN attendance <= 1 THEN attendance ELSE attendance / 100 END + w_ver::DOUBLE * CASE WHEN verified THEN 1.0 ELSE 0.7 END)) AS business
 FROM freed f JOIN weight w ON w.kind = CASE WHEN lower(category) IN ('medical', 'environmental', 'education') THEN lower(category) ELSE 'environmental' END)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    business = M.business_score(F.col("category"), F.col("ratio"), F.col("km"), F.col("free"), F.col("impact"), F.col("attendance"), F.col("verified"))
    return _ruled(spark, sf_dir).withColumn("business", business)


@R.query("sco2_business_score", f"WITH {RULES}, {WEIGHTS} SELECT v, {s4('business')} AS business FROM scored")
def sco2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business score of a volunteer with the weights of the campaign's category."""
    return _scored(spark, sf_dir).select("v", q4(F.col("business")).alias("business"))


@R.query("sco3_final_score", f"WITH {RULES}, {WEIGHTS} SELECT v, {s4('w_sim::DOUBLE * sim + w_biz::DOUBLE * business')} AS final FROM scored")
def sco3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity and business score weighted by category; unknown ones count as environmental."""
    final = M.category_weight(F.col("category"), "similarity", 0.40) * F.col("sim") + M.category_weight(F.col("category"), "business", 0.60) * F.col("business")
    return _scored(spark, sf_dir).select("v", q4(final).alias("final"))


INTERESTED = "len(interests) = 0 OR len(list_filter(interests, lambda i: contains(lower(category), i) OR contains(i, lower(category)))) > 0"


@R.query(
    "sco4_breakdown",
    f"""WITH {RULES}, {WEIGHTS} SELECT v, trunc(least(99, greatest(60, (0.5 * sim + 0.5 * ratio) * 100 + 1e-9)))::INT AS skills, CASE WHEN {INTERESTED} THEN 92 ELSE 78 END AS interests, CASE WHEN free THEN 95 ELSE 75 END AS availability, trunc(exp(-km / 35) * 100)::INT AS proximity,
 least(99, greatest(68, round_even({s4('w_sim::DOUBLE * sim + w_biz::DOUBLE * business')} * 100, 0)))::INT AS match FROM scored""",
)
def sco4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown percentages: clamped and truncated parts, and the match in [68, 99]."""
    category = F.lower("category")
    interested = (F.size("interests") == 0) | F.exists("interests", lambda i: M.overlapping(category, i))
    final = q4(M.category_weight(F.col("category"), "similarity", 0.40) * F.col("sim") + M.category_weight(F.col("category"), "business", 0.60) * F.col("business"))
    return _scored(spark, sf_dir).select(
        "v",
        F.least(F.lit(99.0), F.greatest(F.lit(60.0), (0.5 * F.col("sim") + 0.5 * F.col("ratio")) * 100 + 1e-9)).cast("int").alias("skills"),
        F.when(interested, 92).otherwise(78).alias("interests"),
        F.when(F.col("free"), 95).otherwise(75).alias("availability"),
        (F.exp(-F.col("km") / 35) * 100).cast("int").alias("proximity"),
        F.least(F.lit(99.0), F.greatest(F.lit(68.0), F.bround(final * 100, 0))).cast("int").alias("match"),
    )


def _step(name: str, before: str, test: str, small: int) -> str:
    return f"{name} AS (SELECT * EXCLUDE (n_all, n_pass) FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n_all, count(*) FILTER ({test}) OVER (PARTITION BY k) AS n_pass FROM {before}) WHERE ({test}) OR n_all <= {small} OR n_pass = 0)"


CHAIN = f"{RULES}, {_step('s1', 'freed', 'ratio >= 0', 3)}, {_step('s2', 's1', 'free', 2)}, {_step('s3', 's2', 'km <= 50', 3)}, {_step('s4', 's3', 'active < 3', 0)}"


@R.query("rul1_rule_chain", f"WITH {CHAIN} SELECT k, v FROM s4")
def rul1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill, availability, distance and load rules in turn; a rule that would leave a campaign empty keeps all."""
    rows = _ruled(spark, sf_dir)
    for test, small in ((F.col("ratio") >= 0, 3), (F.col("free"), 2), (F.col("km") <= 50, 3), (F.col("active") < 3, 0)):
        rows = M.keep_or_all(rows, "k", test, small)
    return rows.select("k", "v")


BOTH_WAYS = "list_filter(list_transform(required, lambda x: lower(x)), lambda r: len(list_filter(skills, lambda s: contains(lower(s), r) OR contains(r, lower(s)))) > 0)"


def _required_met() -> F.Column:
    return F.filter(F.transform("required", F.lower), lambda r: F.exists("skills", lambda s: M.overlapping(F.lower(s), r)))


@R.query(
    "fbk1_fallback_score",
    f"""WITH {PAIRS}, met AS (SELECT v, {BOTH_WAYS} AS met, len(list_filter(interests, lambda i: contains(lower(category), i) OR contains(i, lower(category)))) > 0 AS liked FROM pair)
SELECT v, least(98, greatest(65, 60 + 15 * len(met) + CASE WHEN liked THEN 15 ELSE 0 END)) AS score, 'Matches your skills in ' || CASE WHEN len(met) > 0 THEN array_to_string(met, ', ') ELSE 'community service' END || ' and location.' AS reason FROM met""",
)
def fbk1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback score and reason of a campaign for a volunteer."""
    liked = F.exists("interests", lambda i: M.overlapping(F.lower("category"), i))
    rows = pairs(spark, sf_dir).select("v", _required_met().alias("met"), liked.alias("liked"))
    score = F.least(F.lit(98), F.greatest(F.lit(65), 60 + 15 * F.size("met") + F.when(F.col("liked"), 15).otherwise(0)))
    skills = F.when(F.size("met") > 0, F.array_join("met", ", ")).otherwise("community service")
    return rows.select("v", score.alias("score"), F.concat(F.lit("Matches your skills in "), skills, F.lit(" and location.")).alias("reason"))


@R.query(
    "fbk2_volunteer_fallback",
    f"""WITH {PAIRS}, met AS (SELECT *, {BOTH_WAYS} AS met, CASE WHEN known_km IS NULL THEN 5.0 ELSE floor(known_km * 10 + 0.5) / 10 END AS km1, lower(coalesce(availability, '')) = 'available' AS free FROM pair)
SELECT v, km1 AS distance, least(99, greatest(68, 65 + 12 * len(met) + CASE WHEN len(list_filter(interests, lambda i: contains(lower(category), i))) > 0 THEN 10 ELSE 0 END + CASE WHEN free THEN 5 ELSE 0 END)) AS score, least(98, 70 + 10 * len(met)) AS skills, CASE WHEN len(interests) > 0 THEN 85 ELSE 75 END AS interests,
 CASE WHEN free THEN 95 ELSE 80 END AS availability, least(99, greatest(65, floor(100 / (1 + km1 / 15) + 0.5)))::INT AS proximity FROM met""",
)
def fbk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fallback score of a volunteer for a campaign, with distance and breakdown."""
    distance = F.coalesce(F.floor(F.col("known_km") * 10 + 0.5) / 10, F.lit(5.0))
    free = F.lower(F.coalesce("availability", F.lit(""))) == "available"
    liked = F.exists("interests", lambda i: F.contains(F.lower("category"), i))
    rows = pairs(spark, sf_dir).withColumns({"met": _required_met(), "distance": distance, "free": free, "liked": liked})
    score = 65 + 12 * F.size("met") + F.when(F.col("liked"), 10).otherwise(0) + F.when(F.col("free"), 5).otherwise(0)
    return rows.select(
        "v",
        "distance",
        F.least(F.lit(99), F.greatest(F.lit(68), score)).alias("score"),
        F.least(F.lit(98), 70 + 10 * F.size("met")).alias("skills"),
        F.when(F.size("interests") > 0, 85).otherwise(75).alias("interests"),
        F.when(F.col("free"), 95).otherwise(80).alias("availability"),
        F.least(F.lit(99), F.greatest(F.lit(65), F.floor(100 / (1 + F.col("distance") / 15) + 0.5))).cast("int").alias("proximity"),
    )


@R.query(
    "exp1_reason",
    f"""WITH {RULES} SELECT v, CASE WHEN len(hits) > 0 THEN 'Strong match based on your ' || array_to_string(hits, ', ') || ' skills and campaign requirements.' ELSE 'Recommended based on semantic similarity between your interests and the campaign.' END AS event_reason,
 'Matches your skills in ' || CASE WHEN len(hits) > 0 THEN array_to_string(hits[1:2], ', ') ELSE 'community service' END || ' and location.' AS short_reason,
 'Strong match for ' || title || ' with verified skills in ' || CASE WHEN len(hits) > 0 THEN array_to_string(hits, ', ') ELSE 'community outreach' END || ', located ' || printf('%.1f', floor(km * 10 + 0.5) / 10) || ' km away.' AS volunteer_reason,
 name || ' is ' || CASE WHEN free THEN 'available' ELSE 'not available' END || ' and ' || CASE WHEN verified THEN 'verified' ELSE 'not verified' END || '.' AS status_reason FROM freed""",
)
def exp1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reason texts by template."""
    hits, some = F.array_join("hits", ", "), F.size("hits") > 0
    return _ruled(spark, sf_dir).select(
        "v",
        F.when(some, F.concat(F.lit("Strong match based on your "), hits, F.lit(" skills and campaign requirements."))).otherwise("Recommended based on semantic similarity between your interests and the campaign.").alias("event_reason"),
        F.concat(F.lit("Matches your skills in "), F.when(some, F.array_join(F.slice("hits", 1, 2), ", ")).otherwise("community service"), F.lit(" and location.")).alias("short_reason"),
        F.concat(F.lit("Strong match for "), "title", F.lit(" with verified skills in "), F.when(some, hits).otherwise("community outreach"), F.lit(", located "), F.format_string("%.1f", F.floor(F.col("km") * 10 + 0.5) / 10), F.lit(" km away.")).alias("volunteer_reason"),
        F.concat("name", F.lit(" is "), F.when(F.col("free"), "available").otherwise("not available"), F.lit(" and "), F.when(F.col("verified"), "verified").otherwise("not verified"), F.lit(".")).alias("status_reason"),
    )


QUERIES, ORACLES = R.queries, R.oracles
