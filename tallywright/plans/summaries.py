"""Accuracy, series, bins, areas under curves and market benchmarks, with exact quantiles that no single task computes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.ranksum import area_under_curve, exact_quantiles
from tallywright.plans.base import Registry, catalog, top10
from tallywright.plans.retrieval import q4, s4
from tallywright.sources.shared import materialized

R = Registry()

APE_SQL = "abs(c_price - q_price) / q_price"
#: Every row of a table as one group.
ALL = "every"


def first_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first candidate of every query, its score and its error as a share of the price paid; prices of zero or less have none."""
    off = F.abs(F.col("c_price") - F.col("q_price"))
    rows = top10(spark, sf_dir).where("rank = 1").select("q", "score", off.alias("off"), F.when(F.col("q_price") > 0, off / F.col("q_price")).alias("ape"))
    return materialized(rows.withColumn(ALL, F.lit(1)), "first")


def within(share: float) -> Column:
    """Share of rows whose error is at most so much."""
    return F.avg((F.col("ape") <= share).cast("double"))


@R.query(
    "agg14_accuracy",
    f"""SELECT {s4('avg((ape <= 0.05)::INT::DOUBLE)')} AS acc5, {s4('avg((ape <= 0.10)::INT::DOUBLE)')} AS acc10, {s4('avg((ape <= 0.20)::INT::DOUBLE)')} AS acc20, {s4('avg(abs(c_price - q_price))')} AS mae, {s4('median(ape)')} AS mdape, {s4('avg(ape)')} AS mape FROM (SELECT *, {APE_SQL} AS ape FROM top10 WHERE rank = 1)""",
    "top10",
)
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy within 5, 10 and 20 %, mean errors, and the median error by counts of values."""
    rows = first_ranks(spark, sf_dir)
    means = rows.groupBy(ALL).agg(*[q4(within(s / 100)).alias(f"acc{s}") for s in (5, 10, 20)], q4(F.avg("off")).alias("mae"), q4(F.avg("ape")).alias("mape"))
    return means.join(exact_quantiles(rows, [ALL], "ape", {"mdape": 0.5}), ALL).withColumn("mdape", q4(F.col("mdape"))).drop(ALL)


SHARES = {"p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95}


@R.query(
    "agg15_series_summary",
    f"""SELECT count(*) AS n, {s4('avg(score)')} AS mean, {s4('stddev_pop(score)')} AS sd, {s4('min(score)')} AS low, {', '.join(f"{s4(f'quantile_cont(score, {p})')} AS {n}" for n, p in SHARES.items())}, {s4('max(score)')} AS high, {s4('quantile_cont(score, 0.75) - quantile_cont(score, 0.25)')} AS iqr FROM top10 WHERE rank = 1""",
    "top10",
)
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean, deviation, extremes, seven quantiles and the interquartile range of the first ranks' scores."""
    rows = first_ranks(spark, sf_dir)
    means = rows.groupBy(ALL).agg(F.count("*").alias("n"), q4(F.avg("score")).alias("mean"), q4(F.stddev_pop("score")).alias("sd"), q4(F.min("score")).alias("low"), q4(F.max("score")).alias("high"))
    found = exact_quantiles(rows, [ALL], "score", SHARES)
    return means.join(found.select(ALL, *[q4(F.col(n)).alias(n) for n in SHARES], q4(F.col("p75") - F.col("p25")).alias("iqr")), ALL).drop(ALL)


EDGES = {f"e{i}": i / 5 for i in range(6)}


@R.query(
    "agg16_quintile_bins",
    f"""WITH first AS (SELECT score, {APE_SQL} AS ape FROM top10 WHERE rank = 1), edge AS (SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(score, {p})' for p in EDGES.values())}])) AS e FROM first)
SELECT bin, count(*) AS n, {s4('min(score)')} AS low, {s4('max(score)')} AS high, {', '.join(f"{s4(f'100.0 * avg((ape <= {s / 100})::INT)')} AS acc{s}" for s in (5, 10, 20))} FROM (SELECT score, ape, 1 + len(list_filter(e[2:len(e) - 1], lambda x: x < score)) AS bin FROM first, edge) GROUP BY bin""",
    "top10",
)
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracies by fifths of the score; edges that fall together make one bin, and a score on an edge belongs below it."""
    rows = first_ranks(spark, sf_dir)
    edges = exact_quantiles(rows, [ALL], "score", EDGES).select(ALL, F.array_sort(F.array_distinct(F.array(*EDGES))).alias("e"))  # one row
    inner = F.slice("e", F.lit(2), F.greatest(F.size("e") - 2, F.lit(0)))
    binned = rows.join(F.broadcast(edges), ALL).withColumn("bin", 1 + F.size(F.filter(inner, lambda x: x < F.col("score"))))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), q4(F.min("score")).alias("low"), q4(F.max("score")).alias("high"), *[q4(100.0 * within(s / 100)).alias(f"acc{s}") for s in (5, 10, 20)])


@R.query(
    "agg17_auc_and_correlation",
    f"""SELECT {s4('(sum(CASE WHEN hit = 1 THEN r ELSE 0 END) - sum(hit) * (sum(hit) + 1) / 2.0) / (sum(hit) * (count(*) - sum(hit)) * 1.0)')} AS auc, {s4('corr(score, ape)')} AS corr
 FROM (SELECT score, ape, hit, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM (SELECT score, {APE_SQL} AS ape, ({APE_SQL} <= 0.10)::INT AS hit FROM top10 WHERE rank = 1))""",
    "top10",
)
def agg17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of the score for hits, from rank sums, and its correlation with the error."""
    rows = first_ranks(spark, sf_dir).withColumn("hit", (F.col("ape") <= 0.10).cast("int"))
    area = area_under_curve(rows, [ALL], "score", "hit").select(ALL, q4(F.col("auc")).alias("auc"))
    return rows.groupBy(ALL).agg(q4(F.corr("score", "ape")).alias("corr")).join(area, ALL).drop(ALL)


# ---- market


@R.query(
    "agg1_market_benchmark",
    f"SELECT code, uom, count(*) AS n, {s4('min(price)')} AS low, {s4('median(price)')} AS med, {s4('max(price)')} AS high, count(DISTINCT vendor) AS vendors, string_agg(DISTINCT place, '; ' ORDER BY place) AS places FROM (SELECT *, CASE WHEN vendor % 7 <> 0 THEN concat('site ', vendor % 5) END AS place FROM catalog) GROUP BY code, uom",
    "catalog",
)
def agg1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, lowest, median and highest price, sources and places of every item; places in order, without repetition."""
    rows = materialized(catalog(spark, sf_dir).select("code", "uom", "price", "vendor", F.when(F.col("vendor") % 7 != 0, F.concat(F.lit("site "), F.col("vendor") % 5)).alias("place")), "prices")
    sums = rows.groupBy("code", "uom").agg(F.count("*").alias("n"), q4(F.min("price")).alias("low"), q4(F.max("price")).alias("high"), F.count_distinct("vendor").alias("vendors"))
    places = rows.select("code", "uom", "place").distinct().groupBy("code", "uom").agg(F.array_join(F.array_sort(F.collect_list("place")), "; ").alias("places"))
    return sums.join(exact_quantiles(rows, ["code", "uom"], "price", {"med": 0.5}), ["code", "uom"]).join(places, ["code", "uom"]).withColumn("med", q4(F.col("med"))).withColumn("places", F.when(F.col("places") != "", F.col("places")))


OFFER = "CASE WHEN vendor % 3 = 0 THEN concat(code, '/', model) END"


@R.query(
    "mkt1_market_benchmark",
    f"""WITH wanted AS (SELECT DISTINCT code, model, uom, concat(code, '/', model) AS id FROM catalog), offer AS (SELECT {OFFER} AS id, uom, vendor, price, d, row_key FROM catalog),
 exact AS (SELECT id, uom, price, vendor FROM offer WHERE id IS NOT NULL AND price > 0 QUALIFY row_number() OVER (PARTITION BY id, uom, vendor ORDER BY d DESC, row_key DESC) = 1), found AS (SELECT id, uom, count(*) AS n, median(price) AS med, min(price) AS low, max(price) AS high FROM exact GROUP BY ALL)
SELECT code, model, w.uom, CASE WHEN f.id IS NULL THEN 'NO_EXACT_MATCH' WHEN n < 3 THEN 'INSUFFICIENT_SOURCES' ELSE 'OK' END AS status, coalesce(n, 0) AS sources, CASE WHEN n >= 3 THEN {s4('med')} END AS med, CASE WHEN n >= 3 THEN {s4('low')} END AS low, CASE WHEN n >= 3 THEN {s4('high')} END AS high FROM wanted w LEFT JOIN found f ON f.id = w.id AND f.uom = w.uom""",
    "catalog",
)
def mkt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market price of every item from offers that name it by its id: the newest of each source, three sources at least, else why not."""
    rows = materialized(catalog(spark, sf_dir).select("code", "model", "uom", "vendor", "price", "d", "row_key"), "offers")
    name = F.concat("code", F.lit("/"), "model")
    wanted = rows.select("code", "model", "uom", name.alias("id")).distinct()
    exact = rows.where((F.col("vendor") % 3 == 0) & (F.col("price") > 0)).groupBy(name.alias("id"), "uom", "vendor").agg(F.max_by("price", F.struct("d", "row_key")).alias("price"))
    exact = materialized(exact, "exact")
    sums = exact.groupBy("id", "uom").agg(F.count("*").alias("sources"), F.min("price").alias("low"), F.max("price").alias("high")).join(exact_quantiles(exact, ["id", "uom"], "price", {"med": 0.5}), ["id", "uom"])
    enough = F.col("sources") >= 3
    status = F.when(F.col("sources").isNull(), "NO_EXACT_MATCH").when(~enough, "INSUFFICIENT_SOURCES").otherwise("OK")
    return wanted.join(sums, ["id", "uom"], "left").select("code", "model", "uom", status.alias("status"), F.coalesce("sources", F.lit(0)).alias("sources"), *[F.when(enough, q4(F.col(c))).alias(c) for c in ("med", "low", "high")])


@R.query(
    "mkt2_fallback",
    f"""WITH h AS (SELECT code, model, uom, median(price) AS med, count(*) AS n FROM catalog WHERE d < DATE '2001-01-01' GROUP BY ALL), m AS (SELECT family, median(price) AS med FROM catalog WHERE d < DATE '2001-01-01' AND vendor % 3 = 0 GROUP BY ALL)
SELECT c.row_key, CASE WHEN n >= 3 AND h.med > 0 THEN 'HISTORY' WHEN m.med > 0 THEN 'MARKET' ELSE 'NONE' END AS source, {s4('CASE WHEN n >= 3 AND h.med > 0 THEN h.med WHEN m.med > 0 THEN m.med END')} AS price FROM catalog c LEFT JOIN h ON h.code = c.code AND h.model = c.model AND h.uom = c.uom LEFT JOIN m ON m.family = c.family WHERE c.d >= DATE '2001-01-01'""",
    "catalog",
)
def mkt2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price known from history if three rows or more give one above zero, else the market's, else none."""
    rows = materialized(catalog(spark, sf_dir).select("row_key", "code", "model", "uom", "family", "vendor", "price", "d"), "rows")
    before = F.col("d") < F.lit("2001-01-01").cast("date")
    keys = ["code", "model", "uom"]
    own = exact_quantiles(rows.where(before), keys, "price", {"own": 0.5}).join(rows.where(before).groupBy(*keys).agg(F.count("*").alias("n")), keys)
    market = exact_quantiles(rows.where(before & (F.col("vendor") % 3 == 0)), ["family"], "price", {"market": 0.5})
    first, second = F.when((F.col("n") >= 3) & (F.col("own") > 0), F.col("own")), F.when(F.col("market") > 0, F.col("market"))
    joined = rows.where(~before).join(own, keys, "left").join(market, "family", "left")
    return joined.select("row_key", F.when(first.isNotNull(), "HISTORY").when(second.isNotNull(), "MARKET").otherwise("NONE").alias("source"), q4(F.coalesce(first, second)).alias("price"))


QUERIES, ORACLES = R.queries, R.oracles
