"""Windows, reranking, diversity and evaluation over the candidate pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.plans.base import TOGETHER, Registry, top10

R = Registry()


def q4(x: str) -> str:
    """Half-up to four places; the margin keeps exact halves together in every engine."""
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


HIT10 = "abs(c_price - q_price) <= 0.10 * q_price"

# ---- the flagship: pool statistics, reliability and conformal interval of each query's benchmark price
R.sql(
    "flagship_benchmark",
    f"""SELECT q, n, median_price, spread, days_1,
 CASE WHEN n < 3 OR spread > 0.85 THEN 'LOW' WHEN n >= 5 AND spread <= 0.35 AND days_1 <= 1095 THEN 'HIGH' ELSE 'MEDIUM' END AS reliability,
 {q4('greatest(0.01, median_price * exp(-1.5404))')} AS low, {q4('median_price * exp(1.5404)')} AS high
 FROM (SELECT q, count(*) AS n, {q4('median(c_price)')} AS median_price, {q4('stddev_pop(c_lp)')} AS spread, min(days) AS days_1 FROM {{pool}} GROUP BY q)""",
)
R.sql("cfi1_interval", f"""SELECT q, {q4('greatest(0.01, c_price * exp(-1.5404))')} AS low, {q4('c_price * exp(1.5404)')} AS high FROM {{top10}} WHERE rank = 1""")
R.sql(
    "cau1_causality_guard",
    "SELECT count(*) AS pairs, coalesce(sum(CASE WHEN c_d >= q_d THEN 1 ELSE 0 END), 0) AS violations FROM {pool}",
)
R.sql("rel_summary", """SELECT reliability, count(*) AS n FROM (SELECT q, CASE WHEN count(*) < 3 OR stddev_pop(c_lp) > 0.85 THEN 'LOW' WHEN count(*) >= 5 AND stddev_pop(c_lp) <= 0.35 THEN 'HIGH' ELSE 'MEDIUM' END AS reliability FROM {top10} GROUP BY q) t GROUP BY reliability""")

# ---- windows
R.sql("win1_minmax_zero", f"""SELECT q, rank, {q4('CASE WHEN hi = lo THEN 0.0 ELSE (score - lo) / (hi - lo) END')} AS norm FROM (SELECT q, rank, score, min(score) OVER (PARTITION BY q) AS lo, max(score) OVER (PARTITION BY q) AS hi FROM {{top10}}) t""")
R.sql("win2_minmax_one", f"""SELECT q, rank, {q4('CASE WHEN hi - lo < 1e-9 THEN 1.0 ELSE (score - lo) / (hi - lo) END')} AS norm FROM (SELECT q, rank, score, min(score) OVER (PARTITION BY q) AS lo, max(score) OVER (PARTITION BY q) AS hi FROM {{top10}}) t""")
R.sql("win3_price_rank_desc", """SELECT q, rank, row_number() OVER (PARTITION BY q ORDER BY c_price DESC, rank) - 1 AS price_rank FROM {top10}""")
R.sql("win4_softmax", f"""SELECT q, rank, {q4('e / sum(e) OVER (PARTITION BY q)')} AS weight FROM (SELECT q, rank, exp((score - max(score) OVER (PARTITION BY q)) / 0.1) AS e FROM {{top10}}) t""")
R.sql(
    "win5_gaps_and_z",
    f"""SELECT q, rank, {q4('first - score')} AS gap_first, {q4('best - score')} AS gap_best, {q4('(score - mean) / greatest(sd, 1e-9)')} AS z
 FROM (SELECT q, rank, score, first_value(score) OVER (PARTITION BY q ORDER BY rank) AS first, max(score) OVER (PARTITION BY q) AS best, avg(score) OVER (PARTITION BY q) AS mean, stddev_pop(score) OVER (PARTITION BY q) AS sd FROM {{top10}}) t WHERE sd > 1e-6""",
)
R.sql("win6_price_percentile", f"""SELECT q, rank, {q4('(row_number() OVER (PARTITION BY q ORDER BY c_price, rank) - 1) / greatest(count(*) OVER (PARTITION BY q) - 1, 1) * 1.0')} AS pct FROM {{top10}}""",
      f"""SELECT q, rank, {q4('(row_number() OVER (PARTITION BY q ORDER BY c_price, rank) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY q) - 1, 1)')} AS pct FROM {{top10}}""")
R.sql(
    "win7_weighted_median",
    f"""SELECT q, {q4('min(c_price)')} AS price FROM (SELECT q, c_price, sum(w) OVER (PARTITION BY q ORDER BY c_price, rank ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY q) AS total
 FROM (SELECT q, c_price, rank, floor((score * exp(-days / 730.0E0)) * 1000000 + 0.5) AS w FROM {{top10}}) t) u WHERE run * 2 >= total GROUP BY q""",
)
R.sql(
    "win8_price_support",
    """SELECT a.q, a.rank, sum(CASE WHEN abs(b.c_price - a.c_price) <= 0.05 * a.c_price THEN 1 ELSE 0 END) AS s5, sum(CASE WHEN abs(b.c_price - a.c_price) <= 0.10 * a.c_price THEN 1 ELSE 0 END) AS s10,
 sum(CASE WHEN abs(b.c_price - a.c_price) <= 0.20 * a.c_price THEN 1 ELSE 0 END) AS s20 FROM {top10} a JOIN {top10} b ON a.q = b.q GROUP BY a.q, a.rank""",
)
R.sql(
    "win9_price_kde",
    f"""SELECT a.q, a.rank, {q4('sum(exp(-0.5 * power((a.c_lp - b.c_lp) / 0.05, 2)))')} AS kde5, {q4('sum(exp(-0.5 * power((a.c_lp - b.c_lp) / 0.10, 2)))')} AS kde10 FROM {{top10}} a JOIN {{top10}} b ON a.q = b.q GROUP BY a.q, a.rank""",
)


def _with_peers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The first ten of every query, each with ``peers``, the values of a column in all of them (ten at most)."""
    return top10(spark, sf_dir).select("q", "rank", name, F.collect_list(name).over(Window.partitionBy(*TOGETHER)).alias("peers"))


def win8_price_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the query, itself among them, within 5, 10 and 20 % of each one's price."""

    def near(share: float) -> Column:
        return F.size(F.filter("peers", lambda p: F.abs(p - F.col("c_price")) <= share * F.col("c_price"))).cast("long")

    return _with_peers(spark, sf_dir, "c_price").select("q", "rank", *[near(share).alias(n) for n, share in (("s5", 0.05), ("s10", 0.10), ("s20", 0.20))])


def win9_price_kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel densities of the query's log prices at each candidate's, in two widths."""

    def density(width: float) -> Column:
        sums = F.aggregate("peers", F.lit(0.0), lambda s, p: s + F.exp(-0.5 * F.pow((F.col("c_lp") - p) / width, F.lit(2))))
        return F.floor(sums * 10000 + 0.500001) / 10000

    return _with_peers(spark, sf_dir, "c_lp").select("q", "rank", density(0.05).alias("kde5"), density(0.10).alias("kde10"))


# pairs of candidates are made within a query's own array, not by a join
R.queries |= {"win8_price_support": win8_price_support, "win9_price_kde": win9_price_kde}
R.sql("win10_duplicate_texts", f"""SELECT q, c_text, count(*) AS n, {q4('median(c_price)')} AS med, {q4('stddev_pop(c_lp)')} AS sd FROM {{pool}} GROUP BY q, c_text HAVING count(*) > 1""")
R.sql("win11_median_distance", f"""SELECT q, rank, {q4('1 / (1 + abs(c_price - med) / med)')} AS near FROM (SELECT q, rank, c_price, median(c_price) OVER (PARTITION BY q) AS med FROM {{top10}}) t""")
R.sql("win12_top3_median_distance", f"""SELECT q, {q4('median(abs(c_lp - lp1))')} AS dist FROM (SELECT q, rank, c_lp, first_value(c_lp) OVER (PARTITION BY q ORDER BY rank) AS lp1 FROM {{top10}}) t WHERE rank <= 3 GROUP BY q""")
R.sql("win13_positional", f"""SELECT q, pool_rank, {q4('pool_rank / n')} AS share FROM (SELECT q, pool_rank * 1.0E0 AS pool_rank, count(*) OVER (PARTITION BY q) AS n FROM {{pool}}) t""")
R.sql("win15_rank_margin", f"""SELECT q, {q4('score - next')} AS margin FROM (SELECT q, rank, score, lead(score) OVER (PARTITION BY q ORDER BY rank) AS next FROM {{top10}}) t WHERE rank = 1 AND next IS NOT NULL""")

# ---- evaluation
R.sql(
    "agg13_rank_coverage",
    f"""SELECT count(*) AS queries, sum(CASE WHEN first <= 1 THEN 1 ELSE 0 END) AS top1, sum(CASE WHEN first <= 3 THEN 1 ELSE 0 END) AS top3, sum(CASE WHEN first <= 5 THEN 1 ELSE 0 END) AS top5,
 sum(CASE WHEN first <= 10 THEN 1 ELSE 0 END) AS top10, {q4('avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 / first END)')} AS mrr, sum(CASE WHEN first > 1 THEN 1 ELSE 0 END) AS recoverable
 FROM (SELECT q, min(CASE WHEN {HIT10} THEN rank END) AS first FROM {{top10}} GROUP BY q) t""",
)
R.sql(
    "agg19_cohort_effect",
    f"""SELECT {q4('avg(CASE WHEN hit = 1 THEN spread END)')} AS mean_hit, {q4('avg(CASE WHEN hit = 0 THEN spread END)')} AS mean_miss,
 {q4('(avg(CASE WHEN hit = 1 THEN spread END) - avg(CASE WHEN hit = 0 THEN spread END)) / sqrt((var_pop(CASE WHEN hit = 1 THEN spread END) + var_pop(CASE WHEN hit = 0 THEN spread END)) / 2)')} AS d
 FROM (SELECT q, stddev_pop(c_lp) AS spread, max(CASE WHEN rank = 1 AND {HIT10} THEN 1 ELSE 0 END) AS hit FROM {{top10}} GROUP BY q) t""",
)
R.sql(
    "agg30_ranking_metrics",
    f"""SELECT {q4('avg(p3)')} AS precision3, {q4('avg(p10)')} AS precision10, {q4('avg(rr)')} AS mrr, {q4('avg(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0.0 END)')} AS ndcg FROM (
 SELECT q, sum(CASE WHEN rank <= 3 THEN hit ELSE 0 END) / 3.0E0 AS p3, sum(hit) / 10.0E0 AS p10, max(hit * 1.0E0 / rank) AS rr, sum(hit / ln(rank + 1)) AS dcg, sum(CASE WHEN irank <= hits THEN 1 / ln(irank + 1) ELSE 0.0E0 END) AS ideal
 FROM (SELECT q, rank, rank AS irank, CASE WHEN {HIT10} THEN 1 ELSE 0 END AS hit, sum(CASE WHEN {HIT10} THEN 1 ELSE 0 END) OVER (PARTITION BY q) AS hits FROM {{top10}}) t GROUP BY q) u""",
)

# ---- reranking and decisions
R.sql("srt4_argmax_ties", """SELECT q, rank FROM (SELECT q, rank, row_number() OVER (PARTITION BY q ORDER BY floor(score * 10) DESC, rank) AS k FROM {top10}) t WHERE k = 1""")
R.sql(
    "srt10_gap_override",
    """SELECT q, CASE WHEN alt - s1 > 0.05 THEN alt_rank ELSE 1 END AS chosen FROM (SELECT q, max(CASE WHEN rank = 1 THEN sim END) AS s1, max(CASE WHEN rank > 1 THEN sim END) AS alt, min(CASE WHEN rank > 1 AND sim = m THEN rank END) AS alt_rank
 FROM (SELECT q, rank, sim, max(CASE WHEN rank > 1 THEN sim END) OVER (PARTITION BY q) AS m FROM (SELECT q, rank, floor(least(q_qty, c_qty) / greatest(q_qty, c_qty) * 10000 + 0.500001) / 10000 AS sim FROM {top10}) r) s GROUP BY q) t WHERE alt IS NOT NULL""",
)
ATTR = "0.25 * CASE WHEN q_code = c_code THEN 1 ELSE 0 END + 0.65 * CASE WHEN q_model = c_model THEN 1 ELSE 0 END + 0.10 * CASE WHEN q_text = c_text THEN 1 ELSE 0 END"
R.sql("rrk1_attribute_rerank", f"""SELECT q, c, {q4('attr')} AS attr FROM (SELECT q, c, attr, row_number() OVER (PARTITION BY q ORDER BY attr DESC, rank) AS k FROM (SELECT q, c, rank, {q4(ATTR)} AS attr FROM {{top10}}) t) u WHERE k = 1""")
R.sql(
    "rrk3_hybrid_rerank",
    f"""SELECT q, c, hybrid FROM (SELECT q, c, hybrid, row_number() OVER (PARTITION BY q ORDER BY hybrid DESC, rank) AS k FROM (
 SELECT q, c, rank, {q4('0.9 * (0.5 * norm + 0.5 * attr) + 0.1 * greatest(0.0, 1 - abs(c_price - mean) / mean)')} AS hybrid FROM (
 SELECT q, c, rank, c_price, {ATTR} AS attr, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm, avg(c_price) OVER w AS mean
 FROM {{top10}} WINDOW w AS (PARTITION BY q)) t) u) v WHERE k = 1""",
)
R.sql(
    "rrk4_multi_aspect",
    f"""SELECT q, c, total FROM (SELECT q, c, total, row_number() OVER (PARTITION BY q ORDER BY total DESC, rank) AS k FROM (
 SELECT q, c, rank, {q4('0.40 * score + 0.15 * attr + 0.30 * near + 0.15 * exp(-days / 730.0E0)')} AS total FROM (SELECT q, c, rank, days, score, {ATTR} AS attr, 1 / (1 + abs(c_price - median(c_price) OVER (PARTITION BY q)) / median(c_price) OVER (PARTITION BY q)) AS near FROM {{top10}}) t) u) v WHERE k = 1""",
)
DIV = """SELECT q, c, place FROM (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN nth <= 2 THEN 0 ELSE 1 END, r) AS place FROM (
 SELECT q, c, r, row_number() OVER (PARTITION BY q, {key} ORDER BY r) AS nth FROM (SELECT q, c, {key}, row_number() OVER (PARTITION BY q ORDER BY score DESC, pool_rank) AS r FROM {{pool}}) t) u) v WHERE place <= 10"""
R.sql("div1_two_per_order", DIV.format(key="c_po"))
R.sql("div2_two_per_identity", DIV.format(key="c_model"))
R.sql(
    "res1_rescue",
    f"""SELECT q, c, rescue FROM (SELECT q, c, rescue, row_number() OVER (PARTITION BY q ORDER BY rescue DESC, r) AS k FROM (
 SELECT q, c, r, {q4('0.6 * CASE WHEN q_model = c_model THEN 1 ELSE 0 END + 0.4 * (1 - abs(ln(q_qty) - ln(c_qty)) / ln(10) / 1.2)')} AS rescue FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pool_rank) AS r FROM {{pool}}) t
 WHERE r > 10 AND abs(ln(q_qty) - ln(c_qty)) / ln(10) <= 1.2) u WHERE rescue >= 0.5) v WHERE k = 1""",
)
R.sql(
    "fai1_failure_taxonomy",
    f"""SELECT cause, count(*) AS n FROM (SELECT q, CASE WHEN max(CASE WHEN {HIT10} THEN 1 ELSE 0 END) = 1 THEN 'NONE' WHEN count(*) < 5 THEN 'FEW_CANDIDATES' WHEN min(days) > 730 THEN 'STALE' WHEN stddev_pop(c_lp) > 0.8 THEN 'DISPERSED'
 WHEN min(c_price) > q_price THEN 'ALL_ABOVE' WHEN max(c_price) < q_price THEN 'ALL_BELOW' ELSE 'BETWEEN' END AS cause FROM {{top10}} GROUP BY q, q_price) t GROUP BY cause""",
)
R.sql(
    "fai2_first_valid_groups",
    f"""SELECT grp, count(*) AS n FROM (SELECT q, CASE WHEN first IS NULL THEN 'C' WHEN first <= 10 THEN 'A' ELSE 'B' END AS grp FROM (SELECT q, min(CASE WHEN {HIT10} THEN r END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pool_rank) AS r FROM {{pool}}) t GROUP BY q) u) v GROUP BY grp""",
)
R.sql(
    "coh1_transitions",
    f"""SELECT CASE WHEN base = 1 AND alt = 1 THEN 'BOTH' WHEN base = 1 THEN 'HARMFUL' WHEN alt = 1 THEN 'HELPFUL' ELSE 'NEITHER' END AS cohort, count(*) AS n
 FROM (SELECT q, max(CASE WHEN rank = 1 AND {HIT10} THEN 1 ELSE 0 END) AS base, max(CASE WHEN near = 1 AND {HIT10} THEN 1 ELSE 0 END) AS alt FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY days, rank) AS near FROM {{top10}}) t GROUP BY q) u GROUP BY 1""",
)
R.sql(
    "led1_ledger",
    f"""SELECT q, {q4('base')} AS base_price, {q4('picked')} AS picked_price, {q4('abs(base - q_price) / q_price')} AS base_ape, {q4('abs(picked - q_price) / q_price')} AS picked_ape,
 CASE WHEN abs(base - q_price) > 0.1 * q_price AND abs(picked - q_price) <= 0.1 * q_price THEN 1 ELSE 0 END AS recovered, CASE WHEN abs(base - q_price) <= 0.1 * q_price AND abs(picked - q_price) > 0.1 * q_price THEN 1 ELSE 0 END AS damaged
 FROM (SELECT q, q_price, max(CASE WHEN rank = 1 THEN c_price END) AS base, max(CASE WHEN near = 1 THEN c_price END) AS picked FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY days, rank) AS near FROM {{top10}}) t GROUP BY q, q_price) u""",
)
R.sql("joi4_selected_price", f"""SELECT s.q, {q4('t.c_price')} AS price FROM (SELECT q, max(rank) AS rank FROM {{top10}} GROUP BY q) s JOIN {{top10}} t ON s.q = t.q AND s.rank = t.rank""")
R.sql("joi9_pool_pairs", f"""SELECT a.q, count(*) AS pairs, {q4('avg(abs(a.c_price - b.c_price) / a.c_price)')} AS mean_distance FROM {{top10}} a JOIN {{top10}} b ON a.q = b.q AND a.rank < b.rank GROUP BY a.q""")

QUERIES, ORACLES = R.queries, R.oracles
