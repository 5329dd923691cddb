"""As-of joins, decayed and shrunk price statistics, and the retrieval channels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.functions.text import jaccard, token_set
from tallywright.operators.diversity import candidates, mmr, with_picked
from tallywright.operators.robust import huber_fits
from tallywright.operators.temporal import decayed_stats, latest_prior, ranked_history
from tallywright.plans.base import CALIBRATE_FROM, COLUMNS, EVAL_FROM, TOGETHER, Registry, catalog, pool, read
from tallywright.sources.shared import materialized

R = Registry()


def asked():
    """Rows of the evaluation period, which are the queries."""
    return F.col("d") >= F.lit(EVAL_FROM).cast("date")


def q4(x):
    """Half-up to four places."""
    return F.floor(x * 10000 + 0.500001) / 10000


def s4(x: str) -> str:
    """The same in SQL."""
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


R.sql("src3_temporal_masks", "SELECT CASE WHEN d < DATE '2000-01-01' THEN 'train' WHEN d < DATE '2001-01-01' THEN 'calibrate' ELSE 'evaluate' END AS part, count(*) AS n FROM {catalog} GROUP BY 1")


@R.query(
    "src1_catalog_row_ids",
    "SELECT row_key, row_number() OVER (ORDER BY d, po, row_key) AS row_id FROM catalog",
    "catalog",
)
def src1_catalog_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions by (date, order, key): rows are numbered within a day, days get offsets."""
    rows = catalog(spark, sf_dir).select("row_key", "d", "po")
    earlier = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("d").count().select("d", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    numbered = rows.withColumn("at", F.row_number().over(Window.partitionBy("d").orderBy("po", "row_key")))
    return numbered.join(offsets, "d").select("row_key", (F.col("offset") + F.col("at")).alias("row_id"))


@R.query(
    "joi6_prior_counts",
    "SELECT row_key, n FROM (SELECT row_key, d, rank() OVER (PARTITION BY code, model ORDER BY d) - 1 AS n FROM catalog) WHERE d >= DATE '2001-01-01'",
    "catalog",
)
def joi6_prior_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the same key strictly before each query."""
    return ranked_history(catalog(spark, sf_dir), ["code", "model"]).where(asked()).select("row_key", F.col("prior").alias("n"))


TOP = """SELECT q.row_key AS q, c.row_key AS c, row_number() OVER (PARTITION BY q.row_key ORDER BY c.d DESC, c.row_key DESC) AS pool_rank
 FROM catalog q JOIN catalog c ON {on} AND c.d < q.d WHERE q.d >= DATE '2001-01-01' QUALIFY pool_rank <= {n}"""


def _top(name: str, keys: list[str], n: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = latest_prior(catalog(spark, sf_dir), asked(), keys, n, COLUMNS, since=EVAL_FROM)
        return pairs.select(F.col("q_row_key").alias("q"), F.col("c_row_key").alias("c"), "pool_rank")

    R.query(name, TOP.format(on=" AND ".join(f"q.{k} = c.{k}" for k in keys), n=n), "catalog")(run)


_top("joi7_latest_prior", ["model", "uom"], 10)

DAILY = """SELECT d, {w} AS w, {m} AS mean FROM (SELECT q.d, sum(power(2, -date_diff('day', c.d, q.d) / 365.0) * c.n) AS sw, sum(power(2, -date_diff('day', c.d, q.d) / 365.0) * c.x) AS sx
 FROM (SELECT DISTINCT d FROM catalog WHERE d >= DATE '2001-01-01') q JOIN (SELECT d, count(*) AS n, sum(lp) AS x FROM catalog GROUP BY d) c ON c.d < q.d GROUP BY q.d)"""


@R.query("agg8_global_decayed_prior", DAILY.format(w=s4("sw"), m=s4("sx / sw")), "catalog")
def agg8_global_decayed_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed weight and mean of all rows before each day; one row a day is all that meets in a window."""
    stats = decayed_stats(catalog(spark, sf_dir).withColumn("every", F.lit(1)), asked(), ["every"], 365.0)
    return stats.select("d", q4(F.col("w")).alias("w"), q4(F.col("mean")).alias("mean"))


DECAY = """SELECT code, model, d, n AS n_prior, {w} AS w, {m} AS mean, CASE WHEN n = 1 THEN 0.25 ELSE greatest({v}, 0.01) END AS variance FROM (
 SELECT code, model, d, sum(n) AS n, sum(w * n) AS sw, sum(w * x) AS sx, sum(w * xx) AS sxx FROM (
 SELECT q.code, q.model, q.d, c.n, c.x, c.xx, power(2, -date_diff('day', c.d, q.d) / 365.0) AS w FROM (SELECT DISTINCT code, model, d FROM catalog WHERE d >= DATE '2001-01-01') q
 JOIN (SELECT code, model, d, count(*) AS n, sum(lp) AS x, sum(lp * lp) AS xx FROM catalog GROUP BY ALL) c ON q.code = c.code AND q.model = c.model AND c.d < q.d) GROUP BY ALL)"""


@R.query("agg6_decayed_stats", DECAY.format(w=s4("sw"), m=s4("sx / sw"), v=s4("sxx / sw - (sx / sw) * (sx / sw)")), "catalog")
def agg6_decayed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially decayed statistics of log price before each query day and identity."""
    stats = decayed_stats(catalog(spark, sf_dir), asked(), ["code", "model"], 365.0)
    variance = F.when(F.col("n_prior") == 1, F.lit(0.25)).otherwise(F.greatest(q4(F.col("variance")), F.lit(0.01)))
    return stats.select("code", "model", "d", "n_prior", q4(F.col("w")).alias("w"), q4(F.col("mean")).alias("mean"), variance.alias("variance"))


R.sql("agg7_adaptive_half_life", f"""SELECT q, {s4('CASE WHEN n <= 2 THEN 365.0 WHEN sd <= 0.0001 THEN 730.0 ELSE greatest(30.0, least(730.0, 365.0 * 0.6 / (sd + 0.1))) END')} AS half_life FROM (SELECT q, count(*) AS n, stddev_pop(c_lp) AS sd FROM {{pool}} GROUP BY q) t""")
R.sql("sim2_weighted_price", f"""SELECT q, {s4('min(c_price)')} AS price FROM (SELECT q, c_price, sum(w) OVER (PARTITION BY q ORDER BY c_price, pool_rank ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY q) AS total FROM (SELECT q, c_price, pool_rank, floor(score * exp(-days / 730.0E0) * 1000000 + 0.5) AS w FROM {{pool}}) t) u WHERE run * 2 >= total GROUP BY q""")
R.sql(
    "fil12_compatibility",
    """SELECT q, c FROM (SELECT *, sum(keep) OVER (PARTITION BY q) AS kept, count(*) OVER (PARTITION BY q) AS n FROM (
 SELECT q, c, CASE WHEN abs(q_qty - c_qty) / greatest(q_qty, 0.0001) > 0.35 AND q_model <> c_model THEN 0 ELSE 1 END AS keep FROM {pool}) t) u WHERE n <= 10 OR kept < 5 OR keep = 1""",
)
R.sql(
    "fil13_state_pruning",
    f"""SELECT q, c FROM (SELECT q, c, keep, pool_rank, sum(keep) OVER (PARTITION BY q) AS kept, least(5, count(*) OVER (PARTITION BY q)) AS need FROM (
 SELECT q, c, pool_rank, CASE WHEN {s4('abs(c_lp - avg(c_lp) OVER (PARTITION BY q))')} > {s4('stddev_pop(c_lp) OVER (PARTITION BY q)')} AND score < 0.35 THEN 0 ELSE 1 END AS keep FROM {{pool}}) t) u WHERE keep = 1 OR kept < need""",
)


VECTOR = """SELECT a.vec_id AS q, b.vec_id AS c, floor(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 10000 + 0.500001) / 10000 AS sim
 FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id"""


#: Vectors of a label that are compared with others as one block, those multiplied at once, rows of the channel, and its least similarity.
VECTOR_BLOCK, VECTOR_STEP, VECTOR_TOP, LEAST_VECTOR = 4096, 512, 10, 0.10


def _best_of_blocks(key, left, right):
    """The ten best pairs of each vector of one block with the earlier vectors of another, by matrix products."""
    found = [pd.DataFrame({"q": [], "c": [], "sim": []})]
    if len(left) and len(right):
        others, norms, b = right["vec_id"].to_numpy(), right["norm"].to_numpy(), np.stack(right["v"]).astype(float)
        for first in range(0, len(left), VECTOR_STEP):
            some = left.iloc[first : first + VECTOR_STEP]
            ids, a = some["vec_id"].to_numpy(), np.stack(some["v"]).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                sims = np.floor((a @ b.T) / np.outer(some["norm"].to_numpy(), norms) * 10000 + 0.500001) / 10000
            # a row below 0.10 has only others below it, so the cut to ten is the same without them
            at, met = np.nonzero((others[None, :] < ids[:, None]) & (sims >= LEAST_VECTOR))
            pairs = pd.DataFrame({"q": ids[at], "c": others[met], "sim": sims[at, met]})
            found.append(pairs.sort_values(["q", "sim", "c"], ascending=[True, False, False]).groupby("q").head(VECTOR_TOP))
    return pd.concat(found[1:] or found)


def in_blocks(vectors: DataFrame, compare: Callable) -> DataFrame:
    """(q, c, sim): what ``compare`` finds in each pair of blocks of a label. vectors: vec_id, label, v and norm; a pair of blocks is one task's group."""
    sizes = vectors.groupBy("label").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("blocks"))
    dealt = materialized(vectors.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")), "vectors")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("vec_id", "label", "v", "norm", F.col("block").alias("i"), every.alias("j"))
    right = dealt.select("vec_id", "label", "v", "norm", F.col("block").alias("j"), every.alias("i"))
    by = ["label", "i", "j"]
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(compare, f"q {kind}, c {kind}, sim double")


def nearest_of_blocks(key, left, right):
    """The most similar vector of one block for each of another, by matrix products: cosines to four places, 0 for vectors without length; ties go to the smallest id, missing vectors come last."""
    found = [pd.DataFrame({"q": [], "c": [], "sim": []})]
    if len(left) and len(right):
        right = right.sort_values("vec_id")
        wide = max((len(v) for v in [*left["v"], *right["v"]] if v is not None), default=0)

        def matrix(rows):
            return np.stack([np.zeros(wide) if v is None else np.asarray(v, dtype=float) for v in rows["v"]]), np.nan_to_num(rows["norm"].to_numpy(dtype=float)), rows["v"].isna().to_numpy()

        others, (b, norms, gone) = right["vec_id"].to_numpy(), matrix(right)
        for first in range(0, len(left), VECTOR_STEP):
            some = left.iloc[first : first + VECTOR_STEP]
            ids, (a, own, missing) = some["vec_id"].to_numpy(), matrix(some)
            size = np.outer(own, norms)
            sims = np.floor(np.where(size == 0, 0.0, (a @ b.T) / np.where(size == 0, 1.0, size)) * 10000 + 0.500001)
            sims[missing[:, None] | gone[None, :]] = -1e9
            sims[ids[:, None] == others[None, :]] = -np.inf
            at = sims.argmax(axis=1)
            best = sims[np.arange(len(ids)), at]
            found.append(pd.DataFrame({"q": ids, "c": others[at], "sim": best})[best > -np.inf])
    return pd.concat(found[1:] or found)


@R.query("chg_embedding_channel", f"SELECT q, c, sim FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, c DESC) AS k FROM ({VECTOR})) WHERE k <= 10 AND sim >= 0.10")
def chg_embedding_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar earlier vectors of the same label; then those below 0.10 go.

    Every pair of a label is compared, in blocks of vectors: a pair of blocks is one
    task's matrix product, of which the ten best of each vector go on.
    """
    unit = F.expr("sqrt(aggregate(embedding, 0D, (s, x) -> s + cast(x as double) * x))")
    vectors = read(spark, sf_dir, "embeddings").where("label is not null and vec_id is not null and embedding is not null")
    vectors = vectors.select("vec_id", "label", F.col("embedding").alias("v"), unit.alias("norm"))
    pairs = in_blocks(vectors, _best_of_blocks)
    best = Window.partitionBy("q").orderBy(F.desc("sim"), F.desc("c"))
    return pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= VECTOR_TOP).drop("k")


def mmr_input(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """Candidates of every query as ``mmr`` reads them, lying together by ``TOGETHER``; more: further columns."""
    order = Window.partitionBy(*TOGETHER).orderBy(F.desc("score"), "pool_rank")
    return pool(spark, sf_dir).select(
        *TOGETHER, "c", F.row_number().over(order).alias("r"), "score", F.col("c_model").alias("identity"), F.col("c_po").alias("po"), token_set(F.col("c_text")).alias("tokens"), *more
    )


@R.query("div3_mmr")
def div3_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten diverse candidates of each query by maximal marginal relevance."""
    return mmr(mmr_input(spark, sf_dir), by=tuple(TOGETHER))


def pair_similarity(first: int = 10) -> Column:
    """The largest similarity of two of the first rows of a group: half for one identity, 0.3 for one order, 0.2 for the Jaccard of their words; null below two rows."""

    def alike(a: Column, b: Column) -> Column:
        return 0.5 * (a["identity"] == b["identity"]).cast("int") + 0.3 * (a["po"] == b["po"]).cast("int") + 0.2 * jaccard(a["tokens"], b["tokens"])

    rows = F.array_sort(F.collect_list(F.when(F.col("r") <= first, F.struct("r", "identity", "po", "tokens"))))
    return F.array_max(F.flatten(F.transform(rows, lambda a: F.transform(F.filter(rows, lambda b: b["r"] > a["r"]), lambda b: alike(a, b)))))


@R.query("div4_selective_mmr")
def div4_selective_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MMR where the pool has more than ten candidates of which no two of the first ten are alike beyond 0.98; else the first ten."""
    one = mmr_input(spark, sf_dir).groupBy(*TOGETHER).agg(pair_similarity().alias("sim"), candidates().alias("rows"))
    first = F.transform(F.array_sort(F.transform(F.filter("rows", lambda x: x["r"] <= 10), lambda x: F.struct(x["r"].alias("r"), x["c"].alias("c")))), lambda x: F.struct(x["c"].alias("c"), x["r"].alias("place")))
    diverse = F.coalesce((F.size("rows") > 10) & (F.col("sim") <= 0.98), F.lit(False))
    both = with_picked(one.select("q", diverse.alias("diverse"), first.alias("first"), "rows"))
    return both.select("q", F.inline(F.when(F.col("diverse"), F.col("rows")).otherwise(F.col("first"))))


@R.query("ml6_group_folds", "SELECT 5 AS folds, count(DISTINCT family) AS families FROM catalog", "catalog")
def ml6_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds by family: every family lies in one fold."""
    folds = catalog(spark, sf_dir).select("family", F.pmod(F.xxhash64("family"), F.lit(5)).alias("fold")).distinct()
    return folds.agg(F.lit(5).alias("folds"), F.count("*").alias("families"))


# Bounds of the slopes, least rows of a family, and the slope where nothing can be fitted.
FAMILY_SLOPES, GLOBAL_SLOPES, FAMILY_ROWS, GLOBAL_ROWS, NO_SLOPE = (-0.40, 0.05), (-0.35, 0.02), 30, 101, -0.05


def price_slopes(rows: DataFrame, rounds: int = 12) -> DataFrame:
    """family, n, beta: the Huber slope of log price on log quantity, within bounds; that of all rows for families of fewer than 30.

    rows: family, qty, price. Quantities and prices below a thousandth count as one.
    """
    points = rows.select("family", F.log(F.greatest("qty", F.lit(1e-3))).alias("x"), F.log(F.greatest("price", F.lit(1e-3))).alias("y")).where("family is not null")
    both = points.withColumn("group", F.explode(F.array(F.concat(F.lit("f"), "family"), F.lit("all"))))
    fits = materialized(huber_fits(both, "group", rounds=rounds), "slopes")

    def within(bounds: tuple[float, float]) -> Column:
        return F.greatest(F.lit(bounds[0]), F.least(F.lit(bounds[1]), F.col("slope")))

    whole = fits.where("group = 'all'").select(F.when(F.col("n") >= GLOBAL_ROWS, within(GLOBAL_SLOPES)).otherwise(NO_SLOPE).alias("all_slope"))  # one row
    own = fits.where("group <> 'all'").select(F.substring("group", 2, 1 << 20).alias("family"), "n", within(FAMILY_SLOPES).alias("own"))
    return own.crossJoin(F.broadcast(whole)).select("family", "n", F.when(F.col("n") >= FAMILY_ROWS, F.col("own")).otherwise(F.col("all_slope")).alias("beta"))


@R.query("agg11_huber")
def agg11_huber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of every family from the rows before the calibration period."""
    rows = catalog(spark, sf_dir).where(F.col("d") < F.lit(CALIBRATE_FROM).cast("date"))
    return price_slopes(rows).select("family", "n", q4(F.col("beta")).alias("beta"))


QUERIES, ORACLES = R.queries, R.oracles
