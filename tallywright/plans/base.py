"""The synthetic tables read as the engine's concepts, for Spark and for the SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators.temporal import latest_prior, reachable
from tallywright.sources.shared import materialized, shared

#: First day of the evaluation period; earlier rows are history.
EVAL_FROM = "2001-01-01"
CALIBRATE_FROM = "2000-01-01"
#: Columns by which the pairs of a query lie in one task as ``pool`` returns them: a window or group by these needs no shuffle.
TOGETHER = ["q_code", "q_uom", "q_block", "q"]
COLUMNS = ["row_key", "po", "vendor", "d", "price", "lp", "qty", "code", "family", "uom", "model", "text"]

CATALOG = """catalog AS (
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_key, l_orderkey AS po, l_suppkey AS vendor,
  CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS price, ln(l_extendedprice / l_quantity) AS lp, l_quantity AS qty, p_brand AS code, p_type AS family,
  CASE p_size % 4 WHEN 0 THEN 'EA' WHEN 1 THEN 'BOX' WHEN 2 THEN 'CASE' ELSE 'PK' END AS uom, p_name AS model, concat_ws(' ', p_name, p_type, 'size', p_size) AS text
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""

POOL = """pool AS (
 SELECT *, floor(raw * 10000 + 0.500001) / 10000 AS score FROM (
 SELECT q.row_key AS q, q.po AS q_po, q.price AS q_price, q.qty AS q_qty, q.code AS q_code, q.uom AS q_uom, q.model AS q_model, q.text AS q_text, q.d AS q_d, q.family AS q_family,
  c.row_key AS c, c.po AS c_po, c.vendor AS c_vendor, c.price AS c_price, c.lp AS c_lp, c.qty AS c_qty, c.code AS c_code, c.uom AS c_uom, c.model AS c_model, c.text AS c_text, c.d AS c_d,
  row_number() OVER (PARTITION BY q.row_key ORDER BY c.d DESC, c.row_key DESC) AS pool_rank, date_diff('day', c.d, q.d) AS days,
  0.5 * CAST(q.model = c.model AS INT) + 0.3 * exp(-date_diff('day', c.d, q.d) / 365.0) + 0.2 * least(q.qty, c.qty) / greatest(q.qty, c.qty) AS raw
 FROM catalog q JOIN catalog c ON q.code = c.code AND q.uom = c.uom AND c.d < q.d WHERE q.d >= DATE '2001-01-01'
 QUALIFY pool_rank <= 30))"""

TOP10 = """top10 AS (
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pool_rank) AS rank FROM pool) WHERE rank <= 10)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price lines: line items with their order and part; part and orders decide by size whether they are broadcast."""
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    uom = F.when(F.col("p_size") % 4 == 0, "EA").when(F.col("p_size") % 4 == 1, "BOX").when(F.col("p_size") % 4 == 2, "CASE").otherwise("PK")
    return (
        line.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("row_key"),
            F.col("l_orderkey").alias("po"),
            F.col("l_suppkey").alias("vendor"),
            F.to_date("l_shipdate").alias("d"),
            price.alias("price"),
            F.log(price).alias("lp"),
            F.col("l_quantity").alias("qty"),
            F.col("p_brand").alias("code"),
            F.col("p_type").alias("family"),
            uom.alias("uom"),
            F.col("p_name").alias("model"),
            F.concat_ws(" ", "p_name", "p_type", F.lit("size"), "p_size").alias("text"),
        )
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 30 candidates of each row of the evaluation period: the latest prior rows of its commodity and unit.

    The rows that can be in a pair are written once in an application for the same
    input files. Pairs of a query lie together by ``TOGETHER``.
    """
    keys = ["code", "uom"]
    rows = shared(spark, "reachable", [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "part")], lambda: reachable(catalog(spark, sf_dir), keys, 30, EVAL_FROM))
    pairs = latest_prior(rows, F.col("d") >= F.lit(EVAL_FROM).cast("date"), keys, 30, COLUMNS)
    days = F.datediff("q_d", "c_d")
    raw = 0.5 * (F.col("q_model") == F.col("c_model")).cast("int") + 0.3 * F.exp(-days / 365.0) + 0.2 * F.least("q_qty", "c_qty") / F.greatest("q_qty", "c_qty")
    return pairs.select(
        F.col("q_row_key").alias("q"), "q_po", "q_price", "q_qty", "q_code", "q_uom", "q_model", "q_text", "q_d", "q_family",
        F.col("c_row_key").alias("c"), "c_po", "c_vendor", "c_price", "c_lp", "c_qty", "c_code", "c_uom", "c_model", "c_text", "c_d",
        "pool_rank", "q_block", days.alias("days"), (F.floor(raw * 10000 + 0.500001) / 10000).alias("score"),
    )


def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of each query by score; ties go to the newer."""
    from pyspark.sql import Window

    best = Window.partitionBy(*TOGETHER).orderBy(F.desc("score"), "pool_rank")
    return pool(spark, sf_dir).withColumn("rank", F.row_number().over(best)).where("rank <= 10")


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"catalog": catalog, "pool": pool, "top10": top10}
CTES = {"catalog": CATALOG, "pool": POOL, "top10": TOP10}
NEEDS = {"catalog": ["catalog"], "pool": ["catalog", "pool"], "top10": ["catalog", "pool", "top10"]}


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL over the named concepts."""
    needed = list(dict.fromkeys(n for name in names for n in NEEDS[name]))
    return f"WITH {', '.join(CTES[n].replace(' AS (', ' AS MATERIALIZED (', 1) for n in needed)} SELECT * FROM ({sql})" if needed else sql


def together(body: str) -> str:
    """A statement over one pool whose windows and groups by query name the columns by which a query's pairs lie together.

    The outermost list of columns stays as it is; those within it hand the columns on.
    """
    import re

    first = re.match(r"\s*SELECT q,", body)
    start = first.end() if first else 0
    inner = re.sub(r"\bSELECT q,", f"SELECT {', '.join(TOGETHER)},", body[start:])
    return body[:start] + re.sub(r"\b(PARTITION|GROUP) BY q\b", rf"\1 BY {', '.join(TOGETHER)}", inner)


class Registry:
    """Queries of a module and their oracles."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, body: str, duck: str | None = None) -> None:
        """A query in SQL over concepts and tables named in braces. ``duck``: its form for DuckDB where the dialects differ."""
        import re

        named = list(dict.fromkeys(re.findall(r"\{(\w+)\}", body)))

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = {n: VIEWS[n](spark, sf_dir) if n in VIEWS else read(spark, sf_dir, n) for n in named}
            for n in named:  # a concept that is read twice is computed once
                if n in VIEWS and body.count(f"{{{n}}}") > 1:
                    frames[n] = materialized(frames[n], n)
            pools = [n for n in named if n in ("pool", "top10")]
            return spark.sql(together(body) if pools and len(named) == 1 and body.count(f"{{{pools[0]}}}") == 1 else body, **frames)

        self.queries[name] = run
        self.oracles[name] = oracle(re.sub(r"\{(\w+)\}", r"\1", duck or body), *[n for n in named if n in VIEWS])

    def query(self, name: str, duck: str | None = None, *concepts: str):
        """Decorator for a query in the DataFrame API with its DuckDB oracle."""

        def keep(function):
            self.queries[name] = function
            if duck is not None:
                self.oracles[name] = oracle(duck, *concepts)
            return function

        return keep
