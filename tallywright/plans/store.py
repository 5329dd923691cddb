"""The operational store: filters, joins, paging, counters, sets and sinks over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.plans.base import Registry, read

R = Registry()


def s4(x: str) -> str:
    """Half-up to four places."""
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


R.sql("fil1_campaign_search", "SELECT s_suppkey, s_name FROM {supplier} WHERE s_nationkey = 5 AND (lower(s_name) LIKE '%supplier%' OR s_acctbal < 0)")
R.sql("fil2_role_or_missing", "SELECT conv_id, turn FROM {conversations} WHERE role IN ('user', 'volunteer') OR role IS NULL")
R.sql("fil3_status_before", "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00'")
R.sql("fil4_two_sided", "SELECT event_id, ts FROM {events} WHERE (event_type = 'click' AND user_id % 2 = 0) OR (event_type = 'view' AND user_id % 2 = 1)")
R.sql("fil5_array_contains", "SELECT p_partkey FROM {part} WHERE array_contains(split(p_name, ' '), 'ring')", "SELECT p_partkey FROM {part} WHERE list_contains(string_split(p_name, ' '), 'ring')")
R.sql("fil6_projection", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer}")
R.sql("fil7_substring_any", "SELECT c_custkey FROM {customer} WHERE lower(c_name) LIKE '%99%' OR lower(c_mktsegment) LIKE '%auto%'")
R.sql("fil8_compact_projection", f"SELECT c_custkey, {s4('least(100.0, greatest(0.0, c_acctbal / 100))')} AS score, concat('segment ', lower(c_mktsegment)) AS reason FROM {{customer}}")
R.sql(
    "fil10_issue_list",
    "SELECT c_custkey, CASE WHEN issues = '' THEN 'NONE' ELSE issues END AS issues FROM (SELECT c_custkey, concat_ws(';', CASE WHEN c_acctbal < 0 THEN 'NEGATIVE' END, CASE WHEN c_nationkey > 20 THEN 'FAR' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SEGMENT' END) AS issues FROM {customer}) t",
)
R.sql("joi1_lookup_inner", "SELECT l_orderkey, l_linenumber, l_suppkey, s_name FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey")
R.sql("joi2_left_hhi", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {s4('hhi')} AS hhi FROM {{lineitem}} l LEFT JOIN (SELECT k, sum(s * s) AS hhi FROM (SELECT l_orderkey AS k, sum(l_quantity) / sum(sum(l_quantity)) OVER (PARTITION BY l_orderkey) AS s FROM {{lineitem}} GROUP BY l_orderkey, l_partkey) t GROUP BY k) h ON l.l_orderkey = h.k")
R.sql("joi3_unique_keys", "SELECT count(*) AS duplicated FROM (SELECT o_orderkey FROM {orders} GROUP BY o_orderkey HAVING count(*) > 1) t")
R.sql(
    "joi5_populate",
    "SELECT s_suppkey, n_name, r_name FROM {supplier} LEFT JOIN {nation} ON s_nationkey = n_nationkey LEFT JOIN {region} ON n_regionkey = r_regionkey",
)
HAV = "6371.0 * 2 * atan2(sqrt(a), sqrt(1 - a))"
GEO = """SELECT x.n_nationkey AS a_key, y.n_nationkey AS b_key, power(sin(radians(y.lat - x.lat) / 2), 2) + cos(radians(x.lat)) * cos(radians(y.lat)) * power(sin(radians(y.lng - x.lng) / 2), 2) AS a
 FROM (SELECT n_nationkey, n_nationkey * 2.5 AS lat, n_nationkey * 3.0 AS lng FROM {nation}) x JOIN (SELECT n_nationkey, n_nationkey * 2.5 AS lat, n_nationkey * 3.0 AS lng FROM {nation}) y ON abs(x.n_nationkey - y.n_nationkey) <= 4"""
R.sql("mth1_haversine", f"SELECT a_key, b_key, {s4(HAV)} AS km FROM ({GEO}) t")
R.sql("joi10_proximity_band", f"SELECT a_key, b_key FROM (SELECT a_key, b_key, {HAV} AS km FROM ({GEO}) t) u WHERE km <= 900")
R.sql("mth2_proximity", f"SELECT a_key, b_key, {s4('exp(-km / 15)')} AS p15, {s4('exp(-km / 35)')} AS p35, {s4('least(99.0, greatest(65.0, 100 / (1 + km / 15)))')} AS shown FROM (SELECT a_key, b_key, {HAV} AS km FROM ({GEO}) t) u")
R.sql("joi11_gazetteer", "SELECT page_id, n_nationkey FROM (SELECT page_id, n_nationkey, row_number() OVER (PARTITION BY page_id ORDER BY length(n_name) DESC, n_nationkey) AS k FROM {pages} JOIN {nation} ON url LIKE concat('%/', substr(lower(n_name), 8), '%')) t WHERE k = 1")
R.sql("joi12_semi", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 49)")
R.sql("joi14_enrichment", "SELECT o_orderkey, coalesce(c_name, 'unknown') AS name FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")


# Fixed value: price lines of one task, whose groups and sorts it holds in memory.
LINES_OF_A_TASK = 500_000


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """po, code, qty of the catalog; the lines of an order lie in one task.

    Orders are dealt by number, not by bytes: a few bytes of a line become many once it
    is sorted and grouped, so that a task holds as many lines whatever the size of the tables.
    """
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    tasks = max(1, -(-line.count() // LINES_OF_A_TASK))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("po"), F.col("p_brand").alias("code"), F.col("l_quantity").alias("qty"))
    return rows.repartition(tasks, "po").join(orders.select(F.col("o_orderkey").alias("po")).repartition(tasks, "po"), "po")


@R.query("agg2_order_quantity", "SELECT po, code, sum(qty) AS qty FROM catalog GROUP BY po, code", "catalog")
def agg2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity of every order and commodity."""
    return order_lines(spark, sf_dir).groupBy("po", "code").agg(F.sum("qty").alias("qty"))


@R.query("agg3_hhi", f"SELECT po, {s4('sum(s * s)')} AS hhi FROM (SELECT po, sum(qty) / greatest(sum(sum(qty)) OVER (PARTITION BY po), 0.0001) AS s FROM catalog GROUP BY po, code) t GROUP BY po", "catalog")
def agg3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of an order's quantity over its commodities: the squares of their sums over the square of the whole, so that no window is needed."""
    own = order_lines(spark, sf_dir).groupBy("po", "code").agg(F.sum("qty").alias("own"))
    sums = own.groupBy("po").agg(F.sum(F.col("own") * F.col("own")).alias("squares"), F.greatest(F.sum("own"), F.lit(0.0001)).alias("whole"))
    return sums.select("po", F.expr(s4("squares / (whole * whole)")).alias("hhi"))


R.sql("agg4_primary_line", "SELECT row_key, CASE WHEN qty >= max(qty) OVER (PARTITION BY po) - 0.0001 THEN 1 ELSE 0 END AS is_primary, sum(qty) OVER (PARTITION BY po) AS total FROM {catalog}")
R.sql("agg5_commodity_sets", "SELECT po, array_join(array_sort(collect_set(code)), ',') AS codes FROM {catalog} GROUP BY po", "SELECT po, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM {catalog} GROUP BY po")
R.sql("agg21_impact_score", f"SELECT user_id, {s4('sum(value) * 10')} AS impact FROM {{events}} WHERE event_type = 'purchase' GROUP BY user_id")
R.sql("agg22_task_buckets", "SELECT user_id, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS pending, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS ongoing, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS completed FROM {events} GROUP BY user_id")
R.sql("agg23_active_counts", "SELECT c_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS active, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS completed FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
R.sql("agg24_value_share", f"SELECT uom, {s4('count(*) * 1.0E0 / sum(count(*)) OVER ()')} AS share FROM {{catalog}} GROUP BY uom")
R.sql("snk3_latest_upsert", "SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM {events}) t WHERE k = 1 AND event_type <> 'error'")
R.sql("srt1_two_descending", "SELECT c_nationkey, c_custkey, k FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 100) DESC, c_name DESC) AS k FROM {customer}) t")
R.sql("srt3_top_k", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM {customer}) t WHERE k <= 10")
R.sql("srt6_paging", "SELECT event_id FROM {events} ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 20")
R.sql("srt7_newest", "SELECT o_orderkey FROM {orders} ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 6")
R.sql("srt9_first_queries", "SELECT q FROM (SELECT DISTINCT row_key AS q FROM {catalog}) t ORDER BY q LIMIT 50")
R.sql("set1_skill_intersection", "SELECT a.p_partkey, array_join(array_sort(array_intersect(split(a.p_name, ' '), array('small', 'ring', 'blue'))), ',') AS both FROM {part} a",
      "SELECT a.p_partkey, array_to_string(list_sort(list_intersect(string_split(a.p_name, ' '), ['small', 'ring', 'blue'])), ',') AS both FROM {part} a")
R.sql("set3_distinct_texts", "SELECT p_name AS text FROM {part} UNION SELECT p_type AS text FROM {part}")
R.sql("set4_subset", "SELECT p_partkey, size(array_except(split(p_name, ' '), array('small', 'large', 'ring', 'bolt'))) = 0 AS within FROM {part}",
      "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['small', 'large', 'ring', 'bolt'], x))) = 0 AS within FROM {part}")
R.sql("set5_first_by_source", "SELECT code, vendor, row_key FROM (SELECT code, vendor, row_key, row_number() OVER (PARTITION BY code, vendor ORDER BY d, row_key) AS k FROM {catalog}) t WHERE k = 1")
R.sql("set6_reason_merge", "SELECT c_custkey, CASE WHEN length(trim(reason)) > 10 THEN reason ELSE 'no reason given' END AS reason FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN concat('balance ', c_mktsegment) ELSE '' END AS reason FROM {customer}) t")
R.sql(
    "stm5_tumbling_counts",
    "SELECT date_trunc('HOUR', ts) AS hour, event_type, count(*) AS n FROM {events} GROUP BY 1, 2",
)

QUERIES, ORACLES = R.queries, R.oracles
