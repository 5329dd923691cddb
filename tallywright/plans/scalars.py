"""Text, date, math, array and JSON functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import text as T
from tallywright.plans.base import Registry, read

R = Registry()


def s4(x: str) -> str:
    """Half-up to four places; the margin keeps exact halves together in every engine."""
    return f"floor(({x}) * 10000 + 0.500001) / 10000"


def _docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return read(spark, sf_dir, name)


@R.query("str1_list_normalise", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name, ' '), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS skills FROM part")
def str1(spark, sf_dir):
    """Trimmed, lower-cased, without blanks."""
    return _docs(spark, sf_dir, "part").select("p_partkey", F.array_join(T.normalised(F.split("p_name", " ")), "|").alias("skills"))




@R.query("str4_token_sets", "SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(replace(text, 'ß', 'ss')), '[A-Z0-9]+'))), ' ') AS tokens FROM benchmark")
def str4(spark, sf_dir):
    """Distinct upper-case alphanumeric tokens."""
    return _docs(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.token_set(F.col("text"))), " ").alias("tokens"))


@R.query("str6_char_trigrams", "SELECT p_partkey, array_to_string(list_sort(list_distinct(CASE WHEN length(p_name) <= 3 THEN [p_name] ELSE list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i, 3)) END)), '|') AS grams FROM part")
def str6(spark, sf_dir):
    """Distinct runs of three characters."""
    return _docs(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.char_grams(F.col("p_name"), 3)), "|").alias("grams"))


@R.query("str7_word_sets", r"SELECT item_id, len(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS words, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: length(w) >= 3))) AS context FROM benchmark")
def str7(spark, sf_dir):
    """Unicode words, and those of three characters or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    return _docs(spark, sf_dir, "benchmark").select("item_id", F.size(words).alias("words"), F.size(F.filter(words, lambda w: F.length(w) >= 3)).alias("context"))


@R.query("str8_phrase_containment", "SELECT doc_id, contains(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' of the ') AS has FROM documents")
def str8(spark, sf_dir):
    """A phrase between word boundaries."""
    return _docs(spark, sf_dir).select("doc_id", T.contains_phrase(F.col("text"), "of the").alias("has"))


@R.query("str10_currency_stripping", "SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '(?:[$€£]|USD|INR)\\s*[0-9]+', ' ', 'g'), '[ \\t\\n]+', ' ', 'g'))) AS n FROM documents")
def str10(spark, sf_dir):
    """Prices removed, white space collapsed."""
    clean = F.regexp_replace(F.regexp_replace("text", r"(?:[$€£]|USD|INR)\s*[0-9]+", " "), r"[ \t\n]+", " ")
    return _docs(spark, sf_dir).select("doc_id", F.length(F.trim(clean)).alias("n"))


R.sql("str19_product_key", "SELECT row_key, concat(code, '|', upper(replace(model, ' ', '_')), '|', uom) AS product_key, CASE WHEN length(model) > 8 THEN 'HIGH' ELSE 'LOW' END AS confidence FROM {catalog}")
R.sql("str21_stratified_identity", "SELECT row_key, CASE WHEN family = 'STANDARD' THEN concat(code, '|GENERIC|', replace(upper(model), ' ', '_'), '|', uom) ELSE concat(code, '|', model, '|', uom) END AS strat_key FROM {catalog}")


@R.query("str22_unicode_cleanup", "SELECT doc_id, length(replace(replace(replace(text, chr(160), ' '), '–', '-'), '’', '''')) AS n, contains(replace(text, '–', '-'), '–') AS left_over FROM documents")
def str22(spark, sf_dir):
    """No-break spaces, dashes and quotes to ASCII."""
    clean = F.translate("text", " –’", " -'")
    return _docs(spark, sf_dir).select("doc_id", F.length(clean).alias("n"), F.contains(clean, F.lit("–")).alias("left_over"))


R.sql("str23_profile_text", "SELECT c_custkey, concat(c_name, ' of ', lower(c_mktsegment), ' in nation ', cast(c_nationkey AS varchar(10))) AS profile FROM {customer}")
R.sql("str24_split_skills", "SELECT p_partkey, size(filter(transform(split(p_name, ' '), x -> trim(x)), x -> x <> '')) AS n FROM {part}", "SELECT p_partkey, len(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '')) AS n FROM {part}")
R.sql("str25_digits", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '') AS digits, length(regexp_replace(c_name, '[^0-9]', '')) >= 7 AS valid FROM {customer}", "SELECT c_custkey, regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 7 AS valid FROM {customer}")
R.sql("str26_target_price", "SELECT doc_id, text RLIKE '(?i)(target|benchmark) price' AS found FROM {documents}", "SELECT doc_id, regexp_matches(text, '(?i)(target|benchmark) price') AS found FROM {documents}")

R.sql("dat1_weekend", "SELECT o_orderkey, weekday(o_orderdate) >= 5 AS weekend FROM {orders}", "SELECT o_orderkey, isodow(o_orderdate) >= 6 AS weekend FROM {orders}")
R.sql("dat4_elapsed", f"SELECT row_key, greatest(datediff(DATE '2002-01-01', d), 0) AS days, {s4('datediff(DATE ' + chr(39) + '2002-01-01' + chr(39) + ', d) / 365.25E0')} AS years, {s4('ln(datediff(DATE ' + chr(39) + '2002-01-01' + chr(39) + ', d) + 1)')} AS log_days FROM {{catalog}}",
      f"SELECT row_key, greatest(date_diff('day', d, DATE '2002-01-01'), 0) AS days, {s4('date_diff(' + chr(39) + 'day' + chr(39) + ', d, DATE ' + chr(39) + '2002-01-01' + chr(39) + ') / 365.25E0')} AS years, {s4('ln(date_diff(' + chr(39) + 'day' + chr(39) + ', d, DATE ' + chr(39) + '2002-01-01' + chr(39) + ') + 1)')} AS log_days FROM {{catalog}}")
R.sql("dat5_recency_buckets", "SELECT CASE WHEN days <= 180 THEN 1 WHEN days <= 365 THEN 2 WHEN days <= 730 THEN 3 WHEN days <= 1095 THEN 4 WHEN days <= 1825 THEN 5 ELSE 6 END AS bucket, count(*) AS n FROM {pool} GROUP BY 1")
R.sql("dat6_decay_families", f"SELECT q, pool_rank, {s4('exp(-ln(2) * days / 365)')} AS half_365, {s4('exp(-ln(2) * days / 730)')} AS half_730, {s4('exp(-days / 730.0E0)')} AS fold_730, {s4('exp(-days / 365.25E0)')} AS fold_365 FROM {{pool}}")
R.sql("dat7_epoch_day", "SELECT row_key, datediff(d, DATE '2009-01-01') AS day FROM {catalog}", "SELECT row_key, date_diff('day', DATE '2009-01-01', d) AS day FROM {catalog}")



R.sql("mth6_quantity_tiers", "SELECT row_key, CASE WHEN qty <= 5 THEN 'SMALL' WHEN qty <= 50 THEN 'MEDIUM' WHEN qty <= 500 THEN 'LARGE' ELSE 'BULK' END AS tier FROM {catalog}")
R.sql("mth9_spec_ratio", "SELECT q, pool_rank, CASE WHEN abs(c_qty - q_qty) / greatest(q_qty, 0.0001) <= 0.15 THEN 1.0E0 WHEN abs(c_qty - q_qty) / greatest(q_qty, 0.0001) > 0.35 THEN 0.0E0 ELSE 0.5E0 END AS state FROM {pool}")
R.sql("arr1_any_slice_join", "SELECT p_partkey, exists(split(p_name, ' '), x -> x LIKE 's%') AS any_s, array_join(slice(split(p_name, ' '), 1, 1), ' ') AS first FROM {part}", "SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x LIKE 's%')) > 0 AS any_s, string_split(p_name, ' ')[1] AS first FROM {part}")
R.sql("arr2_coordinate_coercion", "SELECT n_nationkey, coalesce(CASE WHEN n_regionkey = 0 THEN NULL ELSE n_nationkey * 1.5 END, n_regionkey * 2.0, 0.0) AS lat FROM {nation}")
R.sql("arr3_id_coalescing", "SELECT coalesce(o_custkey, o_orderkey) AS id, count(*) AS n FROM {orders} GROUP BY 1")
R.sql("jsn3_payload", "SELECT s_suppkey, to_json(named_struct('key', s_suppkey, 'name', s_name)) AS payload FROM {supplier}", "SELECT s_suppkey, CAST(json_object('key', s_suppkey, 'name', s_name) AS VARCHAR) AS payload FROM {supplier}")

# ---- scoring and rules
R.sql("rul2_verified", "SELECT c_custkey FROM {customer} WHERE c_acctbal > 0")
R.sql(
    "fg1_provenance_features",
    "SELECT q, pool_rank, CASE WHEN q_model = c_model THEN 1 ELSE 0 END AS from_b, 1 AS from_i, 1 + CASE WHEN q_model = c_model THEN 1 ELSE 0 END AS channels FROM {pool}",
)
R.sql("fg0_base_features", f"SELECT q, pool_rank, {s4('ln(1 + days)')} AS log_days, {s4('abs(ln(c_qty / q_qty))')} AS qty_gap, CASE WHEN q_code = c_code THEN 1 ELSE 0 END AS same_code, CASE WHEN q_uom = c_uom THEN 1 ELSE 0 END AS same_uom, CASE WHEN q_text = c_text THEN 1 ELSE 0 END AS same_text FROM {{pool}}")
R.sql("fg5_pool_features", f"SELECT q, pool_rank, {s4('(c_lp - avg(c_lp) OVER (PARTITION BY q))')} AS off_mean, {s4('c_price / median(c_price) OVER (PARTITION BY q)')} AS to_median, count(*) OVER (PARTITION BY q) AS n FROM {{pool}}")
R.sql("fg6_hard_case_flags", "SELECT q, CASE WHEN n < 5 THEN 1 ELSE 0 END AS thin, CASE WHEN sd > 0.8 THEN 1 ELSE 0 END AS dispersed, CASE WHEN d > 730 THEN 1 ELSE 0 END AS stale FROM (SELECT q, count(*) AS n, stddev_pop(c_lp) AS sd, min(days) AS d FROM {pool} GROUP BY q) t")
R.sql("fg10_quantity_features", f"SELECT q, pool_rank, {s4('least(q_qty, c_qty) / greatest(q_qty, c_qty)')} AS ratio, CASE WHEN (q_qty <= 5 AND c_qty <= 5) OR (q_qty > 5 AND c_qty > 5) THEN 1 ELSE 0 END AS same_tier FROM {{pool}}")
R.sql("fg11_temporal_features", f"SELECT q, pool_rank, {s4('exp(-days / 365.25E0)')} AS fresh, CASE WHEN days <= 180 THEN 1 ELSE 0 END AS recent, {s4('days / 365.25E0')} AS years FROM {{pool}}")
R.sql("fg12_order_features", f"SELECT t.row_key, {s4('h.hhi')} AS hhi, h.n AS codes FROM {{catalog}} t JOIN (SELECT po, sum(s * s) AS hhi, count(*) AS n FROM (SELECT po, sum(qty) / sum(sum(qty)) OVER (PARTITION BY po) AS s FROM {{catalog}} GROUP BY po, code) u GROUP BY po) h ON t.po = h.po WHERE t.d >= DATE '2001-01-01'")

QUERIES, ORACLES = R.queries, R.oracles
