"""Product identity of the parts' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import identity as I
from tallywright.plans.base import Registry

R = Registry()

#: Lines of a tender made from the parts: what is said of every part follows from its key.
SAID = (
    "Dell Latitude 5420 laptop", "HP LaserJet M404-DN printer, part no. 2ZV-81A", "cisco meraki MS250-48FP switch", "Catalyst C93 access point", "ball valve model: KV_200/A by Kennedy Valve", "Thomas and Betts coupling p/n TB.77-9",
    "Lenovo ThinkCentre M70 tiny desktop", "optiplex 70 small form factor", "hat and glove", "cat# 4411-22 filter", "generic conduit", "GE lighting led lamp model 60W-2", "submersible pump MT", "Square D padmount", "reagent, hach", "desk",
)
LINES = f"""SELECT p_partkey, concat(p_name, ' ', {" ".join(["CASE p_partkey % " + str(len(SAID)), *(f"WHEN {i} THEN '{t}'" for i, t in enumerate(SAID)), "END"])}, ' ', CAST(p_size AS VARCHAR(9))) AS text,
 CASE p_partkey % 11 WHEN 3 THEN 'Acme  Tools' WHEN 5 THEN '' END AS brand, CASE p_partkey % 13 WHEN 4 THEN ' x-100 ' END AS model, CASE p_partkey % 17 WHEN 2 THEN '77/88' WHEN 6 THEN '?' END AS part_number,
 p_brand AS code, p_type AS family, CASE p_size % 3 WHEN 0 THEN 'ea' WHEN 1 THEN 'BX' END AS unit FROM {{part}}"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, text and what is known of each line."""
    return spark.sql(LINES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _values(table: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({i}, '{name}', '(?i)\\b(?:{words})\\b')" for i, (name, words) in enumerate(table))


TOKEN = r"CASE WHEN length(regexp_replace(regexp_replace(upper(trim({0})), '[\s\-_/]+', '-', 'g'), '^[^A-Z0-9]+|[^A-Z0-9]+$', '', 'g')) >= 2 THEN regexp_replace(regexp_replace(upper(trim({0})), '[\s\-_/]+', '-', 'g'), '^[^A-Z0-9]+|[^A-Z0-9]+$', '', 'g') END"
FAMILY = rf"(?i)\b({I.SERIES})\s+([a-zA-Z0-9\-]{{3,15}})\b"
IDENTITY_SQL = rf"""WITH line AS MATERIALIZED ({LINES.replace('{part}', 'part')}), brands(place, name, pattern) AS (VALUES {_values(I.BRANDS)}), types(place, name, pattern) AS (VALUES {_values(I.TYPES)}), variants(place, name, pattern) AS (VALUES {_values(I.VARIANTS)}),
 found AS (SELECT p_partkey, arg_min(name, place) AS brand FROM line JOIN brands ON regexp_matches(text, pattern) GROUP BY 1), kind AS (SELECT p_partkey, arg_min(name, place) AS kind FROM line JOIN types ON regexp_matches(text, pattern) GROUP BY 1), variant AS (SELECT p_partkey, arg_min(name, place) AS variant FROM line JOIN variants ON regexp_matches(text, pattern) GROUP BY 1),
 part1 AS (SELECT l.*, coalesce(nullif(l.brand, ''), f.brand) AS b, coalesce(kind, 'OTHER') AS kind, variant, upper(nullif(regexp_extract(text, '{FAMILY}', 1), '')) AS series, upper(nullif(regexp_extract(text, '{FAMILY}', 2), '')) AS num,
 nullif(regexp_extract(text, '(?i)\b(?:{I.MODEL}){I.CODE}', 1), '') AS said_model, nullif(regexp_extract(text, '(?i)\b(?:{I.PART_NUMBER}){I.CODE}', 1), '') AS said_part FROM line l LEFT JOIN found f USING (p_partkey) LEFT JOIN kind USING (p_partkey) LEFT JOIN variant USING (p_partkey)),
 part2 AS (SELECT *, coalesce(series || ' ' || num, nullif(model, ''), {TOKEN.format('said_model')}) AS m, coalesce(nullif(part_number, ''), {TOKEN.format('said_part')}) AS p, nullif(regexp_extract(num, '(\d{{2,4}})', 1), '') AS digits FROM part1),
 part3 AS (SELECT *, {TOKEN.format('b')} AS nb, {TOKEN.format('m')} AS nm, {TOKEN.format('p')} AS np, CASE WHEN digits IS NULL THEN series WHEN length(digits) = 4 THEN series || ' ' || digits[1] || '000' ELSE series || ' ' || digits END AS fam FROM part2)
SELECT p_partkey, nb AS brand, nm AS model, {TOKEN.format('fam')} AS model_family, np AS part_number, kind AS product_type, variant, CASE WHEN np IS NOT NULL THEN code || '|MPN:' || np || '|' || coalesce(unit, '') WHEN nb IS NOT NULL AND nm IS NOT NULL THEN code || '|' || nb || '|' || nm || '|' || coalesce(unit, '')
 WHEN nb IS NOT NULL THEN family || '|' || nb || '|' || kind || '|' || coalesce(unit, '') ELSE code || '|' || kind || '|' || coalesce(unit, '') END AS identity_key, CASE WHEN np IS NOT NULL OR (nb IS NOT NULL AND nm IS NOT NULL) THEN 'HIGH' WHEN nb IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM part3"""


@R.query("str19_product_identity", IDENTITY_SQL)
def str19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand, model, family, part number, type, variant, key and confidence of every line."""
    found = I.product_identity(*[F.col(c) for c in ("text", "brand", "model", "part_number", "code", "family", "unit")])
    return lines(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in found.items()])


KNOWN = "CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '|MPN:', p_partkey) WHEN 1 THEN concat(p_brand, '|GENERIC|', p_type) WHEN 2 THEN ' ' END"


@R.query(
    "str21_stratified_key",
    f"""SELECT p_partkey, CASE WHEN trim(coalesce(known, '')) <> '' AND NOT contains(known, 'GENERIC') THEN trim(known) ELSE concat(code, '|GENERIC|', coalesce(nullif(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+')[1:4], lambda w: upper(w)), '_'), ''), 'GENERIC'), '|', coalesce(upper(unit), 'EA')) END AS strat_key
 FROM ({LINES.replace('{part}', 'part')}) JOIN (SELECT p_partkey, {KNOWN} AS known FROM part) USING (p_partkey)""",
)
def str21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known key, or one of code, four words and unit where it is generic."""
    known = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{KNOWN} AS known")
    return lines(spark, sf_dir).join(known, "p_partkey").select("p_partkey", I.stratified_key(F.col("known"), F.col("text"), F.col("code"), F.col("unit")).alias("strat_key"))


QUERIES, ORACLES = R.queries, R.oracles
