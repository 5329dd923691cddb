"""Market search with its rejections, offers below a price by global rank, and a gazetteer in passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.operators.ranksum import cumulative
from tallywright.operators.setjoin import containing, longest_keys, overlapping
from tallywright.plans.base import Registry, read
from tallywright.plans.identity import LINES
from tallywright.plans.retrieval import q4, s4
from tallywright.sources.shared import materialized

R = Registry()

# Words without weight, categories in order with their terms, product families in order, and units by alias.
STOPWORDS = """
the and for with from new item product procurement model brand of a an to in each computer accessories
accessory supplies qty environmentally certified handheld microcomputers laptop notebook tablets
""".split()
CATEGORIES = (
    ("stylus", ("apple pencil", "stylus", "digital pen")),
    ("backpack", ("backpack", "backpacks", "rucksack")),
    ("keyboard_mouse", ("keyboard", "mouse", "keyboard mouse")),
    ("adapter", ("adapter", "charger", "power supply")),
    ("dock", ("dock", "docking")),
    ("router", ("router", "routers")),
    ("monitor", ("monitor", "monitors", "display")),
    ("tablet", ("ipad", "tablet", "tablets")),
    ("laptop", ("laptop", "notebook", "workstation")),
)
FAMILIES = ("latitude", "precision", "pro max", "ultrasharp", "pro plus", "ipad mini", "ipad pro", "ipad a16", "performance dock", "smart dock", "catalyst")
UNITS = {"each": "each", "ea": "each", "unit": "each", "units": "each", "piece": "each", "pieces": "each", "set": "set", "pair": "pair", "hour": "hour", "hours": "hour", "kg": "kg", "kilogram": "kg", "kilograms": "kg"}
IDENTIFIER, FAMILY_NUMBER = r"(?<![A-Za-z0-9])[A-Za-z]{1,6}[- ]?\d[A-Za-z0-9-]*(?![A-Za-z0-9])", r"(?i)\b(latitude|precision)\s+(\d{3,4})\b"
LEAST_SCORE, RESULTS = 0.35, 10


def normalised(text: Column) -> Column:
    """Lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Distinct words of two characters or more, without those of no weight."""
    return F.array_distinct(F.filter(F.split(normalised(text), " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS)))


def identifiers(text: Column) -> Column:
    """Distinct codes of letters and a number, in lower case without marks, and a family with its number."""
    said = F.coalesce(text, F.lit(""))
    codes = F.transform(F.regexp_extract_all(said, F.lit(f"({IDENTIFIER})"), 1), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", ""))
    series = F.zip_with(F.regexp_extract_all(said, F.lit(FAMILY_NUMBER), 1), F.regexp_extract_all(said, F.lit(FAMILY_NUMBER), 2), lambda a, b: F.concat(F.lower(a), b))
    return F.array_distinct(F.concat(codes, series))


def category(text: Column) -> Column:
    """The first category that a term of it names, else null."""
    said = normalised(text)
    hits = []
    for name, terms in CATEGORIES:
        named = F.contains(said, F.lit(terms[0]))
        for term in terms[1:]:
            named = named | F.contains(said, F.lit(term))
        hits.append(F.when(named, name))
    return F.coalesce(*hits)


def family(text: Column) -> Column:
    """The first product family that stands in the text, else null."""
    return F.coalesce(*[F.when(F.contains(normalised(text), F.lit(name)), name) for name in FAMILIES])


def unit(value: Column) -> Column:
    """A unit by its alias; others as they are."""
    said = normalised(value)
    return F.coalesce(*[F.when(said == alias, name) for alias, name in UNITS.items()], said)


def described(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens, ids, category and family of each text, besides the other columns."""
    t = F.col(text)
    return rows.select("*", tokens(t).alias("tokens"), identifiers(t).alias("ids"), category(t).alias("category"), family(t).alias("family"))


def search_market(asks: DataFrame, offers: DataFrame, least: float = LEAST_SCORE, results: int = RESULTS) -> DataFrame:
    """q, e, score, reason, place: for each query the best offers that none of the rules rejects.

    asks: q, text, currency, unit (null: any). offers: e, text, currency, unit, price.
    Rejected are another category (a missing one matches a missing one), offers that
    lack an identifier of the query, another family where both have one, fewer than
    two shared words where the query has more and no identifiers, a share of the
    query's words below ``least``, another currency or unit than asked for, and
    offers without a price above zero, currency or unit. Ties go to the smaller e.
    Queries with identifiers find offers by those, others by a minimum overlap.
    """
    asks = materialized(described(asks.withColumnRenamed("currency", "q_currency").withColumn("q_unit", F.when(F.col("unit").isNotNull(), unit(F.col("unit")))).drop("unit"), "q", "text"), "asks")
    usable = offers.withColumn("unit", unit(F.col("unit"))).withColumn("currency", F.upper(F.trim(F.coalesce("currency", F.lit("")))))
    offers = materialized(described(usable.where((F.col("price") > 0) & (F.col("currency") != "") & (F.col("unit") != "")), "e", "text"), "offers")
    n = F.size("tokens")
    two = F.when(n > 1, F.lit(2)).otherwise(F.lit(1))
    need = F.greatest(two, F.ceil(F.lit(least) * n - 1e-9)).cast("int")
    plain = asks.where((F.size("ids") == 0) & (n > 0))
    pairs = overlapping(plain, offers, need).select("q", "e").unionByName(containing(asks, offers))
    other = offers.select("e", F.col("tokens").alias("e_tokens"), F.col("category").alias("e_category"), F.col("family").alias("e_family"), F.col("currency"), F.col("unit"))
    both = pairs.join(asks.drop("text"), "q").join(other, "e")
    score = F.when(n > 0, F.size(F.array_intersect("tokens", "e_tokens")) / n).otherwise(0.0)
    kept = both.withColumn("score", score).where(
        F.col("category").eqNullSafe(F.col("e_category")) & F.coalesce(F.col("family") == F.col("e_family"), F.lit(True)) & (F.col("score") >= least)
        & F.coalesce(F.upper(F.trim("q_currency")) == F.col("currency"), F.lit(True)) & F.coalesce(F.col("q_unit") == F.col("unit"), F.lit(True))
    )
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "e"))
    reason = F.when(F.size("ids") > 0, "exact_model_identifier").otherwise("category_and_token_match")
    return kept.select("q", "e", "score", reason.alias("reason"), place.alias("place")).where(F.col("place") <= results)


OFFERS = f"""SELECT min(p_partkey) AS e, text, CASE min(p_partkey) % 9 WHEN 4 THEN 'eur' WHEN 5 THEN '' ELSE 'USD' END AS currency, CASE min(p_partkey) % 8 WHEN 3 THEN 'Pieces' WHEN 5 THEN NULL WHEN 6 THEN 'box' ELSE 'EA' END AS unit, min(price) AS price
 FROM (SELECT l.p_partkey, regexp_replace(l.text, ' [0-9]+$', '') AS text, CASE WHEN l.p_partkey % 10 = 7 THEN 0.0E0 ELSE p_retailprice END AS price FROM ({LINES}) l JOIN {{part}} p ON l.p_partkey = p.p_partkey) x GROUP BY text"""
ASKS = f"SELECT p_partkey AS q, text, CASE p_partkey % 4 WHEN 1 THEN 'usd' END AS currency, CASE p_partkey % 6 WHEN 2 THEN 'unit' WHEN 3 THEN 'BOX' END AS unit FROM ({LINES}) l"


def _terms(column: str) -> str:
    hits = " ".join(f"WHEN {' OR '.join(f'''contains({column}, '{t}')''' for t in terms)} THEN '{name}'" for name, terms in CATEGORIES)
    return f"CASE {hits} END"


_NORM = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_UNIT = f"CASE trim(regexp_replace(lower(coalesce(unit, '')), '[^a-z0-9]+', ' ', 'g')) {' '.join(f'''WHEN '{a}' THEN '{n}' ''' for a, n in UNITS.items())} ELSE trim(regexp_replace(lower(coalesce(unit, '')), '[^a-z0-9]+', ' ', 'g')) END"
#: RE2 looks neither ahead nor behind: the characters around an identifier are matched with it and dropped, over a text whose gaps are doubled.
_IDS = r"list_distinct(list_transform(regexp_extract_all(' ' || regexp_replace(text, '([^A-Za-z0-9-])', '\1\1', 'g') || ' ', '[^A-Za-z0-9]([A-Za-z]{1,6}(?:-|  )?\d[A-Za-z0-9-]*)', 1), lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')) || list_transform(regexp_extract_all(text, '(?i)\b(?:latitude|precision)\s+\d{3,4}\b'), lambda x: lower(regexp_replace(x, '\s+', '', 'g'))))"
_FAMILY = "CASE " + " ".join(f"WHEN contains(norm, '{f}') THEN '{f}'" for f in FAMILIES) + " END"


def _described(table: str) -> str:
    return f"SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda w: length(w) > 1 AND NOT list_contains([{_STOP}], w))) AS t, {_IDS} AS ids, {_terms('norm')} AS cat, {_FAMILY} AS fam FROM (SELECT *, {_NORM} AS norm, {_UNIT} AS u FROM {table})"


SEARCH_SQL = f"""WITH ask AS MATERIALIZED ({_described('(' + ASKS.replace('{part}', 'part') + ')')}), offer AS MATERIALIZED ({_described('(' + OFFERS.replace('{part}', 'part') + ')')})
SELECT q, e, {s4('score')} AS score, reason, place FROM (SELECT q, e, score, CASE WHEN len(ids) > 0 THEN 'exact_model_identifier' ELSE 'category_and_token_match' END AS reason, row_number() OVER (PARTITION BY q ORDER BY score DESC, e) AS place
 FROM (SELECT a.q, b.e, a.ids, len(list_intersect(a.t, b.t)) AS shared, len(a.t) AS n, CASE WHEN len(a.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(a.t)::DOUBLE ELSE 0 END AS score FROM ask a JOIN offer b ON a.cat IS NOT DISTINCT FROM b.cat WHERE list_has_all(b.ids, a.ids) AND (a.fam IS NULL OR b.fam IS NULL OR a.fam = b.fam) AND (a.currency IS NULL OR upper(a.currency) = upper(b.currency)) AND (a.unit IS NULL OR a.u = b.u)
 AND b.price > 0 AND b.currency <> '' AND b.u <> '') WHERE score >= {LEAST_SCORE} AND NOT (n > 1 AND shared < 2 AND len(ids) = 0)) WHERE place <= {RESULTS}"""


@R.query("str13_market_search", SEARCH_SQL)
def str13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best market offers of every line, after the eight rejections."""
    part = read(spark, sf_dir, "part")
    found = search_market(spark.sql(ASKS, part=part), spark.sql(OFFERS, part=part))
    return found.withColumn("score", q4(F.col("score")))


# ---- offers below a price


@R.query("joi13_theta_market", "SELECT c_custkey, count(*) AS offers FROM customer JOIN supplier ON c_acctbal > s_acctbal GROUP BY c_custkey")
def joi13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the suppliers of a smaller balance, where there are any: counted by global rank, no pair is formed."""
    customers, suppliers = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    values = suppliers.select(F.col("s_acctbal").alias("balance"), F.lit(1).alias("n")).unionByName(customers.select(F.col("c_acctbal").alias("balance"), F.lit(0).alias("n")))
    ranked = cumulative(values.withColumn("every", F.lit(1)).groupBy("every", "balance").agg(F.sum("n").alias("n")), ["every"], "balance")
    below = ranked.select(F.col("balance").alias("c_acctbal"), F.col("before").alias("offers"))
    return customers.join(below, "c_acctbal").where("offers > 0").select("c_custkey", "offers")


# ---- gazetteer

# Where a place is that no key names.
DEFAULT_LAT, DEFAULT_LNG = 28.6139, 77.2090
PLACES = "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN concat('Plot 12, ', n_name, ' (', r_name, ')') WHEN 1 THEN concat(lower(r_name), ' region') WHEN 2 THEN 'somewhere else' WHEN 3 THEN NULL WHEN 4 THEN concat('near ', upper(n_name), c_custkey % 10) WHEN 5 THEN '' ELSE concat(r_name, ' / ', lower(n_name)) END AS place FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
KEYS = "SELECT regexp_replace(lower(n_name), '[^a-z0-9]', '') AS key, 1 AS pass, n_nationkey * 2.5E0 AS lat, n_nationkey * 3.0E0 AS lng FROM {nation} UNION ALL SELECT regexp_replace(lower(r_name), '[^a-z0-9]', ''), 2, r_regionkey * 10.0E0, r_regionkey * 20.0E0 FROM {region}"


@R.query(
    "joi11_gazetteer_passes",
    f"""WITH place AS ({PLACES.replace('{', '').replace('}', '')}), key AS ({KEYS.replace('{', '').replace('}', '').replace("'')", "'', 'g')")}), clean AS (SELECT c_custkey, regexp_replace(lower(place), '[^a-z0-9]', '', 'g') AS t FROM place)
SELECT c.c_custkey, coalesce(key, 'default') AS key, coalesce(pass, 3) AS pass, coalesce(lat, {DEFAULT_LAT}) AS lat, coalesce(lng, {DEFAULT_LNG}) AS lng FROM clean c LEFT JOIN (SELECT * FROM clean JOIN key ON contains(t, key) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY pass, length(key) DESC, key) = 1) f USING (c_custkey)""",
)
def joi11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates of every customer's place: its longest city, else its longest state, else the default."""
    tables = {n: read(spark, sf_dir, n) for n in ("customer", "nation", "region")}
    places = materialized(spark.sql(PLACES, **tables).select(F.col("c_custkey").alias("id"), F.regexp_replace(F.lower(F.coalesce("place", F.lit(""))), "[^a-z0-9]", "").alias("text")), "places")
    keys = spark.sql(KEYS, nation=tables["nation"], region=tables["region"])
    found = longest_keys(places, keys)
    return places.join(found, "id", "left").select(F.col("id").alias("c_custkey"), F.coalesce("key", F.lit("default")).alias("key"), F.coalesce("pass", F.lit(3)).alias("pass"), F.coalesce("lat", F.lit(DEFAULT_LAT)).alias("lat"), F.coalesce("lng", F.lit(DEFAULT_LNG)).alias("lng"))


QUERIES, ORACLES = R.queries, R.oracles
