"""Word and character TF-IDF of the parts' texts, their truncated SVD, and composite vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import svd
from tallywright.plans.base import Registry, read
from tallywright.plans.retrieval import q4, s4

R = Registry()

# Dimensions, least rows of a term, and most terms, for words and for characters.
RANK = 64
WORD_LEAST, WORD_MOST = 5, 25000
CHAR_LEAST, CHAR_MOST = 10, 35000
TEXT = "lower(concat_ws(' ', p_name, p_type, 'size', p_size))"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, texts: every key of a part with its texts in order, dealt by key, as the parts' small file is one task."""
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(TEXT).alias("text"))
    return rows.repartition("id").groupBy("id").agg(F.array_sort(F.collect_list("text")).alias("texts"))


def _classes(texts: DataFrame) -> DataFrame:
    """id, copies: the texts of a part's key (one, where keys do not repeat) as an array, and the number of keys that have them; an id's row lies in one task by it."""
    return texts.groupBy("texts").agg(F.count("*").alias("copies")).withColumnRenamed("texts", "id")


def word_terms(texts: DataFrame) -> DataFrame:
    """id, copies, term: words of two characters or more and pairs of neighbours, one row for each use."""
    words = texts.select("id", "copies", F.regexp_extract_all("text", F.lit(r"(\w\w+)"), F.lit(1)).alias("w"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)))
    return words.select("id", "copies", F.explode(F.when(F.size("w") > 1, F.concat("w", pairs)).otherwise(F.col("w"))).alias("term"))


def char_terms(texts: DataFrame) -> DataFrame:
    """id, copies, term: runs of 3, 4 and 5 characters of words with a space on either side; where a word is no longer than a run it stands whole, and longer runs are left out."""
    words = texts.select("id", "copies", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w")).select("id", "copies", F.concat(F.lit(" "), F.col("w"), F.lit(" ")).alias("w"))
    size = F.char_length("w")
    starts = [F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), _run(n)) for n in (3, 4, 5)]
    none = F.array().cast("array<string>")
    return words.select("id", "copies", F.explode(F.concat(starts[0], F.when(size > 3, starts[1]).otherwise(none), F.when(size > 4, starts[2]).otherwise(none))).alias("term"))


def _run(n: int):
    return lambda i: F.substr(F.col("w"), i, F.lit(n))


def text_weights(spark: SparkSession, sf_dir: str, kind: str, texts: DataFrame) -> DataFrame:
    """id (texts of a key), copies, e (array of term, col, weight): once for each text, whatever the number of parts that have it."""
    single = _classes(texts).select("id", "copies", F.explode("id").alias("text"))
    terms, least, most = (word_terms(single), WORD_LEAST, WORD_MOST) if kind == "word" else (char_terms(single), CHAR_LEAST, CHAR_MOST)
    return svd.tfidf(terms, read(spark, sf_dir, "part").count(), least, most)


def _of_parts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of found (id: texts of a key) for each part's key; by name, as the size of the files says little about rows that repeat their texts."""
    return texts.join(found.withColumnRenamed("id", "texts").hint("merge"), "texts").drop("texts")


def part_weights(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """id, term, col, weight of the parts' texts."""
    texts = _texts(spark, sf_dir)
    return _of_parts(texts, text_weights(spark, sf_dir, kind, texts)).select("id", F.inline("e"))


def part_vectors(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """id, vector: 64 dimensions of the parts' texts, by words, by characters, or composite."""
    texts = _texts(spark, sf_dir)

    def vectors(of: str) -> DataFrame:
        return svd.embed(text_weights(spark, sf_dir, of, texts), RANK)[0]

    return _of_parts(texts, svd.composite(vectors("word"), vectors("char")) if kind == "composite" else vectors(kind))


def _weights_sql(terms: str, least: int, most: int) -> str:
    return f"""WITH text AS (SELECT p_partkey, {TEXT} AS t FROM part), term AS ({terms}), use AS (SELECT p_partkey, term, count(*) AS tf FROM term GROUP BY ALL),
 kept AS (SELECT term, count(*) AS df FROM use GROUP BY term HAVING count(*) >= {least} ORDER BY sum(tf) DESC, term LIMIT {most}),
 x AS (SELECT p_partkey, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS x FROM use JOIN kept USING (term)) SELECT p_partkey, term, {s4('x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey))')} AS weight FROM x"""


WORD_SQL = r"SELECT p_partkey, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT p_partkey, regexp_extract_all(t, '\w\w+') AS w FROM text)"
CHAR_SQL = r"SELECT p_partkey, unnest(list_transform(range(1, greatest(length(w) - n + 1, 1) + 1), lambda i: substr(w, i, n))) AS term FROM (SELECT p_partkey, ' ' || unnest(regexp_extract_all(t, '\S+')) || ' ' AS w FROM text), (VALUES (3), (4), (5)) v(n) WHERE n = 3 OR length(w) > n - 1"


@R.query("ml1_word_weights", _weights_sql(WORD_SQL, WORD_LEAST, WORD_MOST))
def ml1_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of words and pairs of words."""
    return part_weights(spark, sf_dir, "word").select(F.col("id").alias("p_partkey"), "term", q4(F.col("weight")).alias("weight"))


@R.query("ml2_char_weights", _weights_sql(CHAR_SQL, CHAR_LEAST, CHAR_MOST))
def ml2_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of runs of characters within words."""
    return part_weights(spark, sf_dir, "char").select(F.col("id").alias("p_partkey"), "term", q4(F.col("weight")).alias("weight"))


def _register(name: str, kind: str, what: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return part_vectors(spark, sf_dir, kind).select(F.col("id").alias("p_partkey"), "vector")

    run.__doc__ = what
    R.query(name)(run)


_register("ml1_word_svd", "word", "Unit vectors of 64 dimensions from words.")
_register("ml2_char_svd", "char", "Unit vectors of 64 dimensions from runs of characters.")
_register("ml3_composite_svd", "composite", "Mean of both unit vectors, of length one.")

QUERIES, ORACLES = R.queries, R.oracles
