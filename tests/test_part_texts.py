"""Queries on the parts' texts over tables whose parts repeat, share keys or lack columns."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows_of

from tallywright.plans import details, more, vectors


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """sf0.001's parts thrice under shifted keys, some of them twice under one key, and some without name or type."""
    folder, duck = tmp_path_factory.mktemp("parts"), duckdb.connect()
    part = pd.read_parquet(f"{SF}/part.parquet")
    twice = part.head(7)
    bare = part.head(6).assign(p_partkey=lambda x: x.p_partkey + 9_000_000, p_type=[None] * 3 + ["LARGE"] * 3, p_name=["red ring"] * 3 + [None] * 3)
    pd.concat([*(part.assign(p_partkey=part.p_partkey + i * 1_000_003) for i in range(3)), twice, bare]).to_parquet(f"{folder}/part.parquet", index=False)
    duck.execute(f"create view part as select * from '{folder}/part.parquet'")
    return str(folder), duck


def test_market_match_of_repeated_parts(spark, parts):
    """Parts of one key stay apart, and those without name or type match nothing, as in SQL."""
    folder, duck = parts
    assert rows_of(more.QUERIES["str13_market_match"](spark, folder).toPandas()) == rows_of(duck.execute(more.ORACLES["str13_market_match"]).df())


def test_market_pairs_meet_once(spark):
    texts = spark.createDataFrame([("a b c a",), ("a b x",), ("c",), ("",), ("a  b",)], "text string")
    names = spark.createDataFrame([("a b",), ("b a c",), ("c c",), (" ",)], "b_name string")
    got = more.market_pairs(texts, names).groupBy("text", "b_name").agg(F.count("*").alias("n"), F.max("score").alias("score")).collect()
    assert {(r.text, r.b_name): (r.n, r.score) for r in got} == {
        ("a b c a", "a b"): (1, 0.5), ("a b c a", "b a c"): (1, 0.75), ("a b x", "a b"): (1, 0.6667), ("a b x", "b a c"): (1, 0.6667), ("a  b", "a b"): (1, 0.6667), ("a  b", "b a c"): (1, 0.6667),
    }


def test_hash_embedding_of_repeated_parts(spark, parts):
    """As in SQL, where a part without name too has 384 numbers, all missing; and the digest is made once for each part, not once for each number."""
    folder, duck = parts
    got = details.QUERIES["mth5_hash_embedding"](spark, folder)
    assert rows_of(got.toPandas()) == rows_of(duck.execute(details.ORACLES["mth5_hash_embedding"]).df())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and "sha2" not in "".join(re.findall(r"lambdafunction\(.*?sha2", plan))


@pytest.mark.parametrize("name", ["ml1_word_weights", "ml2_char_weights"])
def test_weights_of_repeated_parts(spark, parts, name):
    """A key's texts are one, copies count in the frequencies, as in SQL."""
    folder, duck = parts
    assert rows_of(vectors.QUERIES[name](spark, folder).toPandas()) == rows_of(duck.execute(vectors.ORACLES[name]).df())


def test_copies_of_a_text_are_weighed_once(spark, parts):
    """One row of weights for each text, and vectors whose cosines are those of all parts' weights."""
    folder, _ = parts
    texts = vectors._texts(spark, folder)
    once = vectors.text_weights(spark, folder, "char", texts)
    assert once.count() == texts.select("texts").distinct().count() < texts.count() / 2
    assert once.agg(F.sum("copies")).first()[0] == texts.count()
    found = {r.id: np.array(r.vector) for r in vectors.part_vectors(spark, folder, "char").collect()}
    weights = vectors.part_weights(spark, folder, "char").toPandas()
    ids = sorted(weights["id"].unique())
    dense = np.zeros((len(ids), weights["col"].max() + 1))
    dense[np.searchsorted(ids, weights["id"]), weights["col"]] = weights["weight"]
    _, _, right = np.linalg.svd(dense, full_matrices=False)
    plain = dense @ right[:64].T
    plain /= np.linalg.norm(plain, axis=1, keepdims=True)
    low = np.array([found[i] for i in ids])
    assert len(found) == len(ids) and np.abs(low @ low.T - plain @ plain.T).max() < 0.05
