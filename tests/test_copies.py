"""Tables whose parts repeat their texts under other keys, and queries that move a few times instead of once for each row found."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_queries import SF, rows_of

from tallywright.operators import temporal
from tallywright.plans import channels, similarity

TIMES = 3


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """sf0.001 with 60 of its parts, thrice under shifted keys."""
    folder, duck = tmp_path_factory.mktemp("copied"), duckdb.connect()
    lines, orders, parts = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    parts = parts.head(60)
    lines = lines[lines.l_partkey.isin(parts.p_partkey)]
    for name, frame, keys in (("lineitem", lines, ["l_orderkey", "l_partkey"]), ("orders", orders, ["o_orderkey"]), ("part", parts, ["p_partkey"])):
        shifted = [frame.assign(**{k: frame[k] + i * 1_000_003 for k in keys}) for i in range(TIMES)]
        pd.concat(shifted).to_parquet(f"{folder}/{name}.parquet", index=False, coerce_timestamps="us")
        duck.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return str(folder), duck


def test_copies_of_a_text_meet_once(spark, copied):
    folder, _ = copied
    classes = channels.text_classes(spark, folder, "p_brand")
    assert classes.count() == 60 * TIMES
    rows = channels.of_classes(channels.lines(spark, folder), classes)
    pairs = channels.similar_parts(spark, folder, "word", "code", 0.0, rows, classes)
    named = {r[0] for r in classes.select("class").distinct().collect()}
    assert len(named) <= 60 and {r.a for r in pairs.collect()} <= named
    assert rows.count() == channels.lines(spark, folder).count()


@pytest.mark.parametrize("name", ["che_word_cosine", "chf_char_cosine", "chh_family_rank", "sim1_similarity_search"])
def test_copies_keep_their_rows(spark, copied, name):
    folder, duck = copied
    module = similarity if name.startswith("sim") else channels
    got = module.QUERIES[name](spark, folder).toPandas()
    assert rows_of(got) == rows_of(duck.execute(module.ORACLES[name]).df())


def test_newest_rows_lie_in_two_blocks(spark):
    frame = spark.range(1, 200).withColumnRenamed("id", "prior")
    for n in (1, 3, 30):
        for prior, blocks in frame.select("prior", temporal._blocks(n)).collect():
            assert len(blocks) <= 2
            assert {p // n for p in range(max(prior - n + 1, 1), prior + 1)} == set(blocks)


def test_every_newest_row_is_found_once(spark):
    rows = spark.range(100).select(F.concat(F.lit("r"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("row_key"), F.lit("k").alias("k"), F.expr("date_add(date'2000-01-01', cast(id div 7 as int))").alias("d"))
    got = temporal.latest_prior(rows, F.lit(True), ["k"], 10, ["row_key", "d"])
    found = got.groupBy("q_row_key").agg(F.array_sort(F.collect_list("pool_rank")).alias("ranks"), F.array_sort(F.collect_list("c_row_key")).alias("c")).collect()
    assert len(found) == 93
    for r in found:
        prior = int(r.q_row_key[1:]) // 7 * 7
        assert r.ranks == list(range(1, min(10, prior) + 1)) and r.c == [f"r{i:03}" for i in range(max(0, prior - 10), prior)]
