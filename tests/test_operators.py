"""Operators against brute force and hand-made cases."""

import datetime as dt

from pyspark.sql import functions as F

from tallywright.functions import text as T
from tallywright.functions.vector import cosine
from tallywright.operators.diversity import mmr
from tallywright.operators.temporal import decayed_stats, latest_prior
from tallywright.streaming import events as E


def rows(spark):
    data = [(f"r{i}", "ab"[i % 2], dt.date(2000, 1, 1) + dt.timedelta(days=(i * 7) % 50), float(i)) for i in range(60)]
    return data, spark.createDataFrame(data, "row_key string, k string, d date, lp double")


def test_latest_prior_is_strict_and_newest_first(spark):
    data, frame = rows(spark)
    got = latest_prior(frame, F.col("d") >= F.lit("2000-01-20").cast("date"), ["k"], 3, ["row_key", "d"]).collect()
    found = {}
    for r in got:
        found.setdefault(r.q_row_key, []).append((r.pool_rank, r.c_row_key))
    for key, k, d, _ in data:
        if d >= dt.date(2000, 1, 20):
            prior = sorted(((e, o) for o, j, e, _ in data if j == k and e < d), reverse=True)[:3]
            assert sorted(found.get(key, [])) == [(i, o) for i, (_, o) in enumerate(prior, 1)]


def test_decayed_stats_match_pairs(spark):
    data, frame = rows(spark)
    for r in decayed_stats(frame, F.lit(True), ["k"], 30.0).collect():
        prior = [(2 ** (-((r.d - d).days) / 30.0), x) for _, k, d, x in data if k == r.k and d < r.d]
        assert r.n_prior == len(prior)
        assert abs(r.w - sum(w for w, _ in prior)) < 1e-9
        assert abs(r["mean"] - sum(w * x for w, x in prior) / sum(w for w, _ in prior)) < 1e-9


def test_mmr_prefers_other_identities(spark):
    pool = spark.createDataFrame(
        [("q", "a", 1, 1.0, "x", 1, ["t"]), ("q", "b", 2, 0.9, "x", 1, ["t"]), ("q", "c", 3, 0.8, "y", 2, ["u"])],
        "q string, c string, r int, score double, identity string, po long, tokens array<string>",
    )
    assert [r.c for r in mmr(pool, k=2).orderBy("place").collect()] == ["a", "c"]


def test_text_functions(spark):
    one = spark.createDataFrame([("Pack of 12 rings", "of the"), ("9000 pcs", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in one.select(F.array_join(T.char_grams(F.lit("abcd"), 3), "|")).collect()][0] == "abc|bcd"


def test_cosine_of_zero_vector(spark):
    frame = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_streaming_matches_batch(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), 100)
    query = E.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    want = base.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_upsert_keeps_latest(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    base.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = E.event_stream(spark, str(tmp_path / "in"), 1)
    query = stream.writeStream.foreachBatch(E.upsert_latest(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    got = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "out" / f"v={last}")).collect()}
    want = {r.user_id: r.e for r in base.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("e")).collect()}
    assert got == want
