"""The pool's filter and rescue on hand-made rows, the family's search, and tables written once."""

import duckdb
import pandas as pd
import pytest
from test_queries import SF, rows_of

from tallywright.plans import pools, similarity
from tallywright.sources.shared import shared

UNION = "q string, c string, channels string, conflict boolean"
POOL = "q string, c string, rank int, score double, q_price double, c_price double, q_code string, c_code string, q_uom int, c_uom int, q_qty double, c_qty double, q_text string, c_text string"


def test_filter_modes(spark):
    big = [("big", f"c{i}", "I", i < 4) for i in range(10)] + [("big", "a", "AI", True), ("big", "b", "BJ", True)]
    few = [("few", f"c{i}", "J", True) for i in range(8)] + [("few", f"d{i}", "J", False) for i in range(4)]
    small = [("small", f"c{i}", "J", True) for i in range(10)]
    union = spark.createDataFrame(big + few + small, UNION)

    def kept(mode):
        return {r.q: r.n for r in pools.filtered(union, mode).groupBy("q").count().withColumnRenamed("count", "n").collect()}

    # pools of ten rows are not filtered, nor those of which fewer than five would survive
    assert kept("NONE") == {"big": 12, "few": 12, "small": 10}
    assert kept("CONSERVATIVE") == {"big": 8, "few": 12, "small": 10}
    assert kept("MODERATE") == {"big": 7, "few": 12, "small": 10}
    assert kept("STRICT") == {"big": 6, "few": 12, "small": 10}


def pool_rows(q, n, price, late):
    """n candidates that miss the price of 100; ``late``: columns of the rows past rank 30."""
    rows = []
    for rank in range(1, n + 1):
        row = {"q": q, "c": f"{q}{rank:02}", "rank": rank, "score": 1 - rank / 100, "q_price": 100.0, "c_price": price, "q_code": "k", "c_code": "k", "q_uom": 1, "c_uom": 1, "q_qty": 10.0, "c_qty": 10.0, "q_text": "one two", "c_text": "other"}
        rows.append(row | (late.get(rank, {}) if rank > 30 else {}))
    return rows


def test_rescue(spark):
    good = {"c_text": "Two one", "c_price": 105.0}
    rows = pool_rows("helped", 40, 500.0, {35: good, 36: good})
    rows += pool_rows("other_unit", 40, 500.0, {r: good | {"c_uom": 2} for r in range(31, 41)})
    rows += pool_rows("far", 40, 500.0, {r: good | {"c_qty": 1000.0} for r in range(31, 41)})
    rows += pool_rows("short", 12, 500.0, {})
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in POOL.split(", ")) for r in rows], POOL)
    got = {r.q: r for r in pools.rescues(frame).collect()}
    assert got["helped"].c == "helped35" and got["helped"].hit_ten == 0 and got["helped"].hit_new == 1
    # full overlap of words, and 0.05 below the score of rank 30
    assert got["helped"].rescue == pytest.approx(0.60 + 0.40 * (1 - 0.05 / 0.50), abs=1e-4)
    assert got["other_unit"].c is None and got["far"].c is None and got["short"].c is None
    assert got["short"].hit_new == got["short"].hit_ten == 0


def test_shared_tables(spark, tmp_path):
    path, made = str(tmp_path / "t"), []

    def make():
        made.append(1)
        return spark.read.parquet(path)

    spark.range(3).write.parquet(path)
    assert shared(spark, "x", [path], make).count() == 3 and shared(spark, "x", [path], make).count() == 3
    assert len(made) == 1
    spark.range(2).write.mode("append").parquet(path)
    assert shared(spark, "x", [path], make).count() == 5 and len(made) == 2


def test_search_falls_back_to_the_family(spark, tmp_path):
    """A commodity without earlier rows searches its family; a family without any has no match."""
    lines, orders, parts = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    parts = parts.head(40).copy()
    lines = lines[lines.l_partkey.isin(parts.p_partkey)].copy()
    last = lines.l_shipdate.max() - pd.Timedelta(days=30)
    for i, (brand, kind) in enumerate((("Brand#new", parts.p_type.iloc[0]), ("Brand#alone", "NO SUCH TYPE"))):
        parts.loc[parts.index[i], ["p_brand", "p_type"]] = brand, kind
        own = lines.l_partkey == parts.p_partkey.iloc[i]
        lines = lines[~own | (lines.index == lines[own].index.min())]
        lines.loc[lines.l_partkey == parts.p_partkey.iloc[i], "l_shipdate"] = last
    parts.loc[parts.index[2:8], "p_type"] = parts.p_type.iloc[0]
    parts.loc[parts.index[2], ["p_name", "p_size"]] = parts.p_name.iloc[0], parts.p_size.iloc[0]
    duck = duckdb.connect()
    for name, frame in (("lineitem", lines), ("orders", orders), ("part", parts)):
        frame.to_parquet(f"{tmp_path}/{name}.parquet", index=False, coerce_timestamps="us")
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for name in ("sim1_similarity_search", "sim2_similarity_price"):
        got = similarity.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows_of(got) == rows_of(duck.execute(similarity.ORACLES[name]).df())
    assert (got.scope == "FAMILY_FALLBACK").sum() == 1 and (got.match_type == "NO_MATCH").sum() >= 1
