"""Concentration of orders over commodities, with the lines of an order in one task of bounded size."""

import duckdb
import pandas as pd
from test_queries import SF, rows_of

from tallywright.plans import store


def test_hhi_of_odd_orders(spark, tmp_path, monkeypatch):
    """Missing, negative and vanishing quantities and keys that repeat, as in SQL; orders are dealt by number of lines and no window sorts them."""
    line, orders, part = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    line = line.head(2000).copy()
    line.loc[line.index % 7 == 0, "l_quantity"] = None
    line.loc[line.index % 11 == 0, "l_quantity"] *= -1
    line.loc[line.l_orderkey % 13 == 0, "l_quantity"] = 0.0
    line.loc[line.l_orderkey % 17 == 0, "l_quantity"] = None
    for name, frame in (("lineitem", line), ("orders", pd.concat([orders, orders.head(9)])), ("part", pd.concat([part, part.head(9)]))):
        frame.to_parquet(f"{tmp_path}/{name}.parquet", index=False, coerce_timestamps="us")
        duckdb.execute(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet'")
    monkeypatch.setattr(store, "LINES_OF_A_TASK", 100)
    got = store.QUERIES["agg3_hhi"](spark, str(tmp_path))
    assert rows_of(got.toPandas()) == rows_of(duckdb.sql(store.ORACLES["agg3_hhi"]).df())
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Window" not in plan
    assert store.order_lines(spark, str(tmp_path)).rdd.getNumPartitions() >= 20
