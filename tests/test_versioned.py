"""Versioned tables: idempotent batches, earlier versions, upserts, deletes, conflicts and checks."""

import pytest

from tallywright.sources.shared import fresh_path
from tallywright.sources.versioned import Conflict, VersionedTable, cached

SCHEMA = "k int, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def held(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=str)


def test_changes(spark):
    table = VersionedTable(spark, fresh_path(spark, "t"), ["k"])
    with pytest.raises(ValueError):
        table.read()
    assert table.append(rows(spark, (1, "a"), (2, "b"), (None, "n"), (1, "again")), "b1") == 1
    assert table.append(rows(spark, (9, "never written")), "b1") == 1
    assert table.upsert(rows(spark, (1, "new"), (3, "c"), (None, "m")), "b2") == 2
    assert table.delete(rows(spark, (2, "")), "b3") == 3
    assert table.append(rows(spark, (2, "back")), "b4") == 4
    assert table.versions() == [1, 2, 3, 4]
    assert held(table, 1) == sorted([(1, "a"), (1, "again"), (2, "b"), (None, "n")], key=str)
    assert held(table, 2) == sorted([(1, "new"), (2, "b"), (3, "c"), (None, "m")], key=str)
    assert held(table, 3) == sorted([(1, "new"), (3, "c"), (None, "m")], key=str)
    assert held(table) == sorted([(1, "new"), (2, "back"), (3, "c"), (None, "m")], key=str)
    table.check()
    with pytest.raises(ValueError):
        table.read(7)
    with pytest.raises(ValueError):
        table.change("merge", rows(spark, (1, "x")), "b5")


def test_two_writers_of_one_version(spark):
    table = VersionedTable(spark, fresh_path(spark, "t"), ["k"])
    table.append(rows(spark, (1, "a")), "b1")
    with pytest.raises(Conflict):
        table._commit(1, [])
    assert held(table) == [(1, "a")]


def test_check_sees_missing_and_changed_rows(spark):
    table = VersionedTable(spark, fresh_path(spark, "t"), ["k"])
    table.append(rows(spark, (1, "a"), (2, "b")), "b1")
    folder = f"{table.path}/{table.manifest()[0]['folder']}"
    rows(spark, (1, "a"), (3, "b")).write.mode("overwrite").parquet(folder)
    with pytest.raises(ValueError):
        table.check()


def test_cache(spark):
    table = VersionedTable(spark, fresh_path(spark, "t"), ["k"])
    made = []

    def make(*pairs):
        return lambda: made.append(pairs) or rows(spark, *pairs)

    assert cached(table, rows(spark, (1, ""), (2, "")), make((1, "a"), (2, "b")))[1]
    assert not cached(table, rows(spark, (2, "other"), (1, "")), make((7, "z")))[1]
    found, anew = cached(table, rows(spark, (1, ""), (3, "")), make((1, "c"), (3, "d")))
    assert anew and sorted(map(tuple, found.collect())) == [(1, "c"), (3, "d")] and len(made) == 2
