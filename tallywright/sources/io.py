"""Readers with checked schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A CSV with a header; raises ValueError when a required column is missing."""
    header = spark.read.option("header", True).csv(path)
    missing = sorted(set(required) - set(header.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return spark.read.option("header", True).schema(schema).option("enforceSchema", False).csv(path)


def write_all(df: DataFrame, folder: str) -> None:
    """Parquet for machines, CSV for people, and a JSON line with the number of rows."""
    df.write.mode("overwrite").parquet(f"{folder}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    df.agg(F.count("*").alias("rows")).write.mode("overwrite").json(f"{folder}/summary")


def overlay(base: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """base with the cached columns of equal keys; rows without a cached one keep nulls."""
    return base.join(cached, key, "left")


def upsert(current: DataFrame, changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest row of each key by ``order`` over both tables."""
    columns = [c for c in current.columns if c != key]
    latest = F.max_by(F.struct(*columns), F.struct(*order)).alias("row")
    return current.unionByName(changes).groupBy(key).agg(latest).select(key, "row.*")
