"""Helpers shared by the corpus operators."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table whose rows have a fixed width may be broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset and Spark
    runs in one process, as in tests, a temporary folder is set as the checkpoint
    folder; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tallywright-"))
    return context.getCheckpointDir().get().rstrip("/")


def table_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage, so later stages survive lost executors without
    recomputing what stands before.
    """
    path = table_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    for held in tables:
        spark = held.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(held.written_to)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


_worker: dict[tuple, object] = {}


def worker_model(key: tuple | None, make=None):
    """The one large model that a Python worker keeps between tasks.

    Workers outlive the stage that started them. Asking for another model drops
    the one that is kept; a key of None drops it and keeps none.
    """
    if key is None or key not in _worker:
        _worker.clear()
        if key is None:
            return None
        _worker[key] = make()
    return _worker[key]


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table from a short list of tuples whose length the caller has bounded."""
    names = [field.split()[0] for field in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{', '.join(f'{p.split()[0]}: {p.split()[1]}' for p in schema.split(','))}>>")
    return spark.range(1).select(F.inline(parsed))


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the cheaper built-in."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, lower))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def power_of_two(least: float, low: int, high: int) -> int:
    """The smallest power of two of at least ``least`` within [low, high]."""
    n = low
    while n < least and n < high:
        n *= 2
    return n
