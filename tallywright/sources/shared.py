"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, under a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(root or 'file://' + tempfile.gettempdir()).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str = "table") -> DataFrame:
    """df written to the shared folder and read back: computed once, and not again after a lost executor."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(makers: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """What each maker returns, in their order. Their jobs run at the same time: each has stages of few tasks."""
    with ThreadPoolExecutor(len(makers)) as pool:
        return [f.result() for f in [pool.submit(m) for m in makers]]


_WRITTEN: dict[tuple, str] = {}


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of every file below a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).listFiles(place, True)
    out = []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def shared(spark: SparkSession, label: str, inputs: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """make()'s rows, written once in an application for the same input files and read by every query that names them.

    inputs: paths of all tables that make() reads. A file that is added, replaced or
    removed, and a written table that is gone, lead to a new one.
    """
    key = (spark.sparkContext.applicationId, label, tuple(f for path in inputs for f in _files(spark, path)))
    if key in _WRITTEN:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{_WRITTEN[key]}/_SUCCESS")
        if place.getFileSystem(spark._jsc.sc().hadoopConfiguration()).exists(place):
            return spark.read.parquet(_WRITTEN[key])
    path = fresh_path(spark, label)
    make().write.parquet(path)
    _WRITTEN[key] = path
    return spark.read.parquet(path)
