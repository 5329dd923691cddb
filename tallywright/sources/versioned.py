"""Versioned tables: data folders and a manifest for each version, in any store that Spark writes to.

A change is a folder of Parquet files and one more manifest, which names every folder
of its version. A manifest is created only if it is not there, so of two writers of one
version the second fails and may try again. Every change has a batch id; one that was
committed before is not written twice, which makes retried micro-batches safe. Readers
of a version never see later changes.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("append", "upsert", "delete")


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass
class VersionedTable:
    """A table in a folder. key: its key columns, for upserts and deletes."""

    spark: SparkSession
    path: str
    key: list[str]

    # ---- manifests

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """All committed versions, oldest first."""
        store, path = self._place("manifest")
        if not store.exists(path):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in store.listStatus(path) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> list[dict]:
        """The changes of a version (the latest, if none is named), oldest first."""
        known = self.versions()
        if version is None and not known:
            return []
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"no version {version}")
        store, path = self._place(f"manifest/{version:08}.json")
        stream = store.open(path)
        try:
            return json.loads(bytes(b & 0xFF for b in self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, version: int, changes: list[dict]) -> None:
        store, path = self._place(f"manifest/{version:08}.json")
        try:
            stream = store.create(path, False)
        except Exception as failed:  # a Java exception; anything but an existing file is raised as it is
            if "AlreadyExists" in str(failed):
                raise Conflict(f"version {version} is there") from failed
            raise
        stream.write(bytearray(json.dumps(changes).encode()))
        stream.close()

    # ---- changes

    def change(self, kind: str, rows: DataFrame, batch: str) -> int:
        """Commit rows under a batch id and return the version; nothing is written if the id is known."""
        if kind not in KINDS:
            raise ValueError(f"unknown change {kind}")
        changes = self.manifest()
        for at, done in enumerate(changes, 1):
            if done["batch"] == batch:
                return at
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        entry = {"kind": kind, "batch": batch, "folder": folder, "seq": len(changes) + 1, **fingerprint(self.spark.read.parquet(f"{self.path}/{folder}"), self.key)}
        self._commit(len(changes) + 1, [*changes, entry])
        return len(changes) + 1

    def append(self, rows: DataFrame, batch: str) -> int:
        """Add rows, whatever their keys."""
        return self.change("append", rows, batch)

    def upsert(self, rows: DataFrame, batch: str) -> int:
        """Put rows in place of those of equal keys. rows: one for each key."""
        return self.change("upsert", rows, batch)

    def delete(self, keys: DataFrame, batch: str) -> int:
        """Take away the rows of these keys."""
        return self.change("delete", keys.select(*self.key), batch)

    # ---- reading

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. A row stays while no later upsert or delete has its key; null keys equal each other."""
        changes = self.manifest(version)
        held = [c for c in changes if c["kind"] != "delete"]
        if not held:
            raise ValueError("the table has no rows yet")
        seq = "__seq"
        rows = self._union([(c, self.spark.read.parquet(f"{self.path}/{c['folder']}")) for c in held], seq)
        over = [(c, self.spark.read.parquet(f"{self.path}/{c['folder']}").select(*self.key)) for c in changes if c["kind"] != "append"]
        if not over:
            return rows.drop(seq)
        last = self._union(over, seq).groupBy(*[F.col(k).alias(f"__{k}") for k in self.key]).agg(F.max(seq).alias("__last"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.key]
        return rows.join(last, same, "left").where(F.col("__last").isNull() | (F.col(seq) >= F.col("__last"))).drop(seq, "__last", *[f"__{k}" for k in self.key])

    @staticmethod
    def _union(parts: list[tuple[dict, DataFrame]], seq: str) -> DataFrame:
        tagged = [frame.withColumn(seq, F.lit(c["seq"])) for c, frame in parts]
        out = tagged[0]
        for frame in tagged[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out

    def check(self) -> None:
        """Raise ValueError where a folder does not hold the rows and keys that its manifest says."""
        for c in self.manifest():
            found = fingerprint(self.spark.read.parquet(f"{self.path}/{c['folder']}"), self.key)
            if any(found[k] != c[k] for k in found):
                raise ValueError(f"{c['folder']}: {found} instead of {({k: c[k] for k in found})}")


def fingerprint(rows: DataFrame, key: list[str]) -> dict[str, int]:
    """Number of rows, and a sum of hashes of their keys, which no order of rows changes."""
    found = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*key).cast("decimal(38,0)")), F.lit(0)).alias("keys")).first()
    return {"rows": int(found["rows"]), "keys": int(found["keys"])}


def cached(table: VersionedTable, wanted: DataFrame, make, batch: str = "cache") -> tuple[DataFrame, bool]:
    """The table if it holds exactly the wanted keys, else ``make()`` as its next version; and whether it was made anew."""
    expected = fingerprint(wanted, table.key)
    if table.versions():
        held = table.read()
        if fingerprint(held, table.key) == expected:
            return held, False
        table.delete(held.select(*table.key).distinct(), f"{batch}-drop-{len(table.versions())}")
    table.append(make(), f"{batch}-{len(table.versions())}")
    return table.read(), True
