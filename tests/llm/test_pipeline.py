"""Each stage of the pipeline against a brute-force version of its decision."""

from pathlib import Path

import corpus_pipeline as P
from pyspark.sql import functions as F

from tallywright.llm import minhash, quality
from tallywright.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]

    kept = materialize(P.quality(spark, docs, SF), "t")
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good

    unique = materialize(P.near_dedup(spark, kept, SF), "t")
    groups = minhash.near_duplicates(kept).groupBy("component_id").count().count()
    assert unique.columns == columns and unique.count() == groups

    clean = materialize(P.decontamination(spark, unique, SF), "t")
    assert clean.columns == columns and 0 < clean.count() <= unique.count()

    safe = materialize(P.secrets(spark, clean, SF), "t")
    assert safe.columns == columns and safe.count() == clean.count()
    assert safe.where(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    assert safe.where(F.col("n_chars") != F.char_length("text")).count() == 0

    packed = P.packing(spark, safe, SF)
    assert packed.select("doc_id").distinct().count() == safe.count()
    assert Path(P.__file__).name == "corpus_pipeline.py"


def test_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = materialize(stage(spark, docs, SF), "t")
        assert out.count() == 0
        docs = out if "text" in out.columns else docs
