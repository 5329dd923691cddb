"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what goes on: documents for all
but the last, which returns the packed pieces. Stages are written as Parquet and
read again, so a lost executor costs at most the stage it worked on.

In every stage a null text counts as empty and a null doc_id is an id like others;
rows that share a doc_id are judged each by its own text; further columns of
documents pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import discard, materialize, table
from tallywright.llm.decontaminate import decontaminate
from tallywright.llm.minhash import near_duplicates
from tallywright.llm.packing import pack_documents
from tallywright.llm.quality import keep_good
from tallywright.llm.secrets import scan_secrets
from tallywright.llm.tokens import vocabulary


def _matched(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose (doc_id, hash of text) are, or are not, in keys (doc_id, row_hash)."""
    k = keys.select(F.col("doc_id").alias("key_id"), F.col("row_hash").alias("key_hash")).distinct()
    return docs.join(k, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.xxhash64("text") == F.col("key_hash")), how)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, hash of text) are in gone (doc_id, row_hash)."""
    return _matched(docs, gone, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality discriminant accepts. Equal texts share their fate; without labels of both kinds all stay."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of its smallest doc_id.

    Null ids come after all others; of rows with one doc_id that with the smallest
    hash of its text stays, of rows that repeat both any one. Documents without
    words are in no group: all their rows stay.
    """
    found = materialize(near_duplicates(docs), "near")
    left = _without(docs, found.where("not kept"))
    repeated = found.where("kept and n_shingles > 0").groupBy("doc_id", "row_hash").count().where("count > 1")
    if not repeated.limit(1).count():
        return left
    one_each = _matched(left, repeated, "left_semi").withColumn("near_dedup_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "near_dedup_hash"])
    return _without(left, repeated).unionByName(one_each.drop("near_dedup_hash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items; all, where there are no items."""
    return _without(docs, decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted anew; a null text stays null."""
    found = scan_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"), mark="[SECRET]")
    replaced = {"text": F.col("redacted"), "n_chars": F.when(F.col("redacted").isNotNull(), F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))}
    return found.withColumns({k: v for k, v in replaced.items() if k == "text" or k in docs.columns}).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens, repeated rows each on their own."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

#: SQL cannot express the classifier, the token test or the tokenizer; tests/llm checks the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
