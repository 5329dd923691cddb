"""The corpus operators as queries over the input tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallywright.llm.common import table
from tallywright.llm.decontaminate import decontaminate
from tallywright.llm.html_crf import extract_main_text
from tallywright.llm.merkle import verify, write_manifest
from tallywright.llm.minhash import near_duplicates
from tallywright.llm.oracles import ORACLES
from tallywright.llm.packing import pack_documents
from tallywright.llm.periodic import periodic_runs
from tallywright.llm.quality import score_quality
from tallywright.llm.secrets import scan_secrets
from tallywright.llm.sharding import assign_shards
from tallywright.llm.spotsigs import fingerprint_edits
from tallywright.llm.tokenbin import read_token_files, write_token_files
from tallywright.llm.tokens import vocabulary
from tallywright.llm.toxicity import score_toxicity
from tallywright.llm.warc import read_archives, write_archives


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records with revisits, read back from the archives."""
    archives = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each document by the windows of 13 words of benchmark items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles have a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("row_hash")


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and their likeness."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op5_crf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: the fixed patterns, and strings of few characters per token."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"))


def op7_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most."""
    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_hash")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back: place, length and checksum of each document."""
    return read_token_files(spark, write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document under the root of all, and what the tampered ones fold to."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verify(write_manifest(table(spark, sf_dir, "documents"), tampered))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, and its text without what they repeat."""
    return periodic_runs(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    """All queries of this subpackage."""
    return {
        "op1_warc": op1_warc,
        "op2_winnowing": op2_winnowing,
        "op3_minhash": op3_minhash,
        "op4_spotsigs": op4_spotsigs,
        "op5_crf_text": op5_crf_text,
        "op6_secrets": op6_secrets,
        "op7_ring_shards": op7_ring_shards,
        "op8_best_fit": op8_best_fit,
        "op9_quality": op9_quality,
        "op10_token_files": op10_token_files,
        "op11_merkle": op11_merkle,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_toxicity": op13_toxicity,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """DuckDB SQL by query."""
    found = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
