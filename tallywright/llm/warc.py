"""WARC archives of pages, with revisits resolved by payload digest.

Only headers (id, digest, length) are shuffled by digest; the smallest page_id of
each digest becomes the response and the others revisit it. Payloads meet the
decisions by page_id, and every record gets a fresh header. Archives are gzipped
WARC 1.1 files written by Spark, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import table_path

CRLF = "\r\n"
#: Payloads of fewer bytes are stored as they are; a revisit record would be larger.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of every row; a null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))


def revisits(heads: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_digest, refers_to of the records that revisit another."""
    long = heads.where(F.col("payload_bytes") >= least_bytes)
    originals = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(originals, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends in the value are escaped."""
    clean = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES, per_file: int = 50_000) -> str:
    """Write a WARC record per row of pages (page_id, url, html); return the folder.

    Of rows with equal payloads of at least ``least_bytes`` bytes the smallest
    page_id is the response; rows that repeat it with the same page_id are responses
    too. Null page_ids revisit an equal payload with an id, else they are responses.
    Null urls have no target line. An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    decided = revisits(headers(pages), least_bytes).select(F.col("page_id").alias("id"), F.col("payload_digest").alias("digest"), "refers_to")
    rows = base.join(decided, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF + CRLF)
    )
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        F.when(again, F.lit(f"WARC-Type: revisit{CRLF}WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit(f"WARC-Type: response{CRLF}")),
        _field("WARC-Record-ID", _record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _field("WARC-Refers-To", _record_id(F.col("refers_to"))),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    return path


_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _page(value: str | None) -> int | None:
    found = _PAGE.fullmatch(value or "")
    return int(found[1]) if found else None


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload bytes) of each record.

    Records are told apart by their Content-Length, so payloads may hold anything.
    """
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if fields["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not have its digest")
        yield (_page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), payload)


def _read(with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                    for *head, payload in parse_archive(stream):
                        kept = with_payload and head[4] == "response"
                        rows.append((*head, payload.decode("utf-8") if kept else None))
                        held += 200 + (len(payload) if kept else 0)
                        if held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in a folder; payloads of responses if wanted, else null."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read(with_payload), SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the payload of each revisit taken from the response it refers to.

    Revisits whose response is missing keep a null payload.
    """
    found = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest"), F.col("payload").alias("original")).dropDuplicates(["refers_to", "payload_digest"])
    again = records.where("record_type = 'revisit'").join(found, ["refers_to", "payload_digest"], "left").withColumn("payload", F.col("original"))
    return records.where("record_type <> 'revisit'").unionByName(again.select(records.columns))
