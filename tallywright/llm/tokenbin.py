"""Token files with directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of
``chunk_bits`` bits, lowest first. Level 0 has a chunk for every id; level l + 1 has
one for each id that does not end at level l. A bitmap per level marks the ids that
continue, and a rank directory counts its set bits before each block of 512. The
chunk of the i-th id at the next level stands at rank(i) there, so that any id is
read by at most ``levels`` probes without decoding what stands before it.

Segments are rows of a Parquet table in the shared folder: (part, part_start,
n_ids, docs, payload). The payload is the binary file format below; Parquet is the
container because every store that Spark writes to can hold it.

Payload: b"DAC1", then u32 little-endian: chunk_bits, n_ids, n_levels; per level
u32 n_entries, bitmap bytes, rank directory u32[], chunk bytes (8 or 16 bits each).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import table_path
from tallywright.llm.tokens import encoder, slices

MAGIC = b"DAC1"
BLOCK = 512
#: Bytes of text that are encoded together, about, or one text.
SLICE_BYTES = 4_000_000
#: Ids after which a segment is closed at the end of a document.
SEGMENT_IDS = 1 << 18
#: Bytes of text that a partition of the writer holds, about.
PARTITION_BYTES = 64 << 20


def encode_segment(ids: np.ndarray, chunk_bits: int = 8) -> bytes:
    """The payload of a segment. ids: unsigned 32-bit."""
    kind = {8: "<u1", 16: "<u2"}[chunk_bits]
    mask = (1 << chunk_bits) - 1
    rest, levels = ids.astype("<u4"), []
    while len(rest):
        chunks = (rest & mask).astype(kind)
        rest = rest >> chunk_bits
        goes_on = rest > 0
        bits = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(goes_on.astype(np.int64), np.arange(0, len(goes_on), BLOCK))
        directory = np.concatenate(([0], np.cumsum(per_block)[:-1])).astype("<u4")
        levels.append(struct.pack("<I", len(chunks)) + bits.tobytes() + directory.tobytes() + chunks.tobytes())
        rest = rest[goes_on]
    return MAGIC + struct.pack("<III", chunk_bits, len(ids), len(levels)) + b"".join(levels)


class Segment:
    """Reads a payload: all ids, a slice of them, or one by its place."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        self.chunk_bits, self.n_ids, n_levels = struct.unpack_from("<III", payload, 4)
        kind = {8: "<u1", 16: "<u2"}[self.chunk_bits]
        at, self.levels = 16, []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<I", payload, at)
            bits = np.frombuffer(payload, np.uint8, -(-n // 8), at + 4)
            directory = np.frombuffer(payload, "<u4", -(-n // BLOCK), at + 4 + len(bits))
            at += 4 + len(bits) + directory.nbytes
            chunks = np.frombuffer(payload, kind, n, at)
            at += chunks.nbytes
            self.levels.append((bits, directory, chunks))

    def _rank(self, level: int, i: int) -> int:
        bits, directory, _ = self.levels[level]
        block = i // BLOCK
        start = block * BLOCK // 8
        last = i // 8
        whole = int(np.unpackbits(bits[start:last]).sum())
        part = int(bits[last] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0
        return int(directory[block]) + whole + part

    def __getitem__(self, i: int) -> int:
        """The id at place i, by one probe for each of its chunks."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (bits, _, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + self.chunk_bits
        return value

    def all(self) -> np.ndarray:
        """All ids."""
        out = None
        for bits, _, chunks in reversed(self.levels):
            values = chunks.astype("<u4")
            if out is not None:
                goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                values[goes_on] |= out << self.chunk_bits
            out = values
        return np.zeros(0, "<u4") if out is None else out


def _write_partition(tokenizer_path: str, end_id: int, chunk_bits: int):
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path, keeps_space=True)
        held: list[tuple[int, bytes]] = []
        size = written = 0
        part = None

        def close() -> pa.RecordBatch:
            whole = np.frombuffer(b"".join(x for _, x in held), "<u4")
            listed = [{"doc_id": d, "n_tokens": len(x) // 4} for d, x in held]
            values = (part, written, len(whole), listed, encode_segment(whole, chunk_bits))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _ARROW, strict=True)], [n for n, _ in _ARROW])

        for batch in batches:
            doc_ids = iter(batch.column("doc_id").to_pylist())
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for texts in slices(batch.column("text"), SLICE_BYTES):
                for x in ids.encode(texts):
                    held.append((next(doc_ids), x + end))
                    size += len(x) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield close()
                        written, held, size = written + size, [], 0
        if held:
            yield close()

    return run


_ARROW = (("part", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())]))), ("payload", pa.binary()))
SCHEMA = "part int, part_start long, n_ids long, docs array<struct<doc_id: long, n_tokens: long>>, payload binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, chunk_bits: int = 8, partitions: int | None = None) -> str:
    """Encode all documents in ascending doc_id order; return the table's path.

    Null texts are empty and give the end id alone. Null doc_ids come first; rows
    with equal doc_ids stand in the order of a hash of their text. Further columns
    are ignored, whatever their names. An empty table gives an empty file set.
    Without ``partitions`` their number follows the bytes of text.
    """
    spark = docs.sparkSession
    if partitions is None:
        held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // PARTITION_BYTES))
    path = table_path(spark, "token-files")
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row_hash"))
        .repartitionByRange(partitions, "doc_id", "row_hash")
        .sortWithinPartitions("doc_id", "row_hash")
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")
        .mapInArrow(_write_partition(tokenizer_path, end_id, chunk_bits), SCHEMA)
        .write.parquet(path)
    )
    return path


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for docs, start, payload in zip(*(batch.column(c).to_pylist() for c in ("docs", "start", "payload")), strict=True):
            ids = memoryview(Segment(payload).all().tobytes())
            rows, at = [], 0
            for doc in docs:
                n = doc["n_tokens"]
                rows.append((doc["doc_id"], start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files.

    A segment's place is the ids of the partitions before its own, plus those
    before it in its partition, which the writer noted. Only one sum for each
    partition of the writer is gathered.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before"))
    return (
        files.join(F.broadcast(sums), "part")  # a row for each of the writer's partitions
        .select("docs", (F.col("before") + F.col("part_start")).alias("start"), "payload")
        .mapInArrow(_read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )
