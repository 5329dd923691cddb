"""Bulk-synchronous best-fit packing of tokenized documents into sequences.

Lengths and gaps both lie on the token axis 1..capacity. Pieces of one length, and
sequences of one gap, are runs: (length, count) and (gap, first sequence, count).
Both kinds of runs are dealt by size into ranges of the axis, and every superstep is
one Spark job over them:

* a run of pieces goes to the range that holds its successor, the smallest gap that
  takes it;
* each range is swept by itself from the longest piece to the shortest; pieces that
  compete for one run of gaps take its sequences in the order of their ranks;
* what is left of the gaps, and the pieces that found none, are written and dealt
  again.

When no piece has a successor, the longest pieces open new sequences, fewer than the
remaining tokens need at least, and the supersteps go on. The driver reads one row of
sums for each range and superstep. The sweeps write placement rules by length and
rank; pieces get their rank and their rule on Spark, so no row passes the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import materialize, power_of_two, table_path
from tallywright.llm.tokens import encoder, slices

#: Width of a range of the token axis, in tokens.
RANGE = 2048
#: Share of the least possible number of sequences that is opened at once.
OPENED = 0.97
#: A run of pieces or gaps (n, first: rank or sequence, size), or a rule: pieces of a
#: length with rank r from first to below first + n go to sequence at + (r - first) // per,
#: at offset base + (r - first) % per * length.
STATE = "kind string, size int, first long, n long, per long, at long, base int"
_COLUMNS = [part.split()[0] for part in STATE.split(", ")]


def sweep_range(runs: pd.DataFrame, capacity: int, low: int) -> pd.DataFrame:
    """Best fit of the runs of one range: rules, and the runs that are left.

    low: the smallest size of the range; smaller gaps are left for their own range.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    out: list[tuple] = []

    def keep(gap: int, first: int, n: int) -> None:
        if not gap or not n:
            return
        if gap < low:
            out.append(("gap", gap, first, n, 0, 0, 0))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((first, n))

    for run in runs[runs["kind"] == "gap"].sort_values(["size", "first"]).itertuples():
        keep(run.size, run.first, run.n)
    for run in runs[runs["kind"] == "item"].sort_values(["size", "first"], ascending=[False, True]).itertuples():
        length, rank, n = run.size, run.first, run.n
        while n:
            at = bisect_left(order, length)
            if at == len(order):
                out.append(("item", length, rank, n, 0, 0, 0))
                break
            gap = order[at]
            first, held = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per = gap // length
            used = min(held, -(-n // per))
            take = min(used * per, n)
            out.append(("rule", length, rank, take, per, first, capacity - gap))
            full, part = divmod(take, per)
            keep(gap - per * length, first, full)
            keep(gap - part * length, first + full, 1 if part else 0)
            keep(gap, first + used, held - used)
            rank, n = rank + take, n - take
    out += [("gap", gap, first, n, 0, 0, 0) for gap, runs_of in gaps.items() for first, n in runs_of]
    return pd.DataFrame(out, columns=_COLUMNS)


def _open(state: DataFrame, capacity: int, sequences: int, wanted: int) -> DataFrame:
    """The state after the longest pieces have opened new sequences from number ``sequences`` on.

    Pieces of more than half the capacity open one each; of the others, as many
    as ``wanted`` leaves. The windows run over one row for each length.
    """
    items = state.where("kind = 'item'")
    longest = Window.orderBy(F.desc("size"), "first").rowsBetween(Window.unboundedPreceding, -1)
    per = F.floor(F.lit(capacity) / F.col("size")).cast("long")
    need = F.ceil(F.col("n") / per).cast("long")
    earlier = F.coalesce(F.sum("need").over(longest), F.lit(0))
    grant = F.when(F.col("per") == 1, F.col("need")).otherwise(F.greatest(F.lit(0), F.least(F.col("need"), F.lit(wanted) - F.col("earlier"))))
    opened = (
        items.select("size", "first", "n", per.alias("per"), need.alias("need"))
        .withColumn("earlier", earlier)
        .withColumn("grant", grant)
        .withColumn("at", F.lit(sequences) + F.coalesce(F.sum("grant").over(longest), F.lit(0)))
        .withColumn("take", F.least("n", F.col("grant") * F.col("per")))
    )
    full, part = F.expr("take div per"), F.expr("take % per")

    def row(kind: str, size, first, n, per=F.lit(0), at=F.lit(0)):
        values = (F.lit(kind), size.cast("int"), first.cast("long"), n.cast("long"), per.cast("long"), at.cast("long"), F.lit(0))
        return F.struct(*[v.alias(c) for v, c in zip(values, _COLUMNS, strict=True)])

    made = F.array(
        row("rule", F.col("size"), F.col("first"), F.col("take"), F.col("per"), F.col("at")),
        row("gap", F.lit(capacity) - F.col("per") * F.col("size"), F.col("at"), full),
        row("gap", F.lit(capacity) - part * F.col("size"), F.col("at") + full, F.when(part > 0, 1).otherwise(0)),
        row("item", F.col("size"), F.col("first") + F.col("take"), F.col("n") - F.col("take")),
    )
    return opened.select(F.inline(made)).where("n > 0 and size > 0").union(state.where("kind = 'gap'").select(*_COLUMNS))


def placement_rules(spark: SparkSession, lengths: DataFrame, capacity: int) -> DataFrame:
    """Rules (STATE) that place ``lengths`` (length, count) into sequences of ``capacity`` tokens."""
    folder = table_path(spark, "packing")
    state = lengths.select(F.lit("item").alias("kind"), F.col("length").cast("int").alias("size"), F.lit(0).cast("long").alias("first"), F.col("count").alias("n"),
                           *[F.lit(0).cast(t).alias(c) for c, t in (("per", "long"), ("at", "long"), ("base", "int"))])
    sequences = step = 0
    place = F.floor((F.col("size") - 1) / RANGE).cast("int")

    def written(df: DataFrame) -> tuple[DataFrame, list]:
        """The next state, and the sums of its ranges."""
        nonlocal step
        path, step = f"{folder}/step={step}", step + 1
        df.write.parquet(path)
        whole = spark.read.schema(STATE).parquet(path)
        sums = whole.groupBy("kind", place.alias("place")).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("tokens"), F.max("size").alias("top"), F.min("size").alias("low"),
            F.max(F.col("at") + F.ceil(F.col("n") / F.greatest("per", F.lit(1)))).alias("end"),
        )
        return whole.where("kind <> 'rule'"), sums.collect()

    state, sums = written(state)
    while items := [s for s in sums if s["kind"] == "item"]:
        tops = sorted((s["place"], s["top"]) for s in sums if s["kind"] == "gap")
        if max((top for _, top in tops), default=0) < min(s["low"] for s in items):
            least = -(-sum(s["tokens"] for s in items) // capacity)
            state, sums = written(_open(state, capacity, sequences, max(1, int(least * OPENED))))
            sequences = max(s["end"] for s in sums if s["kind"] == "rule")
            continue
        target = F.lit(-1)  # pieces without a successor wait
        for at, top in reversed(tops):
            target = F.when((F.col("size") <= top), F.lit(at)).otherwise(target)
        target = F.when(F.col("kind") == "gap", place).otherwise(target)

        def sweep(key: tuple, runs: pd.DataFrame) -> pd.DataFrame:
            return sweep_range(runs, capacity, int(key[0]) * RANGE + 1)

        dealt = state.withColumn("target", target)
        moved = dealt.where("target >= 0").groupBy("target").applyInPandas(sweep, STATE)
        state, sums = written(moved.union(dealt.where("target < 0").drop("target")))
    return spark.read.schema(STATE).parquet(*[f"{folder}/step={k}" for k in range(step)]).where("kind = 'rule'")


def _pieces(tokenizer_path: str, end_id: int, capacity: int, keeps_space: bool):
    end = np.asarray([end_id], "<u4").tobytes()
    names = ["doc_id", "row_hash", "nth", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer_path, keeps_space)
        nth, step = 0, 4 * capacity
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                rows = []
                keys = zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), batch.column("row_hash").slice(at, len(texts)).to_pylist(), strict=True)
                for (doc_id, row_hash), x in zip(keys, ids.encode(texts), strict=True):
                    x = memoryview(x + end)
                    rows += [(doc_id, row_hash, nth, k, k * capacity, len(x[k * step : (k + 1) * step]) // 4, zlib.crc32(x[k * step : (k + 1) * step])) for k in range(-(-len(x) // step))]
                    nth += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                at += len(texts)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keeps_space: bool = False) -> DataFrame:
    """Pack all documents; one row per piece.

    A document is its ids and the end id. Documents of more than ``capacity`` ids
    are cut into pieces of that length, the last may be shorter; no other is cut.
    Null and empty texts are the end id alone. Rows with null or equal doc_ids are
    packed as documents of their own, repeated rows too. Further columns are
    ignored, whatever their names. An empty table gives an empty result.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    pieces = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text").mapInArrow(
            _pieces(tokenizer_path, end_id, capacity, keeps_space),
            "doc_id long, row_hash long, nth long, piece int, start long, length int, ids_crc32 long",
        ),
        "pieces",
    )
    lengths = materialize(pieces.groupBy("length").count(), "lengths")  # at most ``capacity`` rows
    rules = placement_rules(spark, lengths, capacity)

    # ranks within a length: rows are ranked in small cells, sums of cells give offsets
    total = lengths.agg(F.sum("count")).first()[0] or 0
    cells = power_of_two(total / 2000, 64, 1 << 16)
    cell = F.pmod(F.xxhash64("doc_id", "row_hash", "piece", "nth"), F.lit(cells)).alias("cell")
    ordered = Window.partitionBy("length", "cell").orderBy("doc_id", "row_hash", "piece", "nth")
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("length", cell).groupBy("length", "cell").agg(F.count("*").alias("held")).withColumn("earlier", F.coalesce(F.sum("held").over(before), F.lit(0)))
    r = rules.select(F.col("size").alias("length"), F.struct("first", "n", "per", "at", "base").alias("rule"))
    meets = (F.col("rule.first") < F.col("earlier") + F.col("held")) & (F.col("rule.first") + F.col("rule.n") > F.col("earlier"))
    ruled = offsets.join(r, "length").where(meets).groupBy("length", "cell", "earlier").agg(F.collect_list("rule").alias("rules"))

    mine = F.filter("rules", lambda x: (x["first"] <= F.col("rank")) & (F.col("rank") < x["first"] + x["n"]))[0]
    return (
        pieces.select("*", cell)
        .withColumn("within", F.row_number().over(ordered) - 1)
        .join(ruled, ["length", "cell"])
        .withColumn("rank", F.col("earlier") + F.col("within"))
        .withColumn("rule", mine)
        .select(
            "doc_id",
            "piece",
            "start",
            F.col("length").cast("long").alias("length"),
            "ids_crc32",
            (F.col("rule.at") + F.expr("(rank - rule.first) div rule.per")).alias("sequence_id"),
            (F.col("rule.base") + (F.col("rank") - F.col("rule.first")) % F.col("rule.per") * F.col("length")).cast("long").alias("offset"),
        )
    )
