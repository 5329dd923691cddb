"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points on a ring of 2**32 positions. A document
falls into the arc that ends at the next point clockwise of its key's hash. Shards
are bounded: shard j takes floor(n / shards) rows, one more for the first n mod
shards. Keys that overflow a full shard continue clockwise to the next point whose
shard has room. Only the counts of the arcs (shards * virtual_nodes numbers, fixed
by parameters) reach the driver, where the overflow is planned; rows find their
shard by arc and rank within the arc.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import power_of_two, small_table

RING_BITS = 32
SLICE_BITS = 20


def ring_arcs(spark, shards: int, virtual_nodes: int) -> list[tuple[int, int, int, int]]:
    """(arc, first position, last position, shard) of each arc in ring order; the
    arc over the ring's origin comes as two rows with one arc number."""
    points = spark.range(shards * virtual_nodes).select(
        F.expr(f"cast(id div {virtual_nodes} as int)").alias("shard"),
        F.pmod(F.xxhash64(F.lit("ring"), F.col("id")), F.lit(1 << RING_BITS)).alias("at"),  # the same points whatever the number of shards
    )
    owned = {}
    for shard, at in sorted((r.shard, r.at) for r in points.collect()):
        owned.setdefault(at, shard)  # two points in one place: the lower shard
    ends = sorted(owned)
    arcs, low = [], 0
    for number, at in enumerate(ends):
        arcs.append((number, low, at, owned[at]))
        low = at + 1
    if low < 1 << RING_BITS:
        arcs.append((0, low, (1 << RING_BITS) - 1, owned[ends[0]]))
    return arcs


def plan_overflow(owners: list[int], counts: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, low rank, high rank, shard, first slot) from the counts of the arcs.

    In step s the rows that an arc still holds try the shard of the s-th point
    clockwise; the lowest ranks are placed first.
    """
    load, done, plan = [0] * len(capacity), [0] * len(counts), []
    pending = [a for a, n in enumerate(counts) if n]
    for step in range(len(owners)):
        for arc in pending:
            shard = owners[(arc + step) % len(owners)]
            take = min(counts[arc] - done[arc], capacity[shard] - load[shard])
            if take > 0:
                plan.append((arc, done[arc], done[arc] + take, shard, load[shard]))
                done[arc] += take
                load[shard] += take
        pending = [a for a in pending if done[a] < counts[a]]
    return plan


def assign_shards(docs: DataFrame, shards: int = 16, virtual_nodes: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every row into a shard; row counts of shards differ by one at most.

    Returns key, size (UTF-8 bytes plus 1), text_crc32, shard, slot (gapless from 0
    in each shard). A null text has 0 bytes and crc 0. Null keys share one ring
    position; rows with equal keys are ranked by crc and size, and rows equal in
    all of these are interchangeable. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    arcs = ring_arcs(spark, shards, virtual_nodes)
    owners = [shard for _, _, _, shard in arcs][: max(arc for arc, *_ in arcs) + 1]
    slices = [
        (part, arc, low, high)
        for arc, low, high, _ in arcs
        for part in range(low >> SLICE_BITS, (high >> SLICE_BITS) + 1)
    ]
    arc_of = F.broadcast(small_table(spark, slices, "part long, arc int, low long, high long"))  # fixed by the parameters
    placed = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << RING_BITS))

    def with_arc(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("part", F.shiftright("at", SLICE_BITS))
            .join(arc_of, "part")
            .where(F.col("at").between(F.col("low"), F.col("high")))
            .drop("part", "low", "high")
        )

    by_arc = with_arc(docs.select(placed.alias("at"))).groupBy("arc").count().collect()
    counts = [0] * len(owners)
    for row in by_arc:
        counts[row["arc"]] = row["count"]
    total = sum(counts)
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    plan = plan_overflow(owners, counts, capacity)
    if not plan:
        plan = [(0, 0, 0, 0, 0)]
    plan_table = F.broadcast(small_table(spark, plan, "arc int, low_rank long, high_rank long, shard int, first_slot long"))

    # ranks within an arc: rows are numbered in small cells, cells get offsets
    cells = power_of_two(total / 2000, 256, 1 << 20)
    cell = F.shiftright("at", RING_BITS - (cells.bit_length() - 1)).alias("cell")
    rows = with_arc(
        docs.select(
            F.col(key),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole.cast("binary")).alias("text_crc32"),
            placed.alias("at"),
        )
    ).select("*", cell)
    ordered = Window.partitionBy("arc", "cell").orderBy("at", key, "text_crc32", "size")
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_arc(docs.select(placed.alias("at")))
        .select("arc", cell)
        .groupBy("arc", "cell")
        .count()
        .select("arc", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    return (
        rows.withColumn("nth", F.row_number().over(ordered) - 1)
        .join(offsets, ["arc", "cell"])
        .withColumn("rank", F.col("offset") + F.col("nth"))
        .join(plan_table, "arc")
        .where((F.col("rank") >= F.col("low_rank")) & (F.col("rank") < F.col("high_rank")))
        .select(key, "size", "text_crc32", "shard", (F.col("first_slot") + F.col("rank") - F.col("low_rank")).alias("slot"))
    )
