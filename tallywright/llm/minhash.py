"""Near-duplicates by one-permutation MinHash.

A document's set is hashed once; the hash's low bits choose one of 128 bins and the
smallest hash of each bin is kept. Empty bins borrow from a full one by optimal
densification: bin i tries bins f(i, 1), f(i, 2), ... and takes the first full one.
Bands of bins make bucket keys. Each bucket gives a star of candidate edges, from
its smallest id to each other member, so that a bucket of n members has n - 1 edges.
Candidates are confirmed on full sets.

Documents with equal sets are one node from the start; only nodes are put into
buckets. A star misses the link of two members that are both unlike its centre, so
links between components that still meet in a bucket are looked for afterwards,
among those members only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import ascii_lower, discard, materialize, worker_model
from tallywright.llm.components import connected_components

WHITE = r"[\x20\x09-\x0D]+"
BINS = 128
#: Orders of the bins that bands are cut from.
PERMUTATIONS = 2
#: Chance that a pair at the threshold shares no bucket, if bands were independent. Both
#: orders cut the same minima and small sets fill few bins, so the rate is higher: the
#: tests measure it by the size of the sets and hold it below 3 in 10,000.
MISS = 1e-6
ATTEMPTS = 4096
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def with_shingles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles: hashes of the distinct runs of ``width`` words; with fewer
    words the whole sequence is one; without words none."""
    words = F.filter(F.split(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), WHITE), lambda w: w != "")
    hashed = docs.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("h"))

    def run(h: Column, i: Column) -> Column:
        return F.xxhash64(h, *[F.get(F.col("h"), i + j) for j in range(1, width)])

    starts = F.slice("h", F.lit(1), F.greatest(F.size("h") - (width - 1), F.least(F.size("h"), F.lit(1))))
    return hashed.select("doc_id", F.array_distinct(F.transform(starts, run)).alias("shingles"))


def band_size(similarity: float) -> int:
    """The most bins a band can have so that independent bands miss pairs at the threshold with a chance of MISS at most."""
    for size in range(12, 1, -1):
        if (1 - similarity**size) ** (BINS // size * PERMUTATIONS) <= MISS:
            return size
    return 1


@cache
def _tries() -> np.ndarray:
    """Bins that an empty bin tries, by attempt; fixed by a seed."""
    return np.random.default_rng(20240229).integers(0, BINS, (ATTEMPTS, BINS))


@cache
def _bands(size: int) -> np.ndarray:
    """The bins of each band; fixed by a seed."""
    rng = np.random.default_rng(size)
    return np.concatenate([rng.permutation(BINS)[: BINS // size * size].reshape(-1, size) for _ in range(PERMUTATIONS)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sketch(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(documents, bins) densified minima of each document's hashes. Rows of empty sets hold the empty mark."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    mixed = _mix(flat.view(np.uint64))
    out = np.full(len(lengths) * BINS, _EMPTY)
    np.minimum.at(out, owner * BINS + (mixed & np.uint64(BINS - 1)).astype(np.int64), mixed >> np.uint64(7))
    out = out.reshape(-1, BINS)
    full = out != _EMPTY
    rows, cols = np.nonzero(~full & full.any(axis=1, keepdims=True))
    tries = _tries()
    for attempt in range(ATTEMPTS):
        if not len(rows):
            break
        source = tries[attempt][cols]
        found = full[rows, source]
        out[rows[found], cols[found]] = out[rows[found], source[found]]
        rows, cols = rows[~found], cols[~found]
    for row, col in zip(rows, cols, strict=True):  # practically never: the next full bin
        at = np.nonzero(full[row])[0]
        out[row, col] = out[row, at[np.searchsorted(at, col) % len(at)]]
    return out


def band_keys(minima: np.ndarray, size: int) -> np.ndarray:
    """(documents, bands) bucket keys."""
    bands = _bands(size)
    keys = np.empty((len(minima), len(bands)), np.uint64)
    for number, bins in enumerate(bands):
        key = np.full(len(minima), np.uint64(number + 1))
        for b in bins:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, b])
        keys[:, number] = key
    return keys.view(np.int64)


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model(None)
        with np.errstate(over="ignore"):
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    sets = part.column("shingles")
                    lengths = np.asarray(sets.value_lengths().fill_null(0))
                    flat = np.asarray(sets.flatten(), np.int64)
                    ends = np.concatenate(([0], np.cumsum(lengths)))

                    def sums(values):  # equal sets: equal sums of hashes
                        running = np.concatenate(([np.uint64(0)], np.cumsum(values)))
                        return pa.array((running[ends[1:]] - running[ends[:-1]]).view(np.int64))

                    mixed = _mix(flat.view(np.uint64))
                    keys = band_keys(sketch(flat, lengths), size)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id"),
                            part.column("row_hash"),
                            pa.array(lengths.astype(np.int64)),
                            sums(mixed),
                            sums(_mix(mixed + np.uint64(0x9E3779B97F4A7C15))),
                            listed,
                        ],
                        ["doc_id", "row_hash", "n_shingles", "sum1", "sum2", "bands"],
                    )

    return run


def _full_sets(nodes: DataFrame, docs: DataFrame, carriers: DataFrame, width: int, repeated: bool) -> DataFrame:
    """node, shingles of each of ``nodes``, from one document with that set.

    carriers: node, doc_id, row_hash of that document. repeated: rows of docs repeat
    doc_id and text.
    """
    wanted = nodes.join(carriers, "node").alias("w")
    texts = docs.withColumn("row_hash", F.xxhash64("text")).alias("d")
    found = texts.join(wanted, F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.row_hash") == F.col("w.row_hash")))
    found = found.select(F.col("node").alias("doc_id"), "d.text")
    shingled = with_shingles(found.dropDuplicates(["doc_id"]) if repeated else found, width)
    return materialize(shingled.withColumnRenamed("doc_id", "node"), "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) of nodes whose full sets are similar enough."""
    both = F.size(F.array_intersect("x.shingles", "y.shingles"))
    return (
        pairs.join(sets.alias("x"), F.col("a") == F.col("x.node"))
        .join(sets.alias("y"), F.col("b") == F.col("y.node"))
        .where(both * 100 >= (F.size("x.shingles") + F.size("y.shingles") - both) * percent)
        .select("a", "b")
        .distinct()
    )


def _own_shingles(sets: DataFrame) -> DataFrame:
    """node, own: shingles that no other of these sets has."""
    single = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    counted = single.groupBy("node").agg(F.count("*").alias("own"))
    return sets.select("node").join(counted, "node", "left").select("node", F.coalesce("own", F.lit(0)).alias("own"))


def _missed_links(members: DataFrame, links: DataFrame, found: DataFrame, sets_of, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, components) with the links between members of one bucket that the first stars left apart.

    A second star runs from the member with the fewest shingles of its own, the one
    nearest to all others, and measures how each member differs from it. Two sets
    differ from each other by at least d(x) + d(y) - 2 * shared, where d counts the
    differences from the centre and shared, those that both have, leaves out the
    shingles that one of them has alone. Members that are still apart are compared
    where that leaves the similarity possible, so no link is lost.
    """

    def apart(found: DataFrame) -> DataFrame:
        joined = members.select("key", "node", "n_shingles").join(found.withColumnRenamed("id", "node"), "node", "left")
        labelled = joined.select("key", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
        keys = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        return labelled.join(keys, "key", "left_semi")

    rest = materialize(apart(found), "apart")
    sets = sets_of(rest.select("node").distinct())
    own = materialize(_own_shingles(sets), "own")
    # a set with more of its own than the similarity allows is linked with nothing
    rest = rest.join(own, "node").where((F.col("n_shingles") - F.col("own")) * 100 >= F.col("n_shingles") * percent)
    centres = materialize(rest.groupBy("key").agg(F.min(F.struct("own", "node")).alias("c")).select("key", F.col("c.node").alias("centre")), "centres")
    spokes = rest.join(centres, "key").select("centre", "node").distinct()
    x, y = sets.alias("x"), sets.alias("y")
    both = F.size(F.array_intersect("x.shingles", "y.shingles")).cast("long")
    total = (F.size("x.shingles") + F.size("y.shingles")).cast("long")
    measured = materialize(
        spokes.join(x, F.col("centre") == F.col("x.node"))
        .join(y, spokes["node"] == F.col("y.node"))
        .select("centre", spokes["node"], (total - 2 * both).alias("d"), (both * 100 >= (total - both) * percent).alias("linked")),
        "spokes",
    )
    more = measured.where(F.col("linked") & (F.col("centre") != F.col("node"))).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = materialize(links.union(more), "links")
    found = materialize(connected_components(links), "found")

    rest = apart(found).join(own, "node").join(centres, "key").join(measured.drop("linked"), ["centre", "node"])
    # members of one bucket have one centre: by centre each pair comes once for many buckets
    rest = materialize(rest.select("centre", "node", "n_shingles", "component", "own", "d").distinct(), "apart")
    x, y = rest.alias("x"), rest.alias("y")
    shared = F.greatest(F.least(F.col("x.d") - F.col("x.own"), F.col("y.d") - F.col("y.own")), F.lit(0))
    differ = F.col("x.d") + F.col("y.d") - 2 * shared
    possible = differ * (100 + percent) <= (F.col("x.n_shingles") + F.col("y.n_shingles")) * (100 - percent)
    pairs = x.join(y, (F.col("x.centre") == F.col("y.centre")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & possible)
    pairs = materialize(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")
    more = materialize(_confirm(pairs, sets, percent), "links")
    if more.limit(1).count():
        links = links.union(more)
        found = materialize(connected_components(links), "found")
    discard(sets, own, centres, measured, pairs)
    return links, found


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document under links of Jaccard similarity >= percent / 100.

    docs: doc_id, text; further columns are ignored. Documents without words (null,
    empty or blank) are linked with nothing and kept. Rows with equal sets (equal
    size and two equal 64-bit sums of hashes) are linked, also those that repeat a
    doc_id. A null doc_id takes part in links but never names a component where
    another id is reachable. Of each component the document with its smallest doc_id
    is kept, of several with that doc_id the one with the smallest row_hash; rows
    that repeat both are one document and share its fate. An empty table gives an
    empty result.

    Returns doc_id, row_hash (hash of the text), n_shingles, component_id, kept.
    """
    base = docs.select("doc_id", "text")
    shingled = with_shingles(base.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("row_hash"))), width)
    rows = materialize(
        shingled.select("doc_id.doc_id", "doc_id.row_hash", "shingles").mapInArrow(
            _sketches(band_size(percent / 100)), "doc_id long, row_hash long, n_shingles long, sum1 long, sum2 long, bands array<long>"
        ),
        "sketches",
    )
    same_set = ["n_shingles", "sum1", "sum2"]
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_hash")  # null ids last
    found_once = rows.where("n_shingles > 0").groupBy(*same_set).agg(F.min(first).alias("carrier"), F.first("bands").alias("bands"), F.count("*").alias("rows"))
    nodes = materialize(found_once.select(F.monotonically_increasing_id().alias("node"), *same_set, "carrier", "bands", "rows"), "nodes")
    many = nodes.where("rows > 1").select(*same_set)
    repeats = rows.join(many, same_set, "left_semi").groupBy("doc_id", "row_hash").count().where("count > 1")
    repeated = bool(repeats.limit(1).count())

    buckets = nodes.select(F.explode("bands").alias("key"), "node", "n_shingles")
    shared = materialize(
        buckets.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").select("key", "centre"), "buckets"
    )
    members = materialize(buckets.join(shared, "key").select("key", "node", "n_shingles", "centre"), "members")
    sizes = members.where("node = centre").select(F.col("node").alias("centre"), F.col("n_shingles").alias("centre_n")).distinct()
    close = F.least("n_shingles", "centre_n") * 100 >= F.greatest("n_shingles", "centre_n") * percent
    stars = materialize(
        members.where("node <> centre").select("centre", "node", "n_shingles").distinct().join(sizes, "centre").where(close).select(F.col("centre").alias("a"), F.col("node").alias("b")),
        "stars",
    )
    carriers = nodes.select("node", "carrier.doc_id", "carrier.row_hash")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _full_sets(wanted, base, carriers, width, repeated)

    ends = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    sets = sets_of(ends)
    links = materialize(_confirm(stars, sets, percent), "links")
    discard(sets, shared)
    links, found = _missed_links(members, links, materialize(connected_components(links), "found"), sets_of, percent)
    discard(members, stars)

    labelled = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").select(*same_set, "carrier", F.coalesce("component", "node").alias("component"))
    named = labelled.groupBy("component").agg(F.min("carrier").alias("best"))
    of_set = labelled.join(named, "component").select(*same_set, "best")
    wordy = rows.where("n_shingles > 0").drop("bands").join(of_set, same_set)
    is_best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_hash") == F.col("best.row_hash"))
    wordy = wordy.select("doc_id", "row_hash", "n_shingles", F.col("best.doc_id").alias("component_id"), is_best.alias("kept"))
    return wordy.union(rows.where("n_shingles = 0").select("doc_id", "row_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True)))
