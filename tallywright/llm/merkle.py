"""Merkle manifest of a dataset: a tree for each source, and one over the sources.

Rows get a gapless place within their source by a range sort and counts of its
parts. Leaves are gathered in aligned blocks of FANOUT ** LEVELS, a row of a table
each, whose digests are one contiguous numpy matrix of 64-byte rows: a level is
reshaped by the fanout and hashed row by row, and every sibling is found by index
arithmetic. The blocks' tops are the leaves of the next pass, so the number of
passes is the logarithm of the largest source to the base of a block, and no task
holds more than a block at once. Paths come down the same passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.llm.common import discard, materialize, worker_model

FANOUT = 3
#: Levels within a block.
LEVELS = 6
WIDTH = 64
NODE = "key string, pos long, n long, digest string"
PATH = "key string, pos long, subroot string, root string, before array<string>, after array<string>"


# ---- one block


def depth(n: int) -> int:
    """Levels over n leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def matrix(digests: str) -> np.ndarray:
    """Digests written one after the other as a matrix of a row each."""
    return np.frombuffer(digests.encode("ascii"), np.uint8).reshape(-1, WIDTH)


def _hashed(data: bytes, width: int, lengths: np.ndarray) -> np.ndarray:
    """Digests of the first lengths[i] bytes of each row of so many bytes."""
    made = "".join([sha256(data[at : at + k]).hexdigest() for at, k in zip(range(0, width * len(lengths), width), lengths.tolist(), strict=True)])
    return matrix(made)


def block_levels(leaves: np.ndarray, levels: int) -> list[np.ndarray]:
    """The matrices of all levels of a block, its leaves first."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        runs = -(-len(below) // FANOUT)
        lengths = np.full(runs, FANOUT * WIDTH)
        lengths[-1] = WIDTH * (len(below) - FANOUT * (runs - 1))
        out.append(_hashed(below.tobytes(), FANOUT * WIDTH, lengths))
    return out


def runs_of(level: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes by their places in a level: their runs as (node, FANOUT, WIDTH), which members exist, and each one's place in its run."""
    members = (own // FANOUT * FANOUT)[:, None] + np.arange(FANOUT)
    there = members < len(level)
    return level[np.minimum(members, len(level) - 1)], there, own % FANOUT


def block_siblings(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every leaf: siblings (leaf, level, FANOUT, WIDTH), which of them exist, and which stand before the own node."""
    leaf = np.arange(len(levels[0]))
    nodes, there, before = [], [], []
    for level, below in enumerate(levels[:-1]):
        run, exists, slot = runs_of(below, leaf // FANOUT**level)
        nodes.append(run)
        there.append(exists & (np.arange(FANOUT) != slot[:, None]))
        before.append(np.arange(FANOUT) < slot[:, None])
    if not nodes:
        none = np.zeros((len(leaf), 0, FANOUT), bool)
        return np.zeros((len(leaf), 0, FANOUT, WIDTH), np.uint8), none, none
    return np.stack(nodes, 1), np.stack(there, 1), np.stack(before, 1)


def fold(start: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """What the nodes above become, up to the block's top, when each leaf alone is replaced by its row of start."""
    leaf, now = np.arange(len(start)), start
    for level, below in enumerate(levels[:-1]):
        run, there, slot = runs_of(below, leaf // FANOUT**level)
        run = run.copy()
        run[leaf, slot] = now
        now = _hashed(run.tobytes(), FANOUT * WIDTH, WIDTH * there.sum(1))
    return now


def _text(row: np.ndarray) -> str:
    return row.tobytes().decode("ascii")


# ---- tables


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields: `-` for null, else the bytes of the value in UTF-8, `:` and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def numbered(rows: DataFrame, group: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows with pos, the gapless place within the group in the order of by, and n, the group's rows; and the table to discard when these have been read.

    One range sort; then every part of it counts its rows of each group, and the
    counts before it are its offset. Rows equal in group and by may change places.
    """
    parts = rows.repartitionByRange(group, *by).sortWithinPartitions(group, *by)
    held = materialize(parts.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "ordered")
    counts = held.groupBy(group, "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n"))
    return held.join(offsets, [group, "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("row", "part", "shift"), held


def _blocks(nodes: DataFrame, size: int, more: dict[str, str]) -> DataFrame:
    """A row for each aligned block of nodes (key, pos, n, digest); more: further columns gathered in order, as expressions over the list."""
    held = F.sort_array(F.collect_list(F.struct("pos", "digest", *(nodes[c] for c in nodes.columns if c not in ("key", "pos", "n", "digest")))))
    rows = nodes.groupBy("key", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.first("n").alias("n"), held.alias("held"))
    return rows.select("key", "block", "n", F.expr("array_join(transform(held, x -> x.digest), '')").alias("digests"), *(F.expr(e).alias(c) for c, e in more.items()))


def _levels_of(n: int, levels: int) -> int:
    return levels if n > FANOUT**levels else depth(n)


def _tops(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model(None)
        for batch in batches:
            counts = batch.column("n").to_pylist()
            tops = [_text(block_levels(matrix(d.as_py()), _levels_of(n, levels))[-1][0]) for d, n in zip(batch.column("digests"), counts, strict=True)]
            above = pa.array([-(-n // FANOUT**levels) for n in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), above, pa.array(tops, pa.string())], ["key", "pos", "n", "digest"])

    return run


@dataclass
class Tree:
    """Tables of blocks, by pass from the leaves up, and the roots (key, digest), read from the tables spent."""

    passes: list[DataFrame]
    roots: DataFrame
    spent: list[DataFrame]


def grow(nodes: DataFrame, levels: int, more: dict[str, str] | None = None) -> Tree:
    """Hash nodes (key, pos, n, digest) up to one root for each key."""
    passes, spent, roots = [], [], None
    while True:
        passes.append(materialize(_blocks(nodes, FANOUT**levels, more if more and not passes else {}), "blocks"))
        tops = materialize(passes[-1].mapInArrow(_tops(levels), NODE), "tops")
        spent.append(tops)
        done = tops.where("n = 1").select("key", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = tops.where("n > 1")
        if not nodes.limit(1).count():
            return Tree(passes, roots, spent)


def _with_path(tree: Tree, at: int, levels: int, of_roots: DataFrame, above: DataFrame | None) -> DataFrame:
    """The blocks of a pass with the path over each one's top: that of the key's root, or that of the node it is in the next pass."""
    size, blocks = FANOUT**levels, tree.passes[at]
    joined = blocks.where(F.col("n") <= size).join(of_roots.drop("pos"), "key")
    if above is not None:
        joined = joined.unionByName(blocks.where(F.col("n") > size).join(above.withColumnRenamed("pos", "block"), ["key", "block"]))
    return joined


def _node_paths(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model(None)
        for batch in batches:
            for row in batch.to_pylist():
                nodes, there, before = block_siblings(block_levels(matrix(row["digests"]), _levels_of(row["n"], levels)))
                sides = [
                    [[_text(nodes[i, k][side[i, k]]) for k in range(nodes.shape[1])] + row[name] for i in range(len(nodes))]
                    for name, side in (("before", there & before), ("after", there & ~before))
                ]
                m = len(nodes)
                pos = np.arange(m) + row["block"] * FANOUT**levels
                lists = [pa.array(s, pa.list_(pa.string())) for s in sides]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * m), pa.array(pos), pa.array([row["subroot"]] * m), pa.array([row["root"]] * m), *lists], ["key", "pos", "subroot", "root", "before", "after"])

    return run


def paths(tree: Tree, levels: int, of_roots: DataFrame, down_to: int = 0) -> DataFrame | None:
    """PATH of the nodes of a pass: siblings before and after the own node, by level up to the root; None where the pass is not there."""
    above = None
    for at in reversed(range(down_to, len(tree.passes))):
        above = materialize(_with_path(tree, at, levels, of_roots, above).mapInArrow(_node_paths(levels), PATH), "paths")
    return above


# ---- the manifest


@dataclass
class Manifest:
    """A tree over the rows, by source, and the path of every source's root (key, subroot, root, before, after)."""

    tree: Tree
    sources: DataFrame
    levels: int


def write_manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> Manifest:
    """Hash the rows of docs (doc_id, source, lang, n_chars, text) into trees, and the sources' roots into one.

    Rows are ordered by doc_id, null first, then by digest (equal rows may change
    places, they have equal digests); sources by their bytes, null first. tampered:
    an expression for a text that stands in for the row's own; its leaf is kept
    beside. Null and empty texts differ. Further columns are ignored. An empty table
    gives a manifest without a root.
    """
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    own = leaf_digest(fields(F.col("text")))
    key = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    rows = docs.select(key.alias("key"), "doc_id", own.alias("digest"), (own if tampered is None else leaf_digest(fields(tampered))).alias("altered"))
    more = {"ids": "transform(held, x -> x.doc_id)", "altered": "array_join(transform(held, x -> x.altered), '')"}
    placed, ordered = numbered(rows, "key", ["doc_id", "digest"])
    tree = grow(placed, levels, more)
    discard(ordered)
    roots = materialize(tree.roots.withColumnRenamed("key", "source_key").withColumn("key", F.lit("")), "roots")
    placed, ordered = numbered(roots, "key", ["source_key"])
    places = materialize(placed, "places")
    discard(*tree.spent, ordered, roots)
    top = grow(places.select("key", "pos", "n", "digest"), levels)
    root = top.roots.select("key", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), *(F.expr("cast(array() as array<string>)").alias(c) for c in ("before", "after")))
    over = paths(top, levels, root).drop("subroot", "key")
    sources = places.select(F.col("source_key").alias("key"), "pos", F.col("digest").alias("subroot")).join(over, "pos").select("key", "pos", "subroot", "root", "before", "after")
    found = Manifest(tree, materialize(sources, "sources"), levels)
    discard(places, *top.passes, *top.spent)
    return found


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _verified(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model(None)
        names = [field.split()[0] for field in PROOF.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                below = block_levels(matrix(row["digests"]), _levels_of(row["n"], levels))
                nodes, there, _ = block_siblings(below)
                sides = [(b.encode(), a.encode()) for b, a in zip(row["before"], row["after"], strict=True)]
                over = b"".join(b + a for b, a in sides)
                proofs = [sha256(n[t].tobytes() + over).hexdigest() for n, t in zip(nodes, there, strict=True)]
                now = [_text(x).encode() for x in fold(matrix(row["altered"]), below)]
                for b, a in sides:
                    now = [sha256(b + x + a).hexdigest().encode() for x in now]
                m = len(now)
                folded = [x.decode() for x in now]
                columns = [row["ids"], [_text(x) for x in below[0]], [row["subroot"]] * m, [row["root"]] * m, proofs, folded, [x == row["root"] for x in folded]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.string()] * 5 + [pa.bool_()], strict=True)], names)

    return run


def _leaf_blocks(manifest: Manifest) -> DataFrame:
    return _with_path(manifest.tree, 0, manifest.levels, manifest.sources, paths(manifest.tree, manifest.levels, manifest.sources, 1))


def proofs(manifest: Manifest) -> DataFrame:
    """PATH of every leaf (key: `0` for a null source, else `1` and the source; pos: place within it), with all siblings written out."""
    return _leaf_blocks(manifest).mapInArrow(_node_paths(manifest.levels), PATH)


def verify(manifest: Manifest) -> DataFrame:
    """PROOF of every row: its path's digest, and the root that its tampered leaf, else its own, folds to with that path."""
    return _leaf_blocks(manifest).mapInArrow(_verified(manifest.levels), PROOF)
