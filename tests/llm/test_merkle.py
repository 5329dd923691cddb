"""Merkle manifests against trees built node by node."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallywright.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, pos int"


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """Levels from these nodes to one, each run of three hashed together."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
    return levels


def path(levels, i):
    """(before, after) of node i, level by level."""
    out = []
    for below in levels[:-1]:
        r = i // 3 * 3
        out.append(("".join(below[r:i]), "".join(below[i + 1 : r + 3])))
        i //= 3
    return out


def tampered(row):
    return row[4].replace("\n", "") if row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else row[4]


def by_hand(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(0, b"") if row[1] is None else (1, row[1].encode())].append(row)
    trees, keys = {}, sorted(groups)
    for key in keys:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
        trees[key] = climb([leaf_of(r, r[4]) for r in groups[key]])
    top = climb([trees[k][-1][0] for k in keys])
    out, whole = [], []
    for place, key in enumerate(keys):
        for i, row in enumerate(groups[key]):
            steps = path(trees[key], i) + path(top, place)
            now = leaf_of(row, tampered(row))
            for b, a in steps:
                now = h(b + now + a)
            root = top[-1][0]
            out.append((row[0], leaf_of(row, row[4]), trees[key][-1][0], root, h("".join(b + a for b, a in steps)), now, now == root))
            whole.append((key[1].decode() if key[0] else None, i, [b for b, _ in steps], [a for _, a in steps]))
    return out, whole


def made(rng, n, sources):
    text = lambda: rng.choice([None, "", "one", "a\nb", "ünï\n\ncode", "x" * rng.randint(0, 300) + "\n"])
    return [(i, rng.choice(sources), rng.choice([None, "en", "de"]), rng.choice([None, 5, -3]), text(), "clash", 1) for i in rng.sample(range(10 * n), n)]


def temper():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


@pytest.mark.parametrize("n, sources, levels", [(1, ["a"], 1), (2, [None], 2), (90, ["hot"] * 5 + ["b", None, "", "é", "Z"], 1), (300, ["hot"] * 9 + [f"s{i}" for i in range(30)] + [None], 2), (40, ["x", "y", "z"], 6)])
def test_proofs(spark, n, sources, levels):
    rows = made(random.Random(n), n, sources)
    manifest = merkle.write_manifest(spark.createDataFrame(rows, SCHEMA).repartition(3), temper(), levels)
    want, whole = by_hand(rows)
    assert sorted(map(tuple, merkle.verify(manifest).collect()), key=str) == sorted(want, key=str)
    got = [(r.key[1:] if r.key != "0" else None, r.pos, r.before, r.after) for r in merkle.proofs(manifest).collect()]
    assert sorted(got, key=str) == sorted(whole, key=str)


def test_repeated_and_null_ids(spark):
    rows = [(7, "a", "en", 3, "x\ny", "", 1)] * 5 + [(None, "a", "en", 3, "x\ny", "", 1)] * 3 + [(7, "a", "en", 3, "other", "", 1), (1, None, None, None, None, "", 1)]
    got = merkle.verify(merkle.write_manifest(spark.createDataFrame(rows, SCHEMA), temper(), 1)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows)[0], key=str)


def test_without_tampering_all_verify(spark):
    rows = made(random.Random(2), 50, ["a", "b"])
    assert all(r.verified for r in merkle.verify(merkle.write_manifest(spark.createDataFrame(rows, SCHEMA))).collect())


def test_empty(spark):
    manifest = merkle.write_manifest(spark.createDataFrame([], SCHEMA), temper())
    assert merkle.verify(manifest).collect() == [] and merkle.proofs(manifest).collect() == []
