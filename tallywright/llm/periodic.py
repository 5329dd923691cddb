"""Periodic runs of words: harmonic grid, prefix hashes, vectorised longest common extensions.

A run of period q and length 4q or more holds three consecutive multiples of q, each
with a word equal to that q places on. So for every period the multiples of q are
grid points: n ln n pairs (period, point) of a text of n words in all. Pairs whose
words agree at three consecutive points are extended to both sides at once, by binary
search over prefix hashes; the runs found are verified word by word, and those of
one stretch are kept with their smallest period. Rows are judged where they are read:
no shuffle, and work that follows the words of a text, n log^2 n at worst.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import worker_model
from tallywright.llm.tokens import slices

#: Pairs (period, grid point) that are looked at together.
PAIRS = 1 << 20
#: An odd multiplier of the prefix hashes, which are taken modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def repeated(words: list, doc_id: int | None) -> list:
    """The words of a text, with a stretch of period p planted where the contract asks for it; a null doc_id plants none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


class PrefixHashes:
    """Hashes of all stretches of a text of word numbers, from sums of powers modulo 2^64."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(29)
        self.powers = np.full(n + 1, _BASE)
        self.powers[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.powers[:n], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at a <= b of these lengths have equal hashes."""
        s = self.sums
        return (s[a + length] - s[a]) * self.powers[b - a] == s[b + length] - s[b]

    def extend(self, a: np.ndarray, q: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        """How far the words at a and a + q agree to the right (or, back, before them to the left), all pairs in one binary search."""
        low, high = np.zeros_like(limit), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            at = a - middle if back else a
            same = self.equal(at, at + q, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _grid(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """All (period, point) of the periods first..last in a text of n words, by period, then point; point and point + period lie in the text."""
    periods = np.arange(first, last + 1)
    counts = (n - 1) // periods
    q = np.repeat(periods, counts)
    k = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
    return q, k * q


def _blocks(n: int, most: int, pairs: int) -> Iterator[tuple[int, int]]:
    """Ranges of periods 1..most whose grids have about so many pairs, one period at least."""
    first = 1
    while first <= most:
        last = first
        total = (n - 1) // first
        while last < most and total + (n - 1) // (last + 1) <= pairs:
            last += 1
            total += (n - 1) // last
        yield first, last
        first = last + 1


def _exactly(ids: np.ndarray, a: int, q: int) -> tuple[int, int]:
    """Start and end of the stretch around a that keeps period q, word by word."""
    same = ids[:-q] == ids[q:]
    after = np.flatnonzero(~same[a:])
    before = np.flatnonzero(~same[:a])
    return (int(before[-1]) + 1 if len(before) else 0), (a + int(after[0]) if len(after) else len(same)) + q


def _is_run(ids: np.ndarray, s: int, e: int, q: int) -> bool:
    """Whether the words s..e keep period q and neither neighbour extends them."""
    return bool((ids[s : e - q] == ids[s + q : e]).all()) and (s == 0 or ids[s - 1] != ids[s - 1 + q]) and (e == len(ids) or ids[e] != ids[e - q])


def find_runs(ids: np.ndarray, pairs: int = PAIRS, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of max(least, times * period) words or more, by start, then period.

    times is 4 or more, so that three grid points lie in every run.
    """
    n = len(ids)
    found: dict[tuple[int, int], int] = {}
    hashes = None
    for first, last in _blocks(n, n // times, pairs):
        q, a = _grid(n, first, last)
        hit = ids[a] == ids[a + q]
        k = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:] & (q[:-2] == q[2:])) if len(hit) > 2 else np.zeros(0, np.int64)
        if not len(k):
            continue
        hashes = hashes or PrefixHashes(ids)
        q, a = q[k], a[k]
        s = a - hashes.extend(a, q, a.copy(), True)
        e = a + q + hashes.extend(a, q, n - a - q, False)
        long = e - s >= np.maximum(least, times * q)
        s, e, q, a = s[long], e[long], q[long], a[long]
        stretch, at = np.unique(s * (n + 1) + e, return_index=True)  # periods ascend, so the first of a stretch is the smallest
        for key, i in zip(stretch.tolist(), at.tolist(), strict=True):
            start, end, period = int(s[i]), int(e[i]), int(q[i])
            if _is_run(ids, start, end, period):
                found[start, end] = min(period, found.get((start, end), period))
                continue
            for j in np.flatnonzero(s * (n + 1) + e == key).tolist():  # a hash was wrong: ask the words
                start, end = _exactly(ids, int(a[j]), int(q[j]))
                if end - start >= max(least, times * q[j]):
                    found[start, end] = min(int(q[j]), found.get((start, end), int(q[j])))
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that stay: those in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.flatnonzero(np.cumsum(edges[:-1]) == 0)


def run_row(text: str, doc_id: int | None) -> tuple:
    """The columns of SCHEMA after doc_id for one text."""
    words = repeated(text.encode("utf-8", "surrogatepass").split(), doc_id)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    runs = find_runs(ids) if len(ids) >= 6 else []
    listed = hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
    kept = words if not runs else [words[i] for i in collapsed(len(words), runs).tolist()]
    joined = hashlib.sha256(b" ".join(kept)).hexdigest()
    if not runs:
        return (0, None, None, None, None, listed, joined)
    s, k, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]))
    return (len(runs), s, k, q, 1000 * k // q, listed, joined)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_model(None)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    for batch in batches:
        doc_ids = batch.column("doc_id")
        at = 0
        for texts in slices(batch.column("text")):
            rows = [run_row(text, doc_id) for text, doc_id in zip(texts, doc_ids.slice(at, len(texts)).to_pylist(), strict=True)]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(texts)), *arrays], names)
            at += len(texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Runs of each whole text, one row per row of docs (doc_id, text), with the contract's stretches planted.

    Null and empty texts have no words and no runs; a null doc_id plants nothing and
    stays null; repeated rows give equal rows; further columns are ignored, whatever
    their names; an empty table gives an empty result. Of runs of one length the
    first counts as the longest, then that of the smallest period.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_runs, SCHEMA)
