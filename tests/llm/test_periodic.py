"""Periodic runs against a scan of every period, word by word."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tallywright.llm import periodic

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, start string, n_runs long"


def scanned(words):
    """(start, length, period) of every run, by looking at each period in turn."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    n, kinds = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6])
    words = [rng.randrange(kinds) for _ in range(n)]
    if n > 8 and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("weak", [False, True])
def test_runs_against_a_scan(weak, monkeypatch):
    """With weak hashes every stretch seems equal to every other, so that only the check of the words holds."""
    if weak:
        monkeypatch.setattr(periodic.PrefixHashes, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    rng = random.Random(5)
    for _ in range(1500):
        words = random_words(rng)
        got = periodic.find_runs(np.array(words, np.int64), pairs=rng.choice([1, 20, 1 << 20]))
        assert got == scanned(words), words


def expected(doc_id, text):
    """The contract's row, stated plainly."""
    words = (text or "").encode().split()
    h, n = (zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = scanned(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    s, k, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), s, k, q, 1000 * k // q if runs else None, digest("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), digest(kept))


def test_rows(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x a b a b a b a b y", "é " * 9, "no run here at all, none", " ".join("abcd") * 7]
    rows = [(i * 7, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "a a a a a a", None, None)] * 2
    rows += [(i, " ".join(f"w{j % 11}" for j in range(i % 90)), None, None) for i in range(1000, 1200)]
    got = sorted(map(tuple, periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert periodic.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = docs.where("length(text) < 4000")
    got = sorted(map(tuple, periodic.periodic_runs(short).collect()), key=str)
    assert got == sorted((expected(r.doc_id, r.text) for r in short.collect()), key=str)


@pytest.mark.parametrize("period", [1, 7, 5000])
def test_long_texts(period):
    """Time follows the words, whatever repeats."""
    seconds = []
    for n in (25_000, 200_000):
        began = time.time()
        assert periodic.find_runs(np.arange(n) % period if period < 5000 else np.random.default_rng(1).permutation(n)) == ([(0, n, period)] if period < 5000 else [])
        seconds.append(time.time() - began)
    assert seconds[1] < 20 * seconds[0] + 2
