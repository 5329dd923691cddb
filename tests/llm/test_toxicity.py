"""Toxicity: folding, matching against a plain search, learning, and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tallywright.llm import toxicity as T

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, toxic int, label int, key string"
MARKS = "doc_id long, toxic int, text string"


@pytest.mark.parametrize("text", ["idiot", "IDIOT!", "id1ot", "1d1ot", "!diot", "ídïot", "іdіоt", "ｉｄｉｏｔ", "id​iot", "1d10t", "𝐢𝐝𝐢𝐨𝐭", "c1own", "cl0wn", "$cum", "tr4sh", "TR@SH"])
def test_disguises_are_read(text):
    words, terms, weight = T.Lexicon({f" {w} ": 4.0 for w in T.INSULTS}).measure(f"you are {text}, they say")
    assert (words, terms, weight) == (5, 1, 4.0)


@pytest.mark.parametrize("text", ["", " \n", "closer losers2go trashy idiotism", "a 455 b 1010 7", "take out the trash, then", "a trash can and a circus clown", "not stupid at all"])
def test_what_does_not_count(text):
    assert T.Lexicon({f" {w} ": 4.0 for w in T.INSULTS} | {" ass ": 4.0}).measure(text)[1:] == (0, 0)


def plainly(model, text):
    """Words and the weights of those that match, by a look at every word in every reading."""
    base = T.folded(text)
    shown = [reading.split() for reading in T.readings(base)]
    n, best = len(base), {}
    for words in shown:
        for i, word in enumerate(words):
            for term, weight in model.weights.items():
                if word == term.strip() if term.endswith(" ") else word.startswith(term.strip()):
                    best[i] = max(best.get(i, 0), weight)
    for words in shown:
        for phrase in model.exceptions:
            said = phrase.split()
            for i in range(n - len(said) + 1):
                if words[i : i + len(said)] == said:
                    for k in range(i, i + len(said)):
                        best.pop(k, None)
    return n, len(best), sum(best.values())


def test_matches_against_a_plain_search():
    rng = random.Random(3)
    model = T.Lexicon({" trash ": 3.0, " tra": 1.0, " clown ": 2.0, " ré": 0.5, " réeu": 2.5, " l0": 9.0, " can ": 0.25}, ("trash can", "no clown"))
    pieces = ["trash", "TRASH", "tr4sh", "can", "travel", "clown", "c1own", "no", "réeux", "re", "12", "l0", "a.b", "ünï", "!", "extra", "-"]
    for _ in range(500):
        text = " ".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert model.measure(text) == pytest.approx(plainly(model, text)), text


def test_terms_give_way():
    count = lambda clean, toxic: np.array([[clean / 4] * 4, [toxic / 4] * 4])
    total = count(100_000, 10_000)
    counts = {" low": count(900, 100), " lowe": count(0, 100), " lowei": count(0, 100), " loweis": count(0, 30), " loweis ": count(0, 20), " rare ": count(0, 3), " common ": count(500, 60), " trash ": count(40_000, 10)}
    chosen = T.choose_terms(counts, total, None, 6, 2.0)
    learned = {t for t in chosen if t.strip() not in T.INSULTS}
    assert learned == {" lowei"} and chosen[" idiot "] == T.PRIOR and chosen[" trash "] == 0.0


def test_copies_teach_once():
    text = " ".join(f"word{i}" for i in range(300))
    near = text.replace("word150", "changed")
    assert T.origin(text.split()) == T.origin(near.split()) and T.origin([]) == 0 and T.origin(["a"]) == T.origin(["a"])


def test_learned_words(spark):
    """Words of no list are learned from labels, their copies do not count, and held-out labels are not read."""
    rng = random.Random(1)
    common = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        words = rng.choices(common, k=rng.randint(15, 60))
        toxic = i % 5 == 0
        for _ in range(max(2, len(words) // 12) if toxic else 0):
            words.insert(rng.randrange(len(words)), "zorgle" + rng.choice(["n", "ns", "st"]))
        rows.append((i, " ".join(words), "x", 9, 9, "k"))
        marks.append((i, int(toxic), "clash"))
    rows += [(1000 + i, "copied words of one toxic text " * 3, None, None, None, None) for i in range(60)]
    marks += [(1000 + i, 1, "clash") for i in range(60)] + [(None, 1, ""), (3, 7, ""), (1, 0, "")]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, MARKS)
    model = T.train(docs, labels)
    learned = {t.strip() for t in model.weights if t.strip() not in T.INSULTS}
    assert learned and all(t.startswith("zor") for t in learned)
    wrong = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t, x) for i, t, x in marks if i is not None], MARKS)
    again = T.train(docs, wrong)
    assert again.weights == model.weights and (again.slope, again.offset) == pytest.approx((model.slope, model.offset))
    got = {r.doc_id: r for r in T.score_toxicity(docs, labels).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(400))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))


def test_edge_rows(spark):
    long = "fine words " * 100_000
    rows = [(1, None), (2, ""), (3, " \t"), (None, "you idiot, you moron"), (4, "you idiot, you moron"), (4, "you idiot, you moron"), (5, long), (6, long + "idiot"), (7, "." * 50_000), (8, "1" * 50_000 + "a"), (9, "퟿!@$|")]
    docs = spark.createDataFrame([(i, t, "clash", 1, 1, "k") for i, t in rows], SCHEMA)
    none = spark.createDataFrame([], MARKS)
    got = T.score_toxicity(docs, none).collect()
    assert Counter((r.doc_id, r.predicted) for r in got) == {(1, 0): 1, (2, 0): 1, (3, 0): 1, (None, 1): 1, (4, 1): 2, (5, 0): 1, (6, 0): 1, (7, 0): 1, (8, 0): 1, (9, 0): 1}
    assert all(0 <= r.score <= 1 and r.held_out is not None for r in got) and next(r for r in got if r.doc_id is None).held_out
    assert next(r for r in got if r.doc_id == 6).n_terms == 1
    assert T.score_toxicity(spark.createDataFrame([], SCHEMA), none).collect() == []


def test_curve_is_the_best():
    x, y, n = np.array([0.0, 0.5, 1.0, 1.5]), np.array([0, 0, 1, 1]), np.array([50.0, 20, 20, 50])
    x, y, n = np.concatenate([x, x]), np.concatenate([y, 1 - y]), np.concatenate([n, n / 10])
    loss = lambda a, b: -sum(k * math.log(1 / (1 + math.exp(-(a * u + b) * (1 if v else -1)))) for u, v, k in zip(x, y, n, strict=True)) - 0 + 0.15 * (a - 3) ** 2 + 5e-4 * b * b
    a, b = T.fit_curve(x, y, n)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = T.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    assert len(rows) > 50
    assert sum(r.toxic == r.predicted for r in rows) / len(rows) >= 0.95
    high, low = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a in high for b in low) / (len(high) * len(low)) >= 0.9


def test_readings_keep_the_words():
    for text in ["Straße 1ßa İstanbul ǆ ﬁne", "ÀÉÎÕÜ id1ot", "ϒΑΒγ абв @l$o! 日本 x"]:
        words = T.folded(text)
        assert {r.count(" ") for r in T.readings(words)} == {len(words) + 1}
    assert T.readings(T.folded("ünï 1d10t")) == [" ünï idiot ", " uni idiot ", " uni ldlot "]
    assert T.folded("$455 12 a_b 4ever") == ["a", "b", "4ever"]
