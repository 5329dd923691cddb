"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length.

Texts are folded (compatibility forms, case, look-alike letters, digits and signs that
stand for letters) and cut into words. The lexicon holds plain insults with a prior
weight, and words and word beginnings that labelled rows tie to toxic texts, weighted
by their log-odds. Words inside exception phrases do not count. The sum of weights is
set against the words of the text, and a logistic curve, fitted to labelled rows whose
own fold did not teach the terms, makes it a score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import materialize, worker_model
from tallywright.llm.tokens import slices

#: Plain insults, whole words, with the weight that they have before any row is seen.
INSULTS = """
idiot idiots idiotic moron morons moronic imbecile imbeciles stupid dumb dumbass dimwit halfwit fool cretin loser losers scum scumbag trash garbage filth filthy worthless
useless pathetic disgusting despicable repulsive vile clown clowns bastard bastards jerk creep degenerate parasite vermin subhuman retard retarded asshole bitch slut whore
dummkopf trottel abschaum widerlich arschloch dreckskerl imbécile connard abruti ordure salaud idiota imbécil estúpido basura asqueroso inútil
""".split()
PRIOR = 4.0
#: Phrases in which a word of the lexicon is no insult.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "take out the trash", "garbage collection", "garbage collector", "garbage can", "garbage truck",
    "clown fish", "clown car", "circus clown", "rodeo clown", "class clown", "idiot proof", "fool proof", "april fool", "sore loser", "jerk chicken", "jerk seasoning", "dumb waiter", "dumb terminal",
    "filthy rich", "no useless", "not stupid", "not worthless", "not pathetic", "pond scum", "soap scum",
)
# Letters of other scripts that look like Latin ones, in the order of the letters they stand for.
_CYRILLIC, _CYRILLIC_LATIN = "аеорсухіјѕһԁԛԝӏкмтвн", "aeopcyxijshdqwlkmtbh"
_GREEK, _GREEK_LATIN = "αεικνορτυχω", "aeiknoptuxw"
_OTHER, _OTHER_LATIN = "ıłøđßɑɡɩʀʏ", "ilodsagiry"
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_LOOKALIKES = str.maketrans(_CYRILLIC + _GREEK + _OTHER, _CYRILLIC_LATIN + _GREEK_LATIN + _OTHER_LATIN, _INVISIBLE)
_ANY_LOOKALIKE = re.compile(f"[{_CYRILLIC}{_GREEK}{_OTHER}{_INVISIBLE}]")
# Signs by the digits that they look like, and digits by letters; 1 stands for i or l.
_SIGNS = {"@": "4", "$": "5", "!": "1", "|": "1"}
_DIGITS = dict(zip("0134578", "oieastb", strict=True))
_AS_I = str.maketrans(_DIGITS)
_AS_L = str.maketrans(_DIGITS | {"1": "l"})
_SIGN = re.compile(r"[@$!|](?=[^\W_])")
_GAP = re.compile(r"[\W_]+")
_SPACE = re.compile(" ")
_ASCII_GAPS = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum()})


def folded(text: str) -> list[str]:
    """Words in lower case, look-alikes as Latin letters, signs before a letter or digit as digits; words of digits alone are left out."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if _ANY_LOOKALIKE.search(text):
        text = unicodedata.normalize("NFC", text.translate(_LOOKALIKES))
    text = _SIGN.sub(lambda m: _SIGNS[m[0]], text)
    words = text.translate(_ASCII_GAPS) if text.isascii() else _GAP.sub(" ", text)
    return [w for w in words.split() if not w.isdigit()]


def spelled(words: list[str], table: dict = _AS_I) -> list[str]:
    """The words with digits read as letters."""
    return [w if w.isalpha() else w.translate(table) for w in words]


def readings(words: list[str]) -> list[str]:
    """What folded words may say, each reading with one space before, between and after all of them: digits as letters, 1 as i and as l, with marks and without.

    Every reading has the words in their order, so a word is known by its number. A
    word that has no Latin letter is empty in a reading without marks.
    """
    out = [f" {' '.join(spelled(words))} "]
    if not out[0].isascii():
        out.append(_unmarked(out[0]))
    if any("1" in w for w in words):
        out.append(_unmarked(f" {' '.join(spelled(words, _AS_L))} "))
    return list(dict.fromkeys(out))


def _unmarked(text: str) -> str:
    return unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode("ascii")


@dataclass
class Lexicon:
    """Weights by term: ` word ` is a whole word, ` begin` the beginning of one; and phrases whose words do not count."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 3.0
    offset: float = -4.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        """The matcher of all terms and phrases, built once in each process."""
        import ahocorasick

        if self._automaton is None:
            made = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                made.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                known = f" {phrase} "
                made.add_word(known, (len(known), None))
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def measure(self, text: str) -> tuple[int, int, float]:
        """Words, words that match the lexicon, and the sum of their weights; a word counts once, with its heaviest term."""
        words = folded(text)
        best: dict[int, float] = {}
        excused: set[int] = set()
        for said in readings(words) if words else ():
            found = list(self.automaton().iter(said))
            spaces = [m.start() for m in _SPACE.finditer(said)] if found else []
            for end, (size, weight) in found:
                number = bisect_left(spaces, end - size + 1)  # a term starts with the space before its word
                if weight is None:
                    excused.update(range(number, bisect_left(spaces, end)))
                elif weight > best.get(number, 0.0):
                    best[number] = weight
        kept = [w for number, w in best.items() if number not in excused]
        return len(words), len(kept), sum(kept)

    def score(self, density: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of densities."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * density + self.offset, -30, 30)))


def density(words: int, weight: float) -> float:
    """The sum of weights against the length: log(1 + 100 * weight / (words + 20))."""
    return float(np.log1p(100.0 * weight / (words + 20)))


# ---- learning

FOLDS = 4
#: A text teaches a word this many times at most.
TIMES = 4


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 5 is 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """text, label of the rows to learn from: about most_rows doc_ids of each label, chosen by a hash of the id.

    Labels other than 0 and 1 and null ids are ignored; of several labels of one
    doc_id the largest counts.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = reduce(lambda a, b: a | b, [(F.col("label") == k) & (place < int(min(1.0, most_rows / max(1, n)) * (1 << 30))) for k, n in sorted(counts.items())], F.lit(False))
    taken = marks.where(chosen).select(F.col("doc_id").alias("key"), "label")
    # twice most_rows of (long, int) at about: a size that the parameter bounds
    texts = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text")
    return texts.join(F.broadcast(taken), F.col("id") == F.col("key")).select("text", "label")


def origin(words: list[str]) -> int:
    """A hash that most copies and near copies of a text share: the smallest of its runs of three words."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return min((zlib.crc32(b" ".join(data[i : i + 3])) for i in range(max(1, len(data) - 2))), default=0)


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, label, source (an origin and a number below TIMES) of each word of each text."""
    worker_model(None)
    for batch in batches:
        labels = iter(batch.column("label").to_pylist())
        for texts in slices(batch.column("text"), 200_000):
            rows: tuple[list, list, list] = ([], [], [])
            for text in texts:
                words = spelled(folded(text))
                label, source = next(labels), origin(words)
                for word, count in Counter(words).items():
                    k = min(count, TIMES) if len(word) <= 30 else 0
                    rows[0].extend([word] * k)
                    rows[1].extend([label] * k)
                    rows[2].extend(source * TIMES + j for j in range(k))
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64())], ["word", "label", "source"])


def term_counts(rows: DataFrame, least: int, most_terms: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts by (label, fold) of the terms that toxic rows use most, and the totals.

    A text counts a word by its origin, so copies teach no more than one of them.
    Prefixes are expanded from the counts of words, not from the texts. The terms
    kept are a size of the model: those of at least ``least`` toxic uses with the
    largest log-odds times the root of their uses, most_terms at most.
    """
    heard = rows.mapInArrow(_taught, "word string, label int, source long").distinct()
    fold = F.pmod(F.shiftright("source", 2), F.lit(FOLDS))
    cells = [F.count(F.when((F.col("label") == k) & (fold == f), 1)).alias(f"c{k}{f}") for k in (0, 1) for f in range(FOLDS)]
    names = [f"c{k}{f}" for k in (0, 1) for f in range(FOLDS)]
    words = materialize(heard.groupBy("word").agg(*cells), "words")
    total = np.array([v or 0 for v in words.agg(*(F.sum(n) for n in names)).first()], float).reshape(2, FOLDS)
    size = F.char_length("word")
    beginnings = F.transform(F.sequence(F.lit(3), F.least(size, F.lit(12))), lambda k: F.concat(F.lit(" "), F.substring("word", F.lit(1), k)))
    terms = F.concat(F.when(size >= 3, beginnings).otherwise(F.array()), F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" "))))
    each = words.select(F.explode(terms).alias("term"), *names).groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    uses = [sum((F.col(f"c{k}{f}") for f in range(FOLDS)), F.lit(0)) for k in (0, 1)]
    odds = F.log((uses[1] + 0.5) / (total[1].sum() + 1)) - F.log((uses[0] + 0.5) / (total[0].sum() + 1))
    own = F.col("term").isin([f" {w} " for w in INSULTS])
    best = each.withColumn("rank", F.when(own, 1e9).otherwise(odds * F.sqrt(uses[1]))).where(own | ((uses[1] >= least) & (odds >= 1))).orderBy(F.desc("rank"), "term").limit(most_terms)
    return {r["term"]: np.array([r[n] for n in names], float).reshape(2, FOLDS) for r in best.collect()}, total


def choose_terms(counts: dict[str, np.ndarray], total: np.ndarray, without: int | None, least: int, odds: float) -> dict[str, float]:
    """Weights of the terms, learned from all folds but one.

    A beginning gives way to a longer one that holds most of its toxic uses, and a
    longer one to a shorter that says as much.
    """
    folds = [f for f in range(FOLDS) if f != without]
    sums = {t: c[:, folds].sum(1) for t, c in counts.items()}
    whole = total[:, folds].sum(1)
    weight = {t: float(np.log((n[1] + 0.5) / (whole[1] + 1)) - np.log((n[0] + 0.5) / (whole[0] + 1))) for t, n in sums.items()}
    share = (whole[1] + 1) / (whole.sum() + 2)
    sure = {t: n[1] - share * n.sum() >= 5 * np.sqrt(share * n.sum()) for t, n in sums.items()}  # beyond chance
    good = {t for t in sums if sums[t][1] >= least and weight[t] >= odds and sure[t]}
    shadowed = set()
    for term in good:
        uses = sums[term][1]
        for k in range(4, len(term)):
            if term[:k] in good and uses >= 0.85 * sums[term[:k]][1]:
                shadowed.add(term[:k])
    closed = good - shadowed
    kept = {t: min(6.0, weight[t]) for t in closed if not any(t[:k] in closed and weight[t[:k]] >= weight[t] - 0.3 for k in range(4, len(t)))}
    for word in INSULTS:
        n = sums.get(f" {word} ", np.zeros(2)).sum()
        own = (5 * PRIOR + n * np.clip(weight.get(f" {word} ", PRIOR), -6, 6)) / (5 + n)
        kept[f" {word} "] = max(kept.get(f" {word} ", 0.0), float(max(0.0, own)))
    return kept


def _binned(lexicons: list[Lexicon], width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model(None)
        for batch in batches:
            bins = []
            for texts in slices(batch.column("text")):
                for text in texts:
                    of = lexicons[(origin(spelled(folded(text))) % FOLDS)]
                    words, _, weight = of.measure(text)
                    bins.append(int(density(words, weight) / width))
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), batch.column("label")], ["bin", "label"])

    return run


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, slope: float = 3.0, prior: float = 0.3) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (x, label y, count n), by damped Newton steps; the slope leans to its prior."""
    beta, centre = np.array([slope, -4.0]), np.array([slope, 0.0])
    basis, lean = np.stack([x, np.ones_like(x)], 1), np.array([prior, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(basis @ beta, -30, 30)))
        gradient = basis.T @ (n * (y - p)) - lean * (beta - centre)
        hessian = basis.T @ (basis * (n * p * (1 - p))[:, None]) + np.diag(lean)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    return float(max(beta[0], 1e-2)), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 10_000, least: int = 6, odds: float = 2.0, most_terms: int = 20_000, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon with weights and curve from labelled rows that are not held out.

    most_rows: rows of each label to learn from, about. Without rows of both labels
    the insults keep their prior weights and the curve its default.
    """
    rows = materialize(training_rows(docs, labels, most_rows), "labelled")
    kinds = {r["label"] for r in rows.select("label").distinct().collect()}
    plain = {f" {w} ": PRIOR for w in INSULTS}
    if kinds != {0, 1}:
        return Lexicon(plain, exceptions)
    counts, total = term_counts(rows, least, most_terms)
    model = Lexicon(choose_terms(counts, total, None, least, odds), exceptions)
    width = 0.02
    by_fold = [Lexicon(choose_terms(counts, total, f, least, odds), exceptions) for f in range(FOLDS)]
    bins = rows.mapInArrow(_binned(by_fold, width), "bin long, label int").groupBy("bin", "label").count().collect()
    x, y, n = (np.array(c, float) for c in zip(*((r["bin"] * width, r["label"], r["count"]) for r in bins), strict=True))
    model.slope, model.offset = fit_curve(x, y, n)
    return model


# ---- scoring

SCHEMA = "doc_id long, score double, predicted int, n_words long, n_terms long"


def _scored(model: Lexicon, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_model(None)
        for batch in batches:
            found = [model.measure(text) for texts in slices(batch.column("text")) for text in texts]
            score = model.score(np.array([density(n, w) for n, _, w in found], float))
            columns = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([n for n, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [f.split()[0] for f in SCHEMA.split(", ")])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, model: Lexicon | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, n_terms of every row, from its text alone.

    Null and empty texts have no words and the score of a text without terms.
    Repeated rows are scored each, equally; a null doc_id is held out; further
    columns are ignored, whatever their names; an empty table gives none. model: a
    trained lexicon, else one is trained on the labels.
    """
    model = model or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(model, threshold), SCHEMA).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_words", "n_terms")
