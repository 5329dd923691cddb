"""Quality classifier: regularised quadratic discriminant over document statistics.

Each document gives a vector of transformed statistics. Per class, the mean and the
covariance are estimated from sums gathered on Spark; covariances are shrunk towards
the pooled covariance and its diagonal. The score compares Mahalanobis log-densities
under cached Cholesky factors, mapped to 0..1 by a logistic curve that is fitted to
a histogram of the training rows' differences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import materialize, worker_model
from tallywright.llm.tokens import slices

STATISTICS = (
    "log_chars", "letters", "upper", "digits", "blank", "line_ends", "sentence_ends", "commas", "bangs", "pipes", "marks", "wide",
    "word_length", "long_words", "distinct_words", "top_word", "distinct_lines", "line_length", "capital_words", "marked_words",
)
_CLASSES = np.zeros(256, np.int64)
for _number, _bytes in enumerate(
    (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b".?", b",;:", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1
):
    _CLASSES[list(_bytes)] = _number
_CLASSES[128:] = 11


def statistics(text: str) -> list[float]:
    """The transformed statistics of a whole text; an empty one gives zeros."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by_byte = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASSES, weights=by_byte, minlength=12)
    n = len(data)
    lower, upper, digits, blank, ends, stops, commas, bangs, pipes, marks, wide = kinds[1:12]
    words = text.split()
    lines = text.split("\n")
    n_words = max(1, len(words))
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    share = lambda x: float(np.log1p(100.0 * x / n))
    return [
        float(np.log1p(n)), (lower + upper + wide) / n, share(upper), share(digits), blank / n, share(ends), share(stops), share(commas), share(bangs), share(pipes), share(marks), share(wide),
        float(np.log1p(lengths.mean())), float((lengths > 20).mean()), len(counts) / n_words, float(np.log1p(100.0 * max(counts.values(), default=0) / n_words)),
        len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        sum(map(str.isupper, counts)) / max(1, len(counts)), sum(not w[-1].isalnum() and w[-1] not in ".,?;:" for w in counts) / max(1, len(counts)),
    ]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_model(None)
    for batch in batches:
        rows = pa.array([statistics(text) for texts in slices(batch.column("text")) for text in texts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), rows], ["doc_id", "row_hash", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash, x: the statistics of every row, written once."""
    coded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_hash"), "text").mapInArrow(
        _vectors, "doc_id long, row_hash long, x array<double>"
    )
    return materialize(coded, "statistics")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 4 is 2; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors, log determinants, and the logistic curve of the score."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density under class 1 less that under class 0, damped so that far tails stay apart."""
        d = [((x - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
        raw = 0.5 * ((d[0] ** 2).sum(1) - (d[1] ** 2).sum(1) + self.logdets[0] - self.logdets[1])
        return np.sign(raw) * np.log1p(np.abs(raw))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.difference(x) + self.offset, -30, 30)))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(STATISTICS)
    n, s, q = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
    for batch in batches:
        x = np.asarray(batch.column("x").flatten()).reshape(-1, k)
        y = np.asarray(batch.column("quality"), np.int64)
        for label in (0, 1):
            part = x[y == label]
            n[label] += len(part)
            s[label] += part.sum(0)
            q[label] += part.T @ part
    yield pa.RecordBatch.from_arrays(
        [pa.array([0, 1], pa.int32()), pa.array(n), pa.array(list(s)), pa.array([m.reshape(-1) for m in q])], ["label", "n", "s", "q"]
    )


def _solve(n: np.ndarray, s: np.ndarray, q: np.ndarray, to_pooled: float, to_diagonal: float) -> Discriminant:
    means = s / np.maximum(n, 1)[:, None]
    scatter = [q[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (scatter[0] + scatter[1]) / max(1.0, n.sum() - 2)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6))
    factors, logdets = [], []
    for c in (0, 1):
        # fewer rows: closer to the pooled covariance
        weight = (to_pooled * 1000 + 2 * len(pooled)) / (to_pooled * 1000 + 2 * len(pooled) + n[c])
        cov = (1 - weight) * scatter[c] / max(1.0, n[c] - 1) + weight * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * floor
        chol = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov)))
        factors.append(np.linalg.inv(chol))
        logdets.append(2 * np.log(np.diag(chol)).sum())
    return Discriminant(means, np.array(factors), np.array(logdets))


def _binned(model: Discriminant, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            bins = np.floor(model.difference(x) / width).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("quality")], ["bin", "quality"])

    return run


def _calibrate(bins: list[tuple[float, int, int]], prior: float = 1.0) -> tuple[float, float]:
    """Slope and offset of a logistic curve through (difference, label, count), by damped Newton steps."""
    d, y, w = (np.array(c, float) for c in zip(*bins, strict=True))
    beta = np.array([1.0, 0.0])
    basis = np.stack([d, np.ones_like(d)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(basis @ beta, -30, 30)))
        gradient = basis.T @ (w * (y - p)) - prior * (beta - [1.0, 0.0])
        hessian = basis.T @ (basis * (w * p * (1 - p))[:, None]) + prior * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(features: DataFrame, labels: DataFrame, to_pooled: float = 0.05, to_diagonal: float = 0.05) -> Discriminant | None:
    """Fit on the labelled rows that are not held out; None without rows of both labels.

    All labelled rows count; only their sums (a few hundred numbers for each task)
    and a histogram of differences reach the driver. Labels other than 0 and 1,
    and null ids, are ignored; of several labels of one doc_id the smallest counts.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    rows = materialize(features.where(~held_out()).join(marks, "doc_id").select("x", "quality"), "training")
    k = len(STATISTICS)
    parts = rows.mapInArrow(_sums, "label int, n double, s array<double>, q array<double>")
    cells = parts.select("label", "n", F.posexplode(F.concat("s", "q")).alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    sums = {(r["label"], r["at"]): r["v"] for r in cells.collect()}  # 2 * (k + k * k) numbers
    counts = {r["label"]: r["n"] for r in parts.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    n = np.array([counts.get(c) or 0.0 for c in (0, 1)])
    if not n.all():
        return None
    whole = np.array([[sums[c, i] for i in range(k + k * k)] for c in (0, 1)])
    model = _solve(n, whole[:, :k], whole[:, k:].reshape(2, k, k), to_pooled, to_diagonal)
    width = 0.05
    bins = rows.mapInArrow(_binned(model, width), "bin long, quality int").groupBy("bin", "quality").count().collect()
    model.slope, model.offset = _calibrate([((r["bin"] + 0.5) * width, r["quality"], r["count"]) for r in bins])
    return model


def _scored(model: Discriminant | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(STATISTICS))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_hash"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "row_hash", "score", "predicted"]
            )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, row_hash, held_out, score, predicted of every row.

    Null texts count as empty; empty texts are scored as vectors of zeros. Without
    training rows of both labels every score is 0.5. Scores use the text alone.
    Repeated rows are scored each, with equal scores. A null doc_id is held out.
    Further columns are ignored, whatever their names. An empty table gives none.
    """
    features = vectors(docs)
    model = train(features, labels)
    scored = features.mapInArrow(_scored(model, threshold), "doc_id long, row_hash long, score double, predicted int")
    return scored.select("doc_id", "row_hash", held_out().alias("held_out"), "score", "predicted")


def _kept(model: Discriminant | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model and batch.num_rows:
                x = np.array([statistics(text) for texts in slices(batch.column("text")) for text in texts])
                batch = batch.filter(pa.array(model.score(x) >= threshold))
            yield batch

    return run


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold.

    Rows keep their place: texts are scored where they are read and never shuffled.
    Without training rows of both labels every row stays.
    """
    model = train(vectors(docs), labels)
    return docs.mapInArrow(_kept(model, threshold), docs.schema)
