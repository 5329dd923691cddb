"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each block has binary features of its ancestors' tags and names and of its text.
The field has a weight for each feature and label and for each pair of neighbouring
labels. It is trained on labelled pages by gradient ascent on the regularised
log-likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.html_blocks import FEATURES, blocks, labelled_pages
from tallywright.llm.tokens import slices

#: Pages of the labelled sample that the field is trained on.
TRAINING_PAGES = 400


@dataclass
class Field:
    """weights: (features, 2); moves: (2, 2) from a label to the next."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: list[list[int]]) -> list[int]:
        """The likeliest labels of a page's blocks."""
        if not features:
            return []
        flat = np.concatenate([np.asarray(f) for f in features])
        starts = np.cumsum([0, *(len(f) for f in features[:-1])])
        scores = np.add.reduceat(self.weights[flat], starts, axis=0).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            from0, from1 = a + m00 < b + m10, a + m01 < b + m11
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        labels = [int(b > a)]
        for pointers in reversed(back):
            labels.append(int(pointers[labels[-1]]))
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 150, penalty: float = 1e-3) -> Field:
    """Fit the field to (page, labels), a bounded sample, by Adam on the log-likelihood."""
    rows = [([f for _, f in blocks(page)], labels) for page, labels in pages]
    rows = [r for r in rows if r[0]]
    longest, k = max(len(f) for f, _ in rows), len(FEATURES)
    x = np.zeros((len(rows), longest, k))
    y = np.zeros((len(rows), longest), np.int64)
    here = np.zeros((len(rows), longest), bool)
    for i, (features, labels) in enumerate(rows):
        for t, found in enumerate(features):
            x[i, t, found] = 1
        y[i, : len(labels)] = labels
        here[i, : len(labels)] = True
    target = np.eye(2)[y] * here[..., None]
    pairs = target[:, :-1, :, None] * target[:, 1:, None, :]
    seen, seen_pairs = np.einsum("itk,itl->kl", x, target), pairs.sum((0, 1))
    theta, m1, m2 = np.zeros(k * 2 + 4), np.zeros(k * 2 + 4), np.zeros(k * 2 + 4)
    for step in range(1, rounds + 1):
        weights, moves = theta[: k * 2].reshape(k, 2), theta[k * 2 :].reshape(2, 2)
        scores = x @ weights
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        forward[:, 0] = scores[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.where(here[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + scores[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            onward = np.logaddexp.reduce(moves + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(here[:, t + 1, None], onward, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)[:, None, None]
        node = np.exp(forward + backward - total) * here[..., None]
        edge = np.exp(forward[:, :-1, :, None] + moves + (scores + backward)[:, 1:, None, :] - total[..., None]) * here[:, 1:, None, None]
        gradient = np.concatenate([(seen - np.einsum("itk,itl->kl", x, node)).reshape(-1), (seen_pairs - edge.sum((0, 1))).reshape(-1)]) / here.sum() - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        theta = theta + 0.1 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Field(theta[: k * 2].reshape(k, 2), theta[k * 2 :].reshape(2, 2))


@cache
def default_field(pages: int = TRAINING_PAGES) -> Field:
    """The field trained on labelled pages made by rule."""
    return train(labelled_pages(pages))


def main_text(page: str, field: Field) -> str:
    """The blocks that the field labels as main text, one to a line."""
    found = blocks(page)
    return "\n".join(text for (text, _), label in zip(found, field.decode([f for _, f in found]), strict=True) if label)


def _extracted(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, field) if page else "" for pages in slices(batch.column("html")) for page in pages]
            kept = [n for n in batch.schema.names if n != "html"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"]
            )

    return run


def extract_main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Pages without main text, null or empty, have an empty text. Null ids and urls
    stay, repeated rows give equal rows, further columns are ignored, whatever
    their names, and an empty table gives an empty result. The time is linear in
    the length of a page, whatever its nesting.
    """
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return pages.select("page_id", "url", F.col("html")).mapInArrow(_extracted(field or default_field()), schema)
