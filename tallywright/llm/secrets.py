"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

Random strings compress badly under a vocabulary made from natural text: they give
few characters per token. Candidate runs of key-like characters are measured under
a tiktoken vocabulary, and those below a ratio are reported, unless they are known
digests (hex of a digest's length), UUIDs, or parts joined by separators that all
reach the ratio. Separators count neither as characters nor as tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.common import worker_model
from tallywright.llm.tokens import slices

KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"[0-9a-fA-F]+")
_SEPARATORS = re.compile(r"[+/_=-]+")
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: Longest run whose tokens are counted at once; longer runs are measured in pieces of this length.
PIECE = 4096


def _encoding(path: str):
    def load():
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return worker_model(("ranks", path), load)


def is_identifier(run: str) -> bool:
    """UUIDs and known digests."""
    return bool(_UUID.fullmatch(run) or (_DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS))


def characters_per_token(run: str, path: str) -> float:
    """Characters of a run divided by its tokens."""
    encoding = _encoding(path)
    tokens = sum(len(encoding.encode_ordinary(run[at : at + PIECE])) for at in range(0, len(run), PIECE))
    return len(run) / max(1, tokens)


def is_opaque(run: str, path: str, ratio: float) -> bool:
    """A run of few characters per token; its separators are left out, and parts that all read like words are names."""
    parts = [p for p in _SEPARATORS.split(run) if p]
    if is_identifier(run) or all(characters_per_token(p, path) >= ratio for p in parts):
        return False
    return characters_per_token("".join(parts), path) < ratio


def scan(text: str, path: str, ratio: float = 2.2) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, by start, then kind; places in code points."""
    spans = []
    folded = text.lower()
    if ("=" in text or ":" in text) and any(w in folded for w in _ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    spans += [(m.start(), 3, m.end()) for m in _RUN.finditer(text) if is_opaque(m[0], path, ratio)]
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced by a mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scanned(path: str, ratio: float, mark: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            nulls = iter(batch.column("text").is_null().to_pylist())
            for text in (t for texts in slices(batch.column("text")) for t in texts):
                spans = scan(text, path, ratio) if text else []
                text = None if next(nulls) else text
                base = [s for s in spans if s[1] < 3]
                counts = [sum(s[1] == kind for s in base) for kind in range(3)]
                row = (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans))
                rows.append(row if mark is None else (*row, redact(text, spans, mark) if spans else text))
            kinds = [pa.int64()] * 3 + [pa.string()] * (2 if mark is None else 3)
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"] + ([] if mark is None else ["redacted"])
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *found], [*kept, *names])

    return run


def scan_secrets(docs: DataFrame, vocabulary_path: str, ratio: float = 2.2, mark: str | None = None) -> DataFrame:
    """Secrets of each text, whole, one row per row.

    docs: text and any further columns, which stay, null ids and repeated rows too.
    Null and empty texts have no spans. The columns added are n_assign, n_access,
    n_hex, base_sha256 and spans, in place of columns of docs that have one of these
    names. With ``mark``, a column ``redacted`` holds the text with each span
    replaced (null stays null). An empty table gives an empty result.
    """
    own = {"n_assign", "n_access", "n_hex", "base_sha256", "spans", *(["redacted"] if mark is not None else [])}
    kept = [f for f in docs.schema.fields if f.name != "text" and f.name.lower() not in own]
    schema = docs.select(*[f.name for f in kept]).schema
    for name in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(name, "long")
    for name in ("base_sha256", "spans", *(["redacted"] if mark is not None else [])):
        schema = schema.add(name, "string")
    return docs.select(*[F.col(f.name) for f in kept], "text").mapInArrow(_scanned(vocabulary_path, ratio, mark), schema)
