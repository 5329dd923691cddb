"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

The vocabularies used here cut a text into words by a fixed pattern before any
merge, and merge within a word alone. Texts whose characters are all printable
ASCII, white space or Latin letters are cut by that pattern here, each distinct
word is encoded once by the library's model, and the ids of a text are those of its
words in order. All other texts are encoded whole by the library. The bytes of many
texts are cut together, and their words numbered by Arrow, so that Python meets each
distinct word of a slice once, not every word.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tallywright.llm.common import worker_model

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that a generation of cached words may take; two are kept.
CACHE_BYTES = 48_000_000
#: Bytes of a cached word besides its characters and ids.
_ENTRY = 190
#: Texts without such characters are cut here. Their letters have one lower-case form and no composition.
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-įı-ɏ]")
#: Stands between texts that are cut together; no text with it is cut here.
_GAP = b"\0"
# Kinds of bytes in texts without _OTHER; all bytes of a letter beyond ASCII are letters.
_NONE, _SPACE, _BREAK, _LETTER, _DIGIT, _MARK = range(6)
_KINDS = np.full(256, _LETTER, np.uint8)
_KINDS[:0x41] = _KINDS[0x5B:0x61] = _KINDS[0x7B:0x80] = _MARK
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[[0x09, 0x0A, 0x0D]] = _BREAK
_KINDS[0x20] = _SPACE
_KINDS[0] = _NONE
_PROBE = "It's a  Test-case,\n\n'tis 1984 o'clock!! \t don't''ve Émile x <|endoftext|> a_b ...ß 'S"


def word_starts(data: np.ndarray, keeps_space: bool) -> np.ndarray:
    """The places where words start in the bytes of texts without _OTHER, a gap before and after each.

    A gap is a word of its own. The words are those of the two public vocabularies:
    with keeps_space ``?L+ | ?[0-9]+ | endings | ?marks+ | white space``, where of
    white space before a word the last is left to it or stands alone; otherwise
    ``L+ | [0-9] | endings | marks+`` and each stretch of white space. Endings are
    's, 't, 'm, 'd, 're, 've and 'll where no mark stands before them.
    """
    kinds = _KINDS[data]
    before, here = kinds[:-1], kinds[1:]
    white = (kinds == _SPACE) | (kinds == _BREAK)
    starts = kinds == _NONE
    if keeps_space:
        last = white[1:] & white[:-1]
        last[:-1] &= kinds[2:] > _BREAK
        last[-1:] = False
        starts[1:] |= ~white[1:] & (here != before) & (before != _SPACE) | white[1:] & ~white[:-1] | last
    else:
        starts[1:] |= (here != before) & ~(white[1:] & white[:-1]) | (here == _DIGIT)
    at = np.flatnonzero((data == ord("'")) & starts)
    one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (two == ord("e")) & ((one == ord("r")) | (one == ord("v"))) | (one == ord("l")) & (two == ord("l"))
    starts[at[short | long] + 1] = False
    starts[at[short] + 2] = True
    starts[at[long] + 3] = True
    return np.flatnonzero(starts)


def _values(words: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls; its own to_pylist makes an object more for each."""
    _, places, data = words.buffers()
    at, data = np.frombuffer(places, np.int64, len(words) + 1, 8 * words.offset).tolist(), memoryview(data).tobytes()
    return [data[a:b] for a, b in pairwise(at)]


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keeps_space = keeps_space
        self.to_bytes = normalizers.ByteLevel().normalize_str
        self.young: dict[bytes, bytes] = {_GAP: b""}
        self.old: dict[bytes, bytes] = {}
        self.weight = 0
        self.cuts = self._whole([_PROBE]) == self._cut([_PROBE])  # else this vocabulary has other words

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word by the model alone; words here hold no zero byte."""
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in self.to_bytes(_GAP.join(words).decode()).split("Ā")]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words; words not met for a generation are forgotten."""
        if self.weight > CACHE_BYTES:
            self.old, self.young, self.weight = self.young, {_GAP: b""}, 0
        found = list(map(self.young.get, words))
        unknown = [w for w, x in zip(words, found, strict=True) if x is None]
        new = dict(zip(unknown, map(self.old.get, unknown), strict=True))
        if not self.keeps_space:
            new.update((w, b"") for w in unknown if w.isspace())
        missing = [w for w, x in new.items() if x is None]
        if missing:
            new.update(zip(missing, self._encode_words(missing), strict=True))
        self.young.update(new)
        self.weight += sum(map(len, new)) + sum(map(len, new.values())) + _ENTRY * len(new)
        added = iter(new.values())
        return [next(added) if x is None else x for x in found]

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts without _OTHER: each distinct word is looked up once."""
        whole = "\0".join(["", *texts, ""])
        data = (whole if self.keeps_space else whole.lower()).encode()
        places = np.append(word_starts(np.frombuffer(data, np.uint8), self.keeps_space), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(data)]).dictionary_encode()
        found, codes = self._ids_of(_values(words.dictionary)), words.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts, counts = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(found), "<u4")[np.repeat(firsts[codes] - ends + counts, counts) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[codes == codes[0]]).tolist()  # the first word is a gap
        return [ids[a:b] for a, b in pairwise(bounds)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; an empty text has none."""
        cut = [self.cuts and not _OTHER.search(text) for text in texts]
        by_words = iter(self._cut([text for text, c in zip(texts, cut, strict=True) if c]))
        whole = iter(self._whole([text for text, c in zip(texts, cut, strict=True) if not c]))
        return [next(by_words if c else whole) for c in cut]


def encoder(path: str, keeps_space: bool) -> WordEncoder:
    """This worker's encoder for a vocabulary file.

    keeps_space: the vocabulary's words carry the space before them (byte-level
    BPE); otherwise white space is dropped and letters are taken in lower case.
    """
    return worker_model(("words", path, keeps_space), lambda: WordEncoder(path, keeps_space))


def slices(texts, size: int = 1_000_000):
    """Lists of consecutive values of an Arrow string column, nulls as empty texts, each of about so many bytes or one text."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
