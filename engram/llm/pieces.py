"""Texts to token ids by distinct pieces, for tokenizers that split with the byte-level pattern.

A piece is a run of bytes between two places where that pattern always splits, whatever stands around: before white
space that follows something else, and between ASCII letters, digits and punctuation. Pieces so are encoded apart. They
are found on UTF-8 bytes with numpy, told apart exactly by Arrow's hash table, and only the distinct ones of a chunk of
texts are looked up; what a worker has met before it doesn't encode again. Nothing here decides how a piece is encoded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from engram.llm.textscan import chunks

CHUNK = 2 << 20
KEY_BYTES = 96 << 20
KEY_EXTRA = 140  # bytes that a remembered piece takes besides its own: object, place in the table, number
IDS = 6 << 20

#: Code points that the installed `regex` calls letters or numbers and the tokenizer libraries (Unicode 16)
#: don't know; a test compares every code point.
LATER = (
    r"՘֋-֌࢏౜೜₏₝-₟꟎-꟏꟒꟔꟝꟢꟱꭬-꭭"
    r"\U000107BB-\U000107BF\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB"
    r"\U00011DE0-\U00011DE9\U00011DF1\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8"
    r"\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20"
    r"\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2\U0001B123-\U0001B128\U0001B168\U0001D6A6"
    r"\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF\U0001E6C0-\U0001E6DE"
    r"\U0001E6E0-\U0001E6E2\U0001E6E4-\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE-\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD\U000323B0-\U00033479\U0003D000-\U0003FC3F"
)

#: The byte-level pattern, as the library's pre-tokenizer has it and as rank files of its kind name it.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _WIDE = 1, 2, 3, 4, 5, 6
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = _SPACE
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = _LETTER
_KIND[0x27] = _APOSTROPHE
_KIND[0x80:] = _WIDE

#: Whether the pattern always splits between two bytes of these kinds. Nothing is said of control characters, nor of what
#: follows an apostrophe (contractions) or white space (which the next word takes in).
_ALWAYS = np.zeros((7, 7), bool)
_ALWAYS[[_LETTER, _DIGIT, _MARK, _APOSTROPHE, _WIDE], _SPACE] = True
_FINE = _ALWAYS.copy()
for _a in (_LETTER, _DIGIT, _MARK):
    for _b in (_LETTER, _DIGIT, _MARK):
        _FINE[_a, _b] = _a != _b
_FINE[[_LETTER, _DIGIT], _APOSTROPHE] = True


def bounded(pattern: str) -> str:
    """The pattern with letters and numbers as the tokenizer libraries know them."""
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{LATER}]]")
    return "(?V1)" + pattern


def cuts(b: np.ndarray, offsets: np.ndarray, fine: bool) -> np.ndarray:
    """Ascending byte positions where pieces of the rows `b[offsets[i]:offsets[i + 1]]` begin, and the end."""
    kind = _KIND[b]
    begins = np.zeros(len(b) + 1, bool)
    np.take((_FINE if fine else _ALWAYS).ravel(), kind[:-1] * np.uint8(7) + kind[1:], out=begins[1:-1])
    after = np.flatnonzero(begins[1:-1] & (kind[:-1] == _WIDE)) + 1
    if len(after):  # no split after what may be white space beyond ASCII
        second, third = b[after - 2], b[np.maximum(after - 3, 0)]
        maybe = (second == 0xC2) | ((third >= 0xE1) & (third <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A)))
        begins[after[maybe]] = False
    begins[offsets] = True
    return np.flatnonzero(begins)


def distinct_pieces(b: np.ndarray, offsets: np.ndarray, specials: Sequence[bytes] = ()) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Where pieces begin (and the end), and the pieces as codes of distinct ones. Texts that may hold one of `specials`
    (strings that a tokenizer takes out before it splits) are cut at white space only, so none is cut."""
    fine = not specials or not any(x in b.tobytes() for x in specials)
    bounds = cuts(b, offsets, fine)
    values = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(b))])
    return bounds, values.dictionary_encode()


class PieceEncoder:
    """Encodes texts piece by piece. `encode`: distinct pieces as bytes -> the ids of each.

    What it remembers is bounded by `key_bytes` (`KEY_BYTES` by default) of memory for the pieces and `IDS`; beyond, it begins anew.
    """

    def __init__(self, encode: Callable[[list[bytes]], Sequence[Sequence[int]]], specials: Sequence[bytes] = (), key_bytes: int | None = None) -> None:
        self.encode, self.specials, self.most = encode, tuple(specials), key_bytes
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.key_bytes = self.n_ids = 0
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 12, np.int64)

    def _slots(self, distinct: list[bytes]) -> np.ndarray:
        """Where each piece's ids are: number i has ids[ends[i - 1]:ends[i]]; number 0 has none."""
        slots = list(map(self.known.get, distinct))
        fresh = [i for i, x in enumerate(slots) if x is None]
        if fresh:
            pieces = [distinct[i] for i in fresh]
            made = self.encode(pieces)
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            flat = np.concatenate([np.asarray(x, np.uint32) for x in made])
            first = len(self.known) + 1
            if first + len(made) > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(made)), np.int64)])
            if self.n_ids + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
            self.ends[first : first + len(made)] = self.n_ids + np.cumsum(lengths)
            self.ids[self.n_ids : self.n_ids + len(flat)] = flat
            self.n_ids += len(flat)
            self.key_bytes += sum(map(len, pieces)) + KEY_EXTRA * len(pieces)
            for k, (i, piece) in enumerate(zip(fresh, pieces, strict=True)):
                slots[i] = self.known[piece] = first + k
        return np.array(slots, np.int64)

    def _rows(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(b) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        bounds, told = distinct_pieces(b, offsets, self.specials)
        slots = self._slots(told.dictionary.to_pylist())[told.indices.to_numpy()]
        starts = self.ends[slots - 1]
        lengths = self.ends[slots] - starts
        total = np.concatenate([[0], np.cumsum(lengths)])
        return starts, lengths, total[np.searchsorted(bounds, offsets)]

    def _gather(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.cumsum(lengths)
        n = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(n)] if n else np.zeros(0, np.uint32)

    def texts(self, column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows: first, end, the ids of all of them, and where each row's begin (and end). Nulls are empty."""
        for i, j, b, offsets in chunks(column, limit):
            starts, lengths, total = self._rows(b, offsets)
            yield i, j, self._gather(starts, lengths), total
            self._trim()

    def _trim(self) -> None:
        if self.key_bytes > (self.most or KEY_BYTES) or self.n_ids > IDS:
            self._forget()


def library_encoder(config: str):
    """Bytes of many texts -> ids, by the tokenizers library; whether texts may be cut in pieces; special strings."""
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    library = Tokenizer.from_str(config)
    library.no_truncation()
    library.no_padding()
    spec = json.loads(config)
    split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    apart = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer") and not spec["model"].get("dropout")
    apart = apart and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(c.isspace() for c in t["content"]) for t in added)

    def encode(texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    return encode, apart, [t["content"].encode() for t in added]


class WholeTexts:
    """As `PieceEncoder`, for tokenizers whose texts can't be cut: the library takes each text whole."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def texts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for i, text in enumerate(column):
            ids = np.array(self.encode([(text.as_py() or "").encode()])[0], np.uint32)
            yield i, i + 1, ids, np.array([0, len(ids)])
