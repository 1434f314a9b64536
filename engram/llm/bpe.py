"""Byte-level BPE encoding and decoding from a rank file.

Two tiers. A minimal perfect hash over the vocabulary (every slot used, one probe, one comparison of bytes)
resolves pre-tokens that are tokens as a whole. Misses are merged: bytes are linked in a list and a heap
gives the adjacent pair of least rank, so a pre-token of n bytes takes O(n log n). Each worker remembers the
ids of short pre-tokens in a table of bounded size. Texts whose pattern is the byte-level one are cut into pieces first
(`engram.llm.pieces`), so each distinct piece of a chunk of texts is looked up once. Letters and numbers are what the
libraries' Unicode has as such.

The rank file is read on the driver and broadcast (50 thousand entries, under 2 MB). Nothing is shuffled.
Nulls are empty texts: no ids, the digests of no bytes. Very long texts are encoded whole, one at a time; a pre-token
beyond `MEMO_LETTERS` isn't remembered for itself. Of pairs that tie in rank the leftmost merges first. Repeated rows each get their
result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import worker_state
from engram.llm.pieces import BYTE_LEVEL, PieceEncoder, WholeTexts, bounded

MEMO_ENTRIES = 50_000  # some 200 bytes each
PIECE_BYTES = 48 << 20
MEMO_LETTERS = 48
_STEP, _ODD, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class MinimalPerfectHash:
    """n keys on n slots: a bucket's displacement sends each of its keys to a slot of its own.

    Buckets of several keys try displacements, largest buckets first; a bucket of one key points at a free slot.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4, tries: int = 1 << 20) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, n // per_bucket)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64) if n else np.zeros(0, np.uint64)
        which = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(self.buckets + 1))
        free = np.ones(n, bool)
        shift = np.zeros(self.buckets, np.int64)
        sizes = np.diff(bounds)
        singles = []
        for bucket in np.argsort(-sizes, kind="stable").tolist():
            own = order[bounds[bucket] : bounds[bucket + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((bucket, int(own[0])))
                continue
            for start in range(0, tries, 512):
                d = np.arange(start, start + 512, dtype=np.uint64)
                slots = self._spread(h[own][None, :] ^ (d[:, None] * np.uint64(_STEP)))
                good = free[slots].all(axis=1)
                for i in np.flatnonzero(good).tolist():
                    if len(set(slots[i].tolist())) == len(own):
                        free[slots[i]] = False
                        shift[bucket] = start + i
                        break
                else:
                    continue
                break
            else:
                raise ValueError("no displacement found; keys must differ")
        for (bucket, _), slot in zip(singles, np.flatnonzero(free).tolist(), strict=False):
            shift[bucket] = -slot - 1
        self.shift = shift.tolist()

    def _spread(self, x):
        if isinstance(x, int):
            return ((x * _ODD & _MASK) >> 32) * self.n >> 32
        return ((x * np.uint64(_ODD)) >> np.uint64(32)) * np.uint64(self.n) >> np.uint64(32)

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._spread(h ^ (d * _STEP & _MASK))


class Vocabulary:
    """What workers need, in a form that is cheap to ship."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.ranks = ranks
        self.hash = MinimalPerfectHash(list(ranks))
        self.keys: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)
        for token, rank in ranks.items():
            slot = self.hash.slot(token)
            self.keys[slot], self.ids[slot] = token, rank

    def whole(self, token: bytes) -> int | None:
        """The id of a token of the vocabulary, else None."""
        if not self.keys:
            return None
        slot = self.hash.slot(token)
        return self.ids[slot] if self.keys[slot] == token else None


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merges, least rank first and leftmost among equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    left = list(range(-1, n - 1))
    alive = [True] * n + [False]
    heap = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 1, i + 2))
    heapq.heapify(heap)
    while heap:
        rank, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or not alive[mid] or end[mid] != stop:
            continue  # a part has changed meanwhile
        end[i] = stop
        alive[mid] = False
        if stop < n:
            left[stop] = i
            after = ranks.get(piece[i : end[stop]])
            if after is not None:
                heapq.heappush(heap, (after, i, stop, end[stop]))
        if left[i] >= 0:
            before = ranks.get(piece[left[i] : stop])
            if before is not None:
                heapq.heappush(heap, (before, left[i], i, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token -> its ids; remembers short ones."""

    def __init__(self, vocabulary: Vocabulary, entries: int = MEMO_ENTRIES) -> None:
        super().__init__()
        self.v, self.entries = vocabulary, entries
        self.find = regex.compile(bounded(vocabulary.pattern)).findall
        self.pieces = PieceEncoder(self._all, key_bytes=PIECE_BYTES) if vocabulary.pattern == BYTE_LEVEL else WholeTexts(self._all)
        tokens = [b""] * (max(vocabulary.ranks.values(), default=-1) + 1)
        for token, rank in vocabulary.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        self.lengths = np.diff(self.ends, prepend=0)

    def __missing__(self, token: str) -> list[int]:
        raw = token.encode("utf-8", "replace")
        one = self.v.whole(raw)
        ids = [one] if one is not None else merge(raw, self.v.ranks)
        if len(token) <= MEMO_LETTERS:
            if len(self) >= self.entries:
                self.clear()
            self[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        return [i for token in self.find(text) for i in self[token]] if text else []

    def _all(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.encode(p.decode("utf-8", "replace")) for p in pieces]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column, as 32-bit little-endian numbers."""
        for i, j, ids, at in self.pieces.texts(column):
            ids = ids.astype("<u4")
            yield from (ids[at[k] : at[k + 1]] for k in range(j - i))

    def decode(self, ids: np.ndarray, step: int = 1 << 16) -> bytes:
        out = []
        for i in range(0, len(ids), step):  # so many at once, as a place for each byte is held
            part = ids[i : i + step].astype(np.int64)
            n = self.lengths[part]
            stops = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.ends[part] - stops, n) + np.arange(stops[-1])].tobytes())
        return b"".join(out)


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(path), pattern)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _mapped(frame: DataFrame, vocabulary: Vocabulary, schema: str, rows) -> DataFrame:
    """mapInArrow over (doc_id, text or ids); `rows(encoder, column)` gives the other columns of each row."""
    shared, key = frame.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex

    def run(batches):
        encoder, fields = worker_state(("bpe", key), lambda: Encoder(shared.value)), [c.split() for c in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = zip(*rows(encoder, part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, _KINDS[k]) for c, (_, k) in zip(out, fields[1:], strict=True))], names=[name for name, _ in fields])

    return frame.select(F.col("doc_id").cast("long").alias("doc_id"), frame.columns[1]).mapInArrow(run, schema)


def encode_texts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text -> doc_id, ids array<int>."""
    return _mapped(documents.select("doc_id", "text"), vocabulary, "doc_id long, ids array<int>", lambda e, texts: ((ids.astype(np.int32),) for ids in e.texts(texts)))


def decode_ids(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids array<int> -> doc_id, content binary."""
    return _mapped(encoded.select("doc_id", "ids"), vocabulary, "doc_id long, content binary", lambda e, column: ((e.decode(np.array(ids.as_py() or [], np.int64)),) for ids in column))


def _digests(e: Encoder, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(e.decode(ids)).hexdigest()


def round_trip(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Encodes, decodes the ids, and gives the digests of both."""
    return _mapped(documents.select("doc_id", "text"), vocabulary, OUT, lambda e, texts: (_digests(e, ids) for ids in e.texts(texts)))


def encoded_round_trip(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """As `round_trip`, with the ids: doc_id, ids, n_tokens and both digests."""
    schema = "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(documents.select("doc_id", "text"), vocabulary, schema, lambda e, texts: ((ids.astype(np.int32), *_digests(e, ids)) for ids in e.texts(texts)))


def production_vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return load_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return round_trip(table(spark, sf_dir, "documents"), production_vocabulary())
