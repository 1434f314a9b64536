"""Token counts of a tokenizer file, map-side, without shuffling pre-tokens.

Texts are cut into pieces that the tokenizer surely encodes apart (`engram.llm.pieces`), and the distinct pieces of a chunk
of texts are looked up once each. Tier one: a compact hash table of the lengths (in tokens) of frequent ones. A byte-pair
vocabulary is the list of the most frequent pre-tokens and parts of the text it comes from, so the table is made of its entries
that are pieces as a whole: it needs no pass over the corpus, is the same for every corpus, and the vocabulary bounds it (50
thousand entries of at most `LETTERS` bytes; two Arrow arrays, under 1 MB as broadcast). Tier two: other pieces are encoded
by the library itself and remembered in a bounded cache of the worker, which so learns what else is frequent in the texts
it sees. Lengths are the library's in both tiers.

Nulls are empty texts (0 bytes, 0 tokens). Very long texts are split whole, one at a time. Repeated rows each get their
result; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.pieces import CHUNK, WholeTexts, cuts, distinct_pieces, library_encoder
from engram.llm.textscan import chunks

CACHE_ENTRIES = 600_000
LETTERS = 48
OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    """Counts tokens of texts. `keys` and `lengths`: tier one, which stays as it is."""

    def __init__(self, config: str, keys: pa.Array, lengths: np.ndarray, entries: int = CACHE_ENTRIES) -> None:
        self.encode, self.apart, self.specials = library_encoder(config)
        self.keys, self.lengths, self.entries = keys, lengths, entries
        self.cache: dict[bytes, int] = {}

    def _cached(self, pieces: list[bytes]) -> list[int]:
        """Tier two: numbers of tokens by the library; begins anew when full."""
        known = list(map(self.cache.get, pieces))
        fresh = [i for i, n in enumerate(known) if n is None]
        if fresh:
            if len(self.cache) + len(fresh) > self.entries:
                self.cache.clear()
            for i, ids in zip(fresh, self.encode([pieces[i] for i in fresh]), strict=True):
                known[i] = len(ids)
                if len(pieces[i]) <= LETTERS:
                    self.cache[pieces[i]] = len(ids)
        return known

    def _lengths(self, distinct: pa.Array) -> np.ndarray:
        at = pc.index_in(distinct, value_set=self.keys)
        missed = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        out = self.lengths[at.fill_null(0).to_numpy()].astype(np.int64) if len(self.keys) else np.zeros(len(distinct), np.int64)
        out[missed] = self._cached(distinct.take(pa.array(missed)).to_pylist())
        return out

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; a null has none."""
        if not self.apart:  # a tokenizer that splits otherwise: the library takes whole texts
            return np.array([len(ids) for _, _, ids, _ in WholeTexts(self.encode).texts(column)], np.int64)
        out = [np.zeros(0, np.int64)]
        for i, j, b, offsets in chunks(column, CHUNK):
            if not len(b):
                out.append(np.zeros(j - i, np.int64))
                continue
            bounds, told = distinct_pieces(b, offsets, self.specials)
            each = self._lengths(told.dictionary)[told.indices.to_numpy()]
            out.append(np.diff(np.concatenate([[0], np.cumsum(each)])[np.searchsorted(bounds, offsets)]))
        return np.concatenate(out)


#: The counter of this worker process: tasks that follow on find its cache warm. Holds one tokenizer.
_WORKER: dict[str, Counter] = {}


def _counter(config: str, keys: pa.Array, lengths: bytes) -> Counter:
    if config not in _WORKER:
        _WORKER.clear()
        _WORKER[config] = Counter(config, keys, np.frombuffer(lengths, np.uint8))
    return _WORKER[config]


def length_table(config: str) -> dict[bytes, int]:
    """Pieces among the vocabulary's entries, and how many tokens the library makes of each (255 at most: others are left to the cache)."""
    from tokenizers import Tokenizer

    encode, apart, specials = library_encoder(config)
    if not apart:
        return {}
    library = Tokenizer.from_str(config)
    texts = (t.encode() for t in library.decode_batch([[i] for i in library.get_vocab().values()], skip_special_tokens=False) if t and "\ufffd" not in t)
    whole = sorted({t for t in texts if len(t) <= LETTERS and t not in specials and len(cuts(np.frombuffer(t, np.uint8), np.array([0, len(t)]), True)) == 2})
    return {t: len(ids) for t, ids in zip(whole, encode(whole), strict=True) if len(ids) <= 255}


def token_counts(documents: DataFrame, config: str, limit: int = 1024) -> DataFrame:
    """doc_id, text -> bytes and tokens of each text. `config`: the tokenizer file's JSON text. No shuffle."""
    table = length_table(config)
    shared = documents.sparkSession.sparkContext.broadcast((config, pa.array(table, pa.large_binary()), bytes(table.values())))

    def run(batches):
        counter = _counter(*shared.value)
        for batch in batches:
            n = counter.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    columns = F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return documents.select(*columns).mapInArrow(run, OUT)


def production_config(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return token_counts(table(spark, sf_dir, "documents"), production_config())
