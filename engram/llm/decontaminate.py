"""Benchmark decontamination by winnowing.

Of every run of `guarantee - k + 1` consecutive k-grams a text keeps the one of least hash, so any span of
`guarantee` words that two texts share has a fingerprint in common. Training fingerprints meet a table of the
benchmark's fingerprints (a map-side hash join: the table is size-checked, and larger benchmarks go
through in blocks of items), and each meeting is extended to whole windows, which are compared byte for byte.
Windows of items shorter than `guarantee` words can hold no full run, so they are looked up directly.

Work per document is linear in its words however often a passage repeats. Nothing is shuffled but hits.

Nulls and empty texts have no words and no hit; item texts that are null or wordless have no window; very long
texts are scanned in pieces; repeated rows each get their own result; of equal windows all items are listed; a null
doc_id is carried; an item without id is listed as `null`; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import textscan as ts
from engram.llm.common import Scratch, worker_state

WINDOW = 10
K = 5
#: Benchmark bytes held by a worker at once; more items go through in further blocks.
BLOCK_BYTES = 8 << 20
OUT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start:int,end:int>>"


def winnow(hashes: np.ndarray, within: np.ndarray, span: int) -> np.ndarray:
    """Positions kept: the rightmost least hash of every `span` consecutive k-grams of a row.

    `within[i]`: k-gram i lies in one row. K-grams across rows never win, and a row with fewer
    k-grams than `span` keeps its least ones.
    """
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64)
    h = np.where(within, hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    best, at = h.copy(), np.arange(n)
    keep = np.zeros(n, bool)
    for i in range(1, span):
        other = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF))
        other[: n - i] = h[i:]
        win = other <= best
        best = np.where(win, other, best)
        at = np.where(win, np.minimum(np.arange(n) + i, n - 1), at)
    keep[at] = True
    return np.flatnonzero(keep & within)


class Benchmark:
    """Windows of a block of items, in arrays: by length, sorted hashes of the distinct windows, where the words of each
    stand in the block's texts, and the items that have it. Held: some 6 bytes a byte of text, for a moment 18 while it is built."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k = window, min(k, window)
        self.ids = ["null" if i is None else str(i) for i, _ in items]
        self.bytes = ts.LOWER[np.frombuffer(b"".join(t for _, t in items), np.uint8)]
        w = ts.scan(self.bytes, np.cumsum([0, *(len(t) for _, t in items)]), ts.ALNUM)
        self.starts, self.ends = w.starts.astype(np.int32), w.ends.astype(np.int32)
        counts = np.bincount(w.docs, minlength=len(items))
        self.seeds = np.zeros(0, np.uint64)
        self.windows = {}
        for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            grams = w.grams(n)
            at = np.flatnonzero(w.within(n)) if n == window else np.searchsorted(w.docs, np.flatnonzero(counts == n))
            self.windows[n] = self._distinct(grams[at], at, w.docs[at], n)
            if n == window:
                grams = w.grams(self.k)
                # only items of `window` words or more hold a full run of k-grams
                kept = winnow(grams, w.within(self.k), window - self.k + 1)
                self.seeds = np.unique(grams[kept[counts[w.docs[kept]] >= window]])

    def _distinct(self, hashes: np.ndarray, at: np.ndarray, item: np.ndarray, n: int):
        """(hash, first word, items from, items) of distinct windows, by hash. Windows of one hash and other words stay apart."""
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        first = np.ones(len(hashes), bool)
        first[1:] = hashes[1:] != hashes[:-1]
        heads = np.append(np.flatnonzero(first), len(hashes))
        group = np.cumsum(first) - 1
        for g in np.flatnonzero(np.diff(heads) > 1).tolist():
            a, b = heads[g], heads[g + 1]
            words = [self._words(self.bytes, self.starts, self.ends, i, n) for i in at[a:b].tolist()]
            if any(x != words[0] for x in words):  # a clash of hashes
                own = sorted(range(a, b), key=lambda i: words[i - a])
                at[a:b], item[a:b] = at[own], item[own]
                words.sort()
                first[a + 1 : b] |= [x != y for x, y in zip(words[1:], words[:-1], strict=True)]
        group = np.cumsum(first) - 1
        new = first | np.append(True, (item[1:] != item[:-1]) | first[1:]) if len(item) else first
        heads = np.flatnonzero(first)
        return hashes[heads], at[heads].astype(np.int32), np.searchsorted(group[new], np.arange(len(heads) + 1)), item[new].astype(np.int32)

    @staticmethod
    def _words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, n: int) -> list[bytes]:
        return [b[s:e].tobytes() for s, e in zip(starts[at : at + n].tolist(), ends[at : at + n].tolist(), strict=True)]

    def items(self, n: int, which: int) -> list[str]:
        _, _, upto, item = self.windows[n]
        return [self.ids[i] for i in item[upto[which] : upto[which + 1]].tolist()]

    def hits(self, b: np.ndarray, w: ts.Words) -> list[tuple[int, int, int]]:
        """(first word, words, number of the window) of every exact occurrence; words count through the chunk."""
        found = []
        for n, (known, rep, _, _) in self.windows.items():
            within = w.within(n)
            if not len(within):
                continue
            if n == self.window:
                grams = w.grams(self.k)
                at = winnow(grams, w.within(self.k), self.window - self.k + 1)
                at = at[_member(grams[at], self.seeds)]
                near = at[:, None] - np.arange(self.window - self.k + 1)[None, :]
                starts = np.unique(near[(near >= 0) & (near < len(within))])
                starts = starts[within[starts]]
                runs = self._grams_at(w, starts, n)
            else:
                starts, runs = np.flatnonzero(within), w.grams(n)[within]
            hit = _member(runs, known)
            for i, run in zip(starts[hit].tolist(), runs[hit], strict=True):
                words = self._words(b, w.starts, w.ends, i, n)
                for which in range(int(np.searchsorted(known, run)), len(known)):
                    if known[which] != run:
                        break
                    if self._words(self.bytes, self.starts, self.ends, int(rep[which]), n) == words:
                        found.append((i, n, which))
        return found

    @staticmethod
    def _grams_at(w: ts.Words, starts: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for i in range(n):
            out = ts.mix(out * np.uint64(0x100000001B3) + w.hashes[starts + i])
        return out


def _index(key: str, items: list[tuple[object, bytes]], window: int, k: int) -> Benchmark:
    """The index of this worker process: tasks that follow on find it built. Holds one block."""
    return worker_state(("benchmark", key), lambda: Benchmark(items, window, k))


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[i] == x


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    block, held = [], 0
    for row in benchmark.select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("b")).toLocalIterator():
        text = bytes(row.b)
        if block and held + len(text) > limit:
            yield block
            block, held = [], 0
        block.append((row.item_id, text))
        held += len(text)
    if block:
        yield block


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _scan_batches(batches, index: Benchmark):
    for batch in batches:
        out = {c: [] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans")}
        for i, j, b, offsets in ts.chunks(batch.column(1)):
            b = ts.LOWER[b]
            w = ts.scan(b, offsets, ts.ALNUM)
            rows = j - i
            first = np.searchsorted(w.docs, np.arange(rows + 1))
            mark = np.zeros(len(w.docs) + 1, np.int64)
            which: dict[int, set[tuple[int, int]]] = {}
            hits = sorted(index.hits(b, w))
            spans: dict[int, list[list[int]]] = {}
            for at, n, key in hits:
                doc = int(w.docs[at])
                which.setdefault(doc, set()).add((n, key))
                mark[at] += 1
                mark[at + n] -= 1
                lo = at - int(first[doc])
                own = spans.setdefault(doc, [])
                if own and own[-1][1] >= lo:
                    own[-1][1] = max(own[-1][1], lo + n)
                else:
                    own.append([lo, lo + n])
            covered = np.cumsum(mark)[:-1] > 0
            n_hit = np.bincount(w.docs[covered], minlength=rows) if len(w.docs) else np.zeros(rows, int)
            for r in range(rows):
                ids = sorted({i for x in which.get(r, ()) for i in index.items(*x)})
                out["n_words"].append(int(first[r + 1] - first[r]))
                out["n_hit"].append(int(n_hit[r]))
                out["n_items"].append(len(ids))
                out["items_sha256"].append(_digest(ids))
                out["contaminated"].append(bool(n_hit[r]))
                out["item_ids"].append(ids)
                out["spans"].append([{"start": s, "end": e} for s, e in spans.get(r, [])])
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *out])


def _union_spans(spans):
    """Sorted union of an array of [start, end) structs, as a column expression."""
    ordered = F.array_sort(F.flatten(spans))
    kind = "array<struct<start:int,end:int>>"
    return F.aggregate(
        ordered,
        F.array().cast(kind),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: word count, words inside benchmark windows, items found, merged word spans.

    documents: doc_id, text; benchmark: item_id, text. One pass over the documents per block of items
    (`block_bytes` of text). Several blocks' results meet in one aggregate by row.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    parts = []
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            yield from _scan_batches(batches, _index(key, shared.value, window, k))

        parts.append(run)
    if not parts:
        parts = [lambda batches: _scan_batches(batches, Benchmark([], window, k))]
    if len(parts) == 1:
        return docs.mapInArrow(parts[0], OUT)
    # rows get their numbers once, in a written table: the passes must agree on them
    keyed = Scratch(spark, "contamination").keep(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    several = None
    for run in parts:

        def with_row(batches, run=run):
            for batch in batches:
                for out in run([batch.select(["doc_id", "text"])]):
                    yield pa.RecordBatch.from_arrays([*out.columns, batch.column(2)], names=[*out.schema.names, "row"])

        one = keyed.mapInArrow(with_row, f"{OUT}, row long")
        several = one if several is None else several.unionByName(one)
    merged = several.groupBy("row", "doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), _union_spans(F.collect_list("spans")).alias("spans"))
    return merged.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "item_ids",
        "spans",
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of documents, all columns, that hold no window of a benchmark item. Judged row by row: nothing is joined."""
    at_text, spark = documents.columns.index("text"), documents.sparkSession
    for block in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            index = _index(key, shared.value, window, k)
            for batch in batches:
                for i, j, b, offsets in ts.chunks(batch.column(at_text)):
                    b = ts.LOWER[b]
                    w = ts.scan(b, offsets, ts.ALNUM)
                    clean = np.ones(j - i, bool)
                    clean[[int(w.docs[at]) for at, _, _ in index.hits(b, w)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("item_ids", "spans")
