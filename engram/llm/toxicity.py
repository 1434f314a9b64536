"""Toxicity: a counterfactually regularised linear classifier.

Features are the distinct words of a text and their beginnings (inflected and compounded insults share one).
Features that tell little about the label on the training rows are left out; what stays gets weights by
logistic regression with an L2 penalty and a second one on counterfactuals: in labelled sentences identity
terms are swapped for other ones and for none, and the squared change of the sentence's score is penalised. So a
mention of a group moves no score by itself, and neutral mentions aren't flagged.

Trained on at most `sample` labelled rows (least hash of the id; of rows that share an id the least text counts). Features
are counted and chosen by Spark; the driver gets the `keep` chosen ones, each sample row's places among them, and the
distinct changes of the swaps with their counts (all swaps of all sentences): some tens of MB at the very most.
Every whole text is scored.

Nulls and empty texts have no feature and score the intercept; very long texts are scored whole, one at a time;
repeated rows score alike; features that tie in what they tell go by their number; the label, language, source and id are
never inputs; a row without id isn't held out and teaches nothing; without labelled rows of both kinds all scores are 0;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import Scratch

#: Identity terms that may stand for one another, by language. A parameter: pass others for other texts.
IDENTITY = {
    "en": ["muslim", "christian", "jewish", "hindu", "buddhist", "black", "white", "asian", "latino", "gay", "lesbian", "straight", "transgender", "woman", "man", "women", "men", "immigrant", "disabled", "deaf", "blind", "old", "young"],
    "fr": ["musulman", "chrétien", "juif", "hindou", "bouddhiste", "noir", "blanc", "asiatique", "homosexuel", "femme", "homme", "immigré", "handicapé"],
    "de": ["muslim", "christ", "jude", "hindu", "buddhist", "schwarz", "weiß", "asiatisch", "schwul", "lesbisch", "frau", "mann", "einwanderer", "behindert"],
    "es": ["musulmán", "cristiano", "judío", "hindú", "budista", "negro", "blanco", "asiático", "gay", "lesbiana", "mujer", "hombre", "inmigrante", "discapacitado"],
}
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
MEMO_ENTRIES = 300_000


def feature(name: str) -> int:
    """A feature's number: 32 bits of its hash, so rows of features are small arrays."""
    return xxhash.xxh32_intdigest(name.encode("utf-8", "replace"))


def word_features(word: str) -> tuple[int, ...]:
    """A lower-cased word and its beginnings, marked so that a whole short word isn't a beginning."""
    return (feature(word), *(feature(f"{word[:n]}*") for n in PREFIXES if len(word) > n))


def words_of(text: str | None) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text or ""))}


def _features(words) -> np.ndarray:
    return np.unique(np.array([f for w in words for f in word_features(w)], np.uint32))


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a text, sorted."""
    return _features(words_of(text))


class Model:
    """Intercept and weights by feature. Scores are of presence, so length alone changes nothing."""

    def __init__(self, intercept: float, weights: dict[int, float]) -> None:
        self.intercept, self.weights = intercept, weights
        self.memo: dict[str, tuple[int, ...]] = {}

    def _known(self, word: str) -> tuple[int, ...]:
        found = self.memo.get(word)
        if found is None:
            found = tuple(f for f in word_features(word.lower()) if f in self.weights)
            if len(word) <= 32:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[word] = found
        return found

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for w in set(WORD.findall(text or "")):  # the memo holds words as they stand; `_known` lowers them
            found.update(self._known(w))
        z = self.intercept + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def _places(features: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Where the features stand among the names; others are left out."""
    if not len(names) or not len(features):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(names, features), len(names) - 1)
    return at[names[at] == features].astype(np.int32)


def counterfactuals(text: str | None, identity: dict[str, list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a text's sentences with an identity term: the features that go and that come when the term is swapped for the
    next term, or for none."""
    nexts = {w: (terms[(i + 1) % len(terms)], "") for terms in identity.values() for i, w in enumerate(terms)}
    out = []
    for sentence in SENTENCE.split(text or ""):
        words = words_of(sentence)
        for term in sorted(words & nexts.keys()):
            own = _features(words)
            for other in nexts[term]:
                swapped = _features((words - {term}) | ({other} if other else set()))
                out.append((np.setdiff1d(own, swapped), np.setdiff1d(swapped, own)))
    return out


def chosen_features(counts: DataFrame, toxic: int, other: int, keep: int, least: int) -> np.ndarray:
    """counts: (feature, a toxic rows, b others) -> the features whose share differs most surely (z of the log odds), sorted."""
    a, b = F.col("a"), F.col("b")
    odds = lambda x, n: F.log((x + 0.5) / (F.lit(float(n)) - x + 0.5))
    z = F.abs((odds(a, toxic) - odds(b, other)) / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    best = counts.where(a + b >= least).withColumn("z", F.round(z, 9)).where("z > 3").orderBy(F.desc("z"), "feature").limit(keep)
    return np.sort(np.array([r.feature for r in best.select("feature").collect()], np.uint32))


def train(names: np.ndarray, places: list[np.ndarray], y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray, int]], l2: float = 1e-3, fairness: float = 1.0, steps: int = 250) -> Model:
    """Full-batch Adam on logistic loss + l2 |w|^2 + fairness * mean (change of score under a swap)^2.

    names: the features; places: each row's among them; swaps: places that go, places that come, how often.
    """
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return Model(-40.0, {})
    flat = lambda parts: (np.repeat(np.arange(len(parts)), [len(p) for p in parts]), np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
    rows, cols = flat(places)
    gone, come = flat([s[0] for s in swaps]), flat([s[1] for s in swaps])
    prow, pcol = np.concatenate([gone[0], come[0]]), np.concatenate([gone[1], come[1]])
    psign = np.concatenate([np.ones(len(gone[0])), -np.ones(len(come[0]))])
    often = np.array([s[2] for s in swaps], float)
    often /= max(1.0, often.sum())
    n, d = len(y), len(names)
    w, b = np.zeros(d), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n) + b
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        g = np.append(np.bincount(cols, weights=r[rows], minlength=d) + l2 * w / max(1, d) ** 0.5, r.sum())
        if len(prow):
            change = np.bincount(prow, weights=psign * w[pcol], minlength=len(swaps)) * often
            g[:d] += 2 * fairness * np.bincount(pcol, weights=psign * change[prow], minlength=d)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[:d]
        b -= move[d]
    return Model(float(b), {int(f): float(x) for f, x in zip(names, w, strict=True) if x})


def fold():
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def fit(documents: DataFrame, labels: DataFrame, sample: int = 6000, identity: dict[str, list[str]] | None = None, keep: int = 2000, least: int = 5, **how) -> Model:
    """A model from at most `sample` labelled rows that aren't held out."""
    identity = IDENTITY if identity is None else identity
    s = Scratch(documents.sparkSession, "toxicity")
    some = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(fold() != 0)
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = s.keep(texts.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).drop("doc_id"), "sample")

    def features(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_features(x.as_py()).astype(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))], names=["toxic", "features"])

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        s.drop("sample")
        return Model(-40.0, {})
    found = rows.select("toxic", "text").mapInArrow(features, "toxic int, features array<long>")
    counts = found.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    names = chosen_features(counts, n[1], n[0], keep, least)

    def placed(batches):
        places = pa.list_(pa.int32())
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            own = pa.array([_places(text_features(t), names) for t in texts], places)
            pair = pa.struct([("gone", places), ("come", places)])
            swaps = pa.array([[{"gone": _places(g, names), "come": _places(c, names)} for g, c in counterfactuals(t, identity)] for t in texts], pa.list_(pair))
            yield pa.RecordBatch.from_arrays([batch.column(0), own, swaps], names=["toxic", "places", "swaps"])

    found = s.keep(rows.select("toxic", "text").mapInArrow(placed, "toxic int, places array<int>, swaps array<struct<gone:array<int>,come:array<int>>>"), "placed")
    # equal changes are counted, so what the driver gets follows the terms, not the sentences
    swaps = found.select(F.explode("swaps").alias("x")).groupBy("x.gone", "x.come").agg(F.count("*").alias("c")).orderBy("gone", "come").collect()
    known = found.select("toxic", "places").orderBy("toxic", "places").toArrow()  # the order of arrival must not matter
    s.drop("sample", "placed")
    array = lambda x: np.array(x, np.int64)
    return train(names, [array(x) for x in known.column(1).to_pylist()], known.column(0).to_numpy(), [(array(r.gone), array(r.come), r.c) for r in swaps], **how)


def toxicity_scores(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every whole text. No shuffle; the model (at most `keep` features) is broadcast."""
    shared = documents.sparkSession.sparkContext.broadcast((model.intercept, model.weights))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.score(x.as_py()) for x in part.column(1)], pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def toxicity_scores_beside(documents: DataFrame, model: Model, name: str = "toxicity_score") -> DataFrame:
    """All columns of documents and the score as `name`, in one pass: rows needn't meet their scores in a join."""
    if name.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"documents have a column {name}; give another name")
    shared = documents.sparkSession.sparkContext.broadcast((model.intercept, model.weights))
    at_text = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            scores = pa.array([own.score(x.as_py()) for x in batch.column(at_text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
