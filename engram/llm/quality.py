"""Quality rules: base counts per document, and a learned ordered decision list.

The list is learned by sequential covering: a rule is a conjunction of thresholds on the counts' ratios,
grown one condition at a time by information gain on two thirds of the rows, pruned from its end on the rest,
kept while it is precise enough, and the rows it covers are set aside for the next. The result is data
(`Rule`s) and becomes one ordered Spark conditional expression.

Labels come from a sample of at most `sample` labelled rows (those of least hash of the id); counts are of
every whole text. Nulls and empty texts have no words and fail the base rule; very long texts are counted whole, in
pieces of bytes; repeated rows each get their result; conditions that tie in gain go by the order of `RATIOS`; without
labels no rule is learned and the base rule alone decides; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm import textscan as ts

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_digits", "n_distinct"]
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)

#: Ratios the rules may test: numerator, denominator.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "upper_ratio": ("n_upper", "word_chars"),
    "bang_ratio": ("n_bangs", "n_words"),
    "digit_ratio": ("n_digits", "word_chars"),
    "distinct_ratio": ("n_distinct", "n_words"),
    "mean_word": ("word_chars", "n_words"),
}

_TABLES = {}
for _name, _bytes in (("n_symbols", SYMBOLS), ("n_upper", bytes(range(65, 91))), ("n_bangs", b"!"), ("n_digits", b"0123456789")):
    _TABLES[_name] = np.zeros(256, np.int32)
    _TABLES[_name][list(_bytes)] = 1
_LETTER = np.zeros(256, np.int32)
_LETTER[:0x80] = ts.SOLID[:0x80]
_LETTER[0xC0:] = 1  # bytes that begin a character outside white space


def _sums(b: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of a byte's weight by row, in pieces."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for at in range(0, len(b), ts.PIECE):
        end = min(len(b), at + ts.PIECE)
        total = np.zeros(end - at + 1, np.int64)
        np.cumsum(weight[b[at:end]], out=total[1:])
        lo, hi = np.clip(offsets[:-1], at, end) - at, np.clip(offsets[1:], at, end) - at
        out += total[hi] - total[lo]
    return out


def _duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    seen: set[bytes] = set()
    dup = n = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            n += 1
            dup += line in seen
            seen.add(line)
    return n, dup


def _repeated(w: ts.Words, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Words in 3-word windows that occur twice or more in their row; and distinct words."""
    within = w.within(3)
    place = w.docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    marks = np.zeros(len(w.docs) + 1, np.int64)
    if len(within):
        keys = ts.mix(w.grams(3) + place[: len(within)])
        order = np.argsort(keys, kind="stable")
        order = order[within[order]]
        k = keys[order]
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        twice = same.copy()
        twice[:-1] |= same[1:]
        at = order[twice]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + 3, -1)
    covered = np.cumsum(marks)[:-1] > 0
    own = np.sort(ts.mix(w.hashes + place))
    # distinct words of a row: first places of the sorted (row, word) keys
    order = np.argsort(ts.mix(w.hashes + place), kind="stable")
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    return np.bincount(w.docs[covered], minlength=rows), np.bincount(w.docs[order][new], minlength=rows)


def _counted(column: pa.Array):
    """(first row, end row, counts by name) of runs of a text column."""
    for i, j, b, offsets in ts.chunks(column):
        rows = j - i
        w = ts.scan(b, offsets, ts.SOLID)
        out = {"n_words": np.bincount(w.docs, minlength=rows), "word_chars": _sums(b, offsets, _LETTER)}
        out |= {c: _sums(b, offsets, t) for c, t in _TABLES.items()}
        out["n_repeat_words"], out["n_distinct"] = _repeated(w, rows)
        text = b.tobytes()
        lines = [_duplicate_lines(text[offsets[r] : offsets[r + 1]]) for r in range(rows)]
        out["n_lines"], out["n_dup_lines"] = np.array([x[0] for x in lines]), np.array([x[1] for x in lines])
        yield i, j, out


def text_counts(documents: DataFrame) -> DataFrame:
    """doc_id, text -> COUNTS of every whole text. No shuffle."""

    def run(batches):
        for batch in batches:
            for i, j, out in _counted(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(out[c].astype(np.int64)) for c in COUNTS)], names=["doc_id", *COUNTS])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def counts_beside(documents: DataFrame, name: str) -> DataFrame:
    """All columns of documents and a struct `name` of COUNTS, in one pass."""
    if name.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"documents have a column {name}; give another name")
    at_text = documents.columns.index("text")
    schema = T.StructType([*documents.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def run(batches):
        for batch in batches:
            for i, j, out in _counted(batch.column(at_text)):
                counts = pa.StructArray.from_arrays([pa.array(out[c].astype(np.int64)) for c in COUNTS], names=COUNTS)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, counts], names=[*batch.schema.names, name])

    return documents.mapInArrow(run, schema)


def _ratio(name: str, of: Callable[[str], Column]) -> Column:
    n, d = (of(c) for c in RATIOS[name])
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def with_ratios(counts: DataFrame) -> DataFrame:
    return counts.withColumns({r: _ratio(r, F.col) for r in RATIOS})


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        c = of(self.feature)
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    rejects: bool = True

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for c in self.conditions:
            out &= c.mask(x)
        return out

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        tests = " and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)
        return f"if {tests}: {'reject' if self.rejects else 'keep'}"


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most: int, cuts: int) -> list[Condition]:
    """Adds the condition of greatest FOIL gain until the rule is pure or nothing gains."""
    found: list[Condition] = []
    alive = np.ones(len(y), bool)
    while len(found) < most:
        p, n = int((y & alive).sum()), int((~y & alive).sum())
        if p == 0 or n == 0:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for feature in x:
            v = x[feature][alive]
            for threshold in np.unique(np.quantile(np.concatenate([v[y[alive]], v]), np.linspace(0, 1, cuts), method="nearest")):
                for above in (True, False):
                    m = v >= threshold if above else v <= threshold
                    p1 = int((y[alive] & m).sum())
                    if p1 == 0:
                        continue
                    gain = p1 * (np.log2(p1 / int(m.sum())) - before)
                    if gain > best[0]:
                        best = (gain, Condition(feature, above, float(threshold)))
        if best[1] is None:
            break
        found.append(best[1])
        alive &= best[1].mask(x)
    return found


def _worth(conditions, x, y) -> float:
    m = Rule(tuple(conditions)).mask(x)
    p, n = int((y & m).sum()), int((~y & m).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(x: dict[str, np.ndarray], y: np.ndarray, precision: float = 0.95, most_rules: int = 16, most_conditions: int = 4, cuts: int = 64, least: int = 5, seed: int = 7) -> list[Rule]:
    """Sequential covering of the rows with y true. Stops at a rule that is less precise than `precision` on all rows left."""
    rules: list[Rule] = []
    left = np.ones(len(y), bool)
    rng = np.random.default_rng(seed)
    while len(rules) < most_rules and int((y & left).sum()) >= least:
        at = np.flatnonzero(left)
        to_grow = rng.random(len(at)) < 2 / 3
        grow, prune = at[to_grow], at[~to_grow]
        conditions = _grow({k: v[grow] for k, v in x.items()}, y[grow], most_conditions, cuts)
        held = {k: v[prune] for k, v in x.items()}
        while len(conditions) > 1 and _worth(conditions[:-1], held, y[prune]) >= _worth(conditions, held, y[prune]):
            conditions = conditions[:-1]
        if not conditions:
            break
        rule = Rule(tuple(conditions))
        m = rule.mask(x) & left
        p = int((y & m).sum())
        if p < least or p < precision * int(m.sum()):
            break
        rules.append(rule)
        left &= ~m
    return rules


def verdict(rules: list[Rule], of: Callable[[str], Column] = F.col) -> Column:
    """The decision list as an ordered conditional: the first rule that holds decides; else the row is kept.
    `of` gives the column of a ratio."""
    out = None
    for rule in rules:
        out = F.when(rule.column(of), F.lit(not rule.rejects)) if out is None else out.when(rule.column(of), F.lit(not rule.rejects))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, sample: int = 20_000, **how) -> list[Rule]:
    """Rules from at most `sample` labelled documents; quality 0 is what they catch. The sample's counts go to the driver."""
    some = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id", "left_semi")
    rows = with_ratios(text_counts(chosen)).join(F.broadcast(some), "doc_id").select("quality", *RATIOS).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)  # the order of arrival must not matter
    return learn_rules({c: rows[c].to_numpy(float) for c in RATIOS}, rows["quality"].to_numpy() == 0, **how)


def _base_failed(of: Callable[[str], Column], least_words: int, most_repeat: int) -> Column:
    return (of("n_words") < least_words) | (100 * of("n_repeat_words") > most_repeat * of("n_words"))


def quality_verdicts(documents: DataFrame, rules: list[Rule], least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """Counts, ratios, the base rule and the list's verdict for every document."""
    rated = with_ratios(text_counts(documents)).withColumn("base_failed", _base_failed(F.col, least_words, most_repeat))
    return rated.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_verdicts_beside(documents: DataFrame, rules: list[Rule], least_words: int = 50, most_repeat: int = 50, name: str = "quality_verdict") -> DataFrame:
    """All columns of documents, as they are, and a struct `name`: the counts, `base_failed` and `kept`."""
    of = lambda c: F.col(name)[c]
    failed = _base_failed(of, least_words, most_repeat)
    kept = ~failed & verdict(rules, lambda r: _ratio(r, of))
    return counts_beside(documents, name).withColumn(name, F.struct(*[of(c).alias(c) for c in COUNTS], failed.alias("base_failed"), kept.alias("kept")))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = quality_verdicts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
