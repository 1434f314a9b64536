"""Source divergence audit: how far the word frequencies of a language's sources lie apart, and by which words.

A language keeps the terms in at least `least_documents` of its documents. Every (lang, source) group, and each language
as a whole, gives each kept term p = 1 + floor(scale * (count + 2) / (N + 2 * V)); two of them differ by
f = floor((p - q)^2 / (p + q)) in a term. Part `pair` sums f over all kept terms for every two sources of a language, part
`term` ranks the terms that a source has more of than its language.

Pairs without a pass per term: terms with the same sparse vector of (source, count) are one, with a multiplicity. For two
sources the sum is, over all kept terms, f of two zeros; then, for each source, what its own counts change against a zero
(by how many terms have each count); then, for each distinct vector in which both occur, once, times its multiplicity, the
rest: f(c, d) - f(c, 0) - f(0, d) + f(0, 0). Only vectors in which both sources occur are met, so the work follows the
non-zero counts; nothing is as large as terms times sources. Terms of part `term` come from the same vectors before they
are merged, so ranking is of the original terms.

Words are counted in Arrow batches, told apart exactly by Arrow's hash table, and summed in Spark: first by (lang, source,
term), then by (lang, term), so a word that every text has is a row per source in the second step. A vector has at most a
cell per source of its language. All arithmetic is on whole numbers of 64 bits, division by digits included, exact for
counts below 2^52. Results don't depend on order: ties rank by the item's bytes.

Nulls in text, lang and source are ''. Repeated rows are documents of their own. Very long texts are counted whole, one at a
time. Other columns are ignored; a language without a kept term has pairs of value 0; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import Scratch, small_batches
from engram.llm.textscan import LOWER, chunks, scan

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]` after lower-casing: a-z and all beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True
#: Digits of `scale` that a step of the division brings down.
STEP = 1000
CHUNK = 4 << 20


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, source, text (without nulls) -> lang, source, term, n (occurrences), d (documents)."""

    def run(batches):
        for batch in batches:
            langs, sources = (batch.column(c).dictionary_encode() for c in (0, 1))
            many = max(1, len(sources.dictionary))
            codes = langs.indices.to_numpy().astype(np.int64) * many + sources.indices.to_numpy()
            for i, j, b, offsets in chunks(batch.column(2), CHUNK):
                b = LOWER[b]
                words = scan(b, offsets, LETTERS)
                if not len(words.starts):
                    continue
                term = _words(b, words.starts, words.ends).dictionary_encode()
                width, which = len(term.dictionary), term.indices.to_numpy().astype(np.int64)
                keys, n = np.unique(codes[i:j][words.docs] * width + which, return_counts=True)
                seen = np.unique(words.docs * width + which)  # a document's words, once each
                own, d = np.unique(codes[i:j][seen // width] * width + seen % width, return_counts=True)
                assert np.array_equal(keys, own)
                group = keys // width
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(group // many)), sources.dictionary.take(pa.array(group % many)), term.dictionary.take(pa.array(keys % width)).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                    names=["lang", "source", "term", "n", "d"],
                )

    found = documents.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _words(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as binary values, without the bytes between them."""
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    data = b[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(data)])


def term_vectors(counts: DataFrame, least_documents: int = 10) -> DataFrame:
    """lang, term, cells: of each kept term its (source, count) by source."""
    cells = F.sort_array(F.collect_list(F.struct("source", F.col("n").alias("count"))))
    return counts.groupBy("lang", "term").agg(cells.alias("cells"), F.sum("d").alias("d")).where(F.col("d") >= least_documents).drop("d")


def share(count: Column, n: Column, v: Column, digits: int = 9) -> Column:
    """1 + floor(10^digits * (count + 2) / (n + 2 * v)) by long division, so that no step exceeds 64 bits."""
    whole, rest, below = F.lit(0).cast("long"), count + 2, n + 2 * v
    quotient = lambda a, b: F.call_function("div", a, b)
    whole, rest = quotient(rest, below), rest % below
    for _ in range(digits // 3):
        whole, rest = whole * STEP + quotient(rest * STEP, below), (rest * STEP) % below
    return F.lit(1) + whole


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)



def divergence(documents: DataFrame, least_documents: int = 10, top_terms: int = 10) -> DataFrame:
    """lang, source, text -> lang, source, part, item, value, rank (see the module)."""
    spark = documents.sparkSession
    s = Scratch(spark, "divergence")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(text("lang"), text("source"), text("text"))
    with small_batches(spark):
        vectors = s.keep(term_vectors(term_counts(docs), least_documents), "vectors")
    cells = vectors.select("lang", "term", F.explode("cells").alias("cell")).select("lang", "term", "cell.source", "cell.count")
    # one row for each group that occurs: its own sum, its language's sum and number of terms
    langs = vectors.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["count"])).alias("lang_n"))
    sums = cells.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = s.keep(groups.select("lang", "source", *map(zero, ("n", "v", "lang_n"))), "groups")
    return _pair_part(vectors, groups, s).unionByName(_term_part(vectors, groups, top_terms))


def _term_part(vectors: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Kept terms that a group has more of than its language, the first `top` by value."""
    total = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["count"]).alias("total")
    cells = vectors.select("lang", F.col("term").alias("item"), total, F.explode("cells").alias("cell")).select("lang", "item", "total", "cell.source", "cell.count")
    own = cells.join(groups, ["lang", "source"])
    own = own.withColumn("p", share(F.col("count"), F.col("n"), F.col("v"))).withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v")))
    valued = own.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), "item", gap(F.col("p"), F.col("q")).alias("value"))
    return _ranked(valued).where(F.col("rank") <= top)


def _pair_part(vectors: DataFrame, groups: DataFrame, s: Scratch) -> DataFrame:
    """Every two sources of a language by the sum of f over its kept terms."""
    distinct = s.keep(vectors.groupBy("lang", "cells").agg(F.count("*").alias("m")), "distinct")
    side = lambda i: groups.select("lang", F.col("source").alias(f"s{i}"), F.col("n").alias(f"n{i}"), F.col("v").alias(f"v{i}"))
    p = lambda i, count: share(count, F.col(f"n{i}"), F.col(f"v{i}"))
    none = F.lit(0).cast("long")
    # two sources of one vector, the first before the second
    later = F.expr("transform(cells, (a, i) -> transform(slice(cells, i + 2, greatest(size(cells) - i - 1, 0)), b -> struct(a.source AS s1, a.count AS c1, b.source AS s2, b.count AS c2)))")
    both = distinct.select("lang", "m", F.explode(later).alias("of")).select("lang", "m", F.explode("of").alias("x")).select("lang", "m", "x.*")
    both = both.join(side(1), ["lang", "s1"]).join(side(2), ["lang", "s2"])
    both = both.withColumns({"p1": p(1, F.col("c1")), "p2": p(2, F.col("c2")), "z1": p(1, none), "z2": p(2, none)})
    rest = gap(F.col("p1"), F.col("p2")) - gap(F.col("p1"), F.col("z2")) - gap(F.col("z1"), F.col("p2")) + gap(F.col("z1"), F.col("z2"))
    met = both.groupBy("lang", "s1", "s2").agg(F.sum(F.col("m") * rest).alias("part_sum"))
    # a source's own counts against another's zero
    own = distinct.select("lang", "m", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("s1"), F.col("x.count").alias("c1")).agg(F.sum("m").alias("m"))
    other = side(2).withColumnRenamed("lang", "lang2")
    against = own.join(side(1), ["lang", "s1"]).join(other, (F.col("lang") == F.col("lang2")) & (F.col("s1") != F.col("s2")))
    against = against.withColumns({"p1": p(1, F.col("c1")), "z1": p(1, none), "z2": p(2, none)})
    change = F.col("m") * (gap(F.col("p1"), F.col("z2")) - gap(F.col("z1"), F.col("z2")))
    alone = against.groupBy(F.col("lang"), F.least("s1", "s2").alias("a"), F.greatest("s1", "s2").alias("b")).agg(F.sum(change).alias("part_sum"))
    # all kept terms as zeros of both
    every = side(1).join(other, (F.col("lang") == F.col("lang2")) & (F.col("s1") < F.col("s2")))
    base = F.when(F.col("v1") > 0, F.col("v1") * gap(p(1, none), p(2, none))).otherwise(none)
    parts = every.select("lang", "s1", "s2", base.alias("part_sum")).unionByName(met).unionByName(alone.withColumnsRenamed({"a": "s1", "b": "s2"}))
    sums = parts.groupBy("lang", "s1", "s2").agg(F.sum("part_sum").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("s1").alias("source"), F.col("s2").alias("item")), F.struct(F.col("s2").alias("source"), F.col("s1").alias("item"))))
    return _ranked(sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value"))


def _ranked(valued: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return valued.withColumn("rank", F.row_number().over(order))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return divergence(table(spark, sf_dir, "documents"))
