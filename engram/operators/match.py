"""Which texts hold which patterns: an automaton over many patterns, one pass over each text, no nested-loop join.

`holding` looks for the same patterns in every text; `holding_own` for those of a text's owner. Comparison is of the strings
as given (lower both for matches whatever the case); a pattern counts once per text, the empty pattern never.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.frames import kept, rows_of

BLOCK_LETTERS = 16 << 20  # of the patterns that one automaton is made of
SLICE_ROWS = 20_000
FEW = 50_000  # patterns that are looked at before they are dealt

#: The automaton of this worker process, by the block of patterns it is made of.
_WORKER: dict[str, ahocorasick.Automaton] = {}


def automaton(patterns) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        if p:
            out.add_word(p, p)
    out.make_automaton()
    return out


def found_in(machine: ahocorasick.Automaton, text: str | None) -> set[str]:
    return {p for _, p in machine.iter(text)} if text and len(machine) else set()


def holding(texts: DataFrame, patterns: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """texts: (id, text), patterns: (pattern) -> (id, pattern) for every pattern in a text.

    The patterns are shipped as a broadcast while they have at most `block_letters` letters; more of them are dealt over several
    passes by hash, each with an automaton of about that size.
    """
    spark, wanted = texts.sparkSession, patterns.select("pattern").where("pattern <> ''").distinct()
    first = [r.pattern for r in wanted.limit(FEW + 1).collect()]
    if len(first) <= FEW and sum(map(len, first)) <= block_letters:
        parts = iter([first] if first else [])
    else:
        wanted = kept(wanted)
        passes = -(-wanted.agg(F.sum(F.length("pattern"))).first()[0] // block_letters)
        parts = ([r.pattern for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == n).toLocalIterator()] for n in range(passes))
    out = None
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def run(frames, shared=shared, key=uuid.uuid4().hex):
            if key not in _WORKER:
                _WORKER.clear()
                _WORKER[key] = automaton(shared.value)
            for pdf in frames:
                hits = [(i, p) for i, text in zip(pdf["id"], pdf["text"], strict=True) for p in found_in(_WORKER[key], text)]
                yield rows_of(hits, "id string, pattern string")

        found = texts.select("id", "text").mapInPandas(run, "id string, pattern string")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "id string, pattern string")


def holding_own(texts: DataFrame, patterns: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """texts: (owner, id, text), patterns: (owner, pattern) -> (owner, id, pattern) for every pattern of its owner in a text.

    An owner's texts are dealt into slices of about `slice_rows`, and its patterns go to each of them, so an owner of a third of
    all texts is many groups. Owners without patterns are left out before anything is dealt.
    """
    asked = patterns.where("pattern <> ''").select("owner", "pattern").distinct()
    sizes = texts.groupBy("owner").agg(F.ceil(F.count("*") / F.lit(slice_rows)).cast("int").alias("g")).join(asked.select("owner").distinct(), "owner", "left_semi")
    dealt = texts.join(sizes, "owner").select("owner", "id", "text", F.pmod(F.xxhash64("id"), F.col("g")).cast("int").alias("slice"))
    sent = asked.join(sizes, "owner").select("owner", "pattern", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("slice"))

    def run(own: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        machine = automaton(words["pattern"])
        return rows_of([(o, i, p) for o, i, text in zip(own["owner"], own["id"], own["text"], strict=True) for p in found_in(machine, text)], "owner string, id string, pattern string")

    return dealt.groupBy("owner", "slice").cogroup(sent.groupBy("owner", "slice")).applyInPandas(run, "owner string, id string, pattern string")
