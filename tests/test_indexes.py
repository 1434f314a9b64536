"""Stored indexes against exhaustive search and brute force."""

import math
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.functions.frames import scratch_folder
from engram.functions.stem import stem
from engram.operators import lexical_index, search, vector_index
from engram.operators.lexical_index import LexicalIndex, covers, cover_density, phrases
from engram.plans import indexed
from engram.sources import tables as T

# --- vectors


def frame(spark, m, users=None):
    rows = [(f"n{i}", users[i] if users else "u", "stable" if i % 3 else "archived", v.tolist()) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "node_id string, user_id string, state string, embedding array<float>")


def nearest(m, q, allowed, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit @ (q / np.linalg.norm(q))
    return [f"n{i}" for i in sorted(allowed, key=lambda i: (-round(float(s[i]), 9), f"n{i}"))[:k]]


def test_recall_on_clustered_vectors_with_few_probes(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 24))
    m = (centres[rng.integers(0, 40, 3000)] + 0.35 * rng.normal(size=(3000, 24))).astype(np.float32)
    v = frame(spark, m)
    index = vector_index.build(v, scratch_folder(spark, "ann"), slice_rows=500)
    assert index.settings.probes < index.settings.lists / 3
    asked = v.where("cast(substr(node_id, 2) as int) % 50 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    got = defaultdict(set)
    for r in index.search(asked, 10).collect():
        got[r.query_id].add(r.node_id)
    hits = sum(len(got[f"n{i}"] & set(nearest(m, m[i], range(3000), 10))) for i in range(0, 3000, 50))
    assert hits >= 0.9 * 600


def test_recall_on_the_given_vectors(spark):
    r = indexed.ann_recall(spark, "/root/testdata/sf0.01").first()
    assert r.enough and r.queries == 10 and r.neighbours == 100


def test_filters_come_before_the_cut_and_changes_count(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(600, 8)).astype(np.float32)
    m[:200] = m[0]  # a third of all are one vector
    users = [f"u{i % 3}" for i in range(600)]
    v = frame(spark, m, users)
    index = vector_index.build(v.where("cast(substr(node_id, 2) as int) < 400"), scratch_folder(spark, "ann"), lists=6, slice_rows=32)
    index.add(v.where("cast(substr(node_id, 2) as int) >= 400"), slice_rows=32)
    index.remove(v.where("cast(substr(node_id, 2) as int) between 100 and 149"))
    there = [i for i in range(600) if not 100 <= i < 150]
    asked = v.where("node_id in ('n0', 'n7', 'n450')").select(F.col("node_id").alias("query_id"), "user_id", "embedding")
    for one in (index, index.compact(scratch_folder(spark, "ann"), slice_rows=64)):
        got = defaultdict(list)
        for r in one.search(asked, 5, probes=6, refine=1000, where="state = 'stable'").orderBy("query_id", "rn").collect():
            got[r.query_id].append(r.node_id)
        assert got == {f"n{i}": nearest(m, m[i], [j for j in there if j % 3 and users[j] == users[i]], 5) for i in (0, 7, 450) if i % 3 or any(j % 3 and users[j] == users[i] for j in there)}
    biggest = spark.read.parquet(f"{index.root}/slices").agg(F.max("n")).first()[0]
    assert biggest < 100  # the list of the common vector lies in several slices


def test_only_probed_lists_are_read(spark):
    m = np.random.default_rng(2).normal(size=(300, 4)).astype(np.float32)
    index = vector_index.build(frame(spark, m), scratch_folder(spark, "ann"), lists=10)
    rows = index.lists().where("list IN (1, 2)")
    assert "PartitionFilters: [list" in rows._jdf.queryExecution().toString() and rows.select("list").distinct().count() <= 2
    with pytest.raises(ValueError):
        vector_index.build(frame(spark, m).limit(0), scratch_folder(spark, "ann"))


def test_small_bundles_and_parts_give_the_same(spark, monkeypatch):
    m = np.random.default_rng(6).normal(size=(160, 4)).astype(np.float32)
    v = frame(spark, m)
    index = vector_index.build(v, scratch_folder(spark, "ann"), lists=5, codes=8, rounds=2, slice_rows=16)
    for name, n in (("BUNDLE_ROWS", 40), ("PART_QUERIES", 3), ("FOUND_ROWS", 200)):
        monkeypatch.setattr(vector_index, name, n)
    asked = v.where("cast(substr(node_id, 2) as int) % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    got = defaultdict(list)
    for r in index.search(asked, 5, probes=5, refine=40).orderBy("rn").collect():
        got[r.query_id].append(r.node_id)
    assert got == {f"n{i}": nearest(m, m[i], range(160), 5) for i in range(0, 160, 20)}


def test_many_queries_meet_vectors_without_the_driver(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(500, 6)).astype(np.float32)
    users = [f"u{i % 7}" if i >= 200 else "hot" for i in range(500)]
    v = frame(spark, m, users)
    asked = v.select(F.col("node_id").alias("query_id"), F.when(F.col("node_id") != "n3", F.col("user_id")).alias("user_id"), "embedding")
    few, many = (search.vector_topk_batch(v, asked, 4, block=b).collect() for b in (1000, 10))
    key = lambda rows: sorted((r.query_id, r.node_id, round(r.score, 9), r.rn) for r in rows)
    assert key(few) == key(many) and len(many) == 2000


# --- words


@pytest.mark.parametrize(
    ("word", "want"),
    [pair.split(":") for pair in "consign:consign consistently:consist consolatory:consolatori conspiracy:conspiraci knightly:knight knives:knive knocker:knocker generously:generous generate:generat hopping:hop hoping:hope ties:tie cries:cri gas:gas this:this kiwis:kiwi by:by say:say relational:relat rationally:ration skies:sky dying:die inning:inning proceeds:proceed happiness:happi feed:feed agreed:agre".split()],
)
def test_published_stems(word, want):
    assert stem(word) == want


WORDS = ["alpha", "beta", "gamma", "delta", "running", "runs", "run"]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 40), p=[0.5, 0.2, 0.1, 0.05, 0.05, 0.05, 0.05])) for _ in range(700)]
    rows = [(f"d{i}", None if i == 5 else t, "hot" if i % 3 == 0 else f"u{i % 4}", "note" if i % 2 else "fact", f"s{i % 5}") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "node_id string, content string, user_id string, node_type string, scope string")


def index_of(spark, df, language=None, shard_docs=150):
    index = LexicalIndex.create(spark, scratch_folder(spark, "lexical"), language, shard_docs)
    for n in range(2):
        index.add(df.where(f"cast(substr(node_id, 2) as int) % 2 = {n}"))
    return index


ASKED = [("q1", "alpha beta", None), ("q2", "Gamma, delta! gamma", "hot"), ("q3", "run", "u1"), ("q4", "nothing", None), ("q5", "", None), ("q6", "alpha beta gamma delta run runs running", None)]


def same(a, b):
    x, y = ({(r.query_id, r.rn): (r.node_id, round(r.score, 7)) for r in rows.collect()} for rows in (a, b))
    assert x == y and x


@pytest.mark.parametrize("how", [{}, {"match_all": True}, {"node_type": "note"}, {"scopes": ["s1", "s4"]}, {"k": 1}, {"k": 500}])
def test_index_equals_scoring_everything(spark, corpus, how):
    df = corpus[1]
    asked = spark.createDataFrame(ASKED, "query_id string, query string, user_id string")
    same(index_of(spark, df).search(asked, **how), search.bm25(df, asked, **how))


def test_blocks_are_skipped(spark):
    docs = spark.range(2000).select(F.concat(F.lit("d"), "id").alias("node_id"), F.concat(F.lit("alpha "), F.expr("repeat('x ', id % 200)"), F.expr("repeat('beta ', id % 3)")).alias("content"))
    index = index_of(spark, docs, shard_docs=10_000)
    asked = spark.createDataFrame([("one", "alpha"), ("two", "alpha beta"), ("all", "alpha")], "query_id string, query string")
    work = {r.query_id: (r.blocks, r.read) for r in index.work(asked, k=3).collect()}
    assert work["one"][1] <= 4 < 14 <= work["one"][0] and work["two"][1] < work["two"][0], work
    same(index.search(asked, 3), search.bm25(docs, asked, 3))


def test_removed_documents_and_compaction(spark, corpus):
    rows, df = corpus
    gone = df.where("cast(substr(node_id, 2) as int) % 4 = 1")
    index = index_of(spark, df)
    index.remove(gone)
    index.add(df.where("node_id = 'd5'").withColumn("content", F.lit("alpha omega")).union(df.where("node_id = 'd1'").withColumn("content", F.lit("omega"))))
    asked = spark.createDataFrame([("q", "omega", None), ("p", "alpha", "u1")], "query_id string, query string, user_id string")
    got = index.search(asked, 1000).collect()
    assert {r.node_id for r in got if r.query_id == "q"} == {"d5", "d1"}
    assert {r.node_id for r in got if r.query_id == "p"} == {"d5"} | {d for d, t, u, *_ in rows if u == "u1" and int(d[1:]) % 4 != 1 and "alpha" in (t or "").split()}
    live = df.join(gone.select("node_id"), "node_id", "left_anti")
    asked = spark.createDataFrame(ASKED, "query_id string, query string, user_id string")
    fresh = index_of(spark, df)
    fresh.remove(gone)
    same(fresh.compact(df, scratch_folder(spark, "lexical")).search(asked), search.bm25(live, asked))


def test_stems_join_forms(spark, corpus):
    rows, df = corpus
    asked = spark.createDataFrame([("q", "Runs")], "query_id string, query string")
    got = {r.node_id for r in index_of(spark, df, "english").search(asked, 1000).collect()}
    assert got == {d for d, t, *_ in rows if {"run", "runs", "running"} & set((t or "").split())}


def brute_covers(positions):
    spans = {(min(c), max(c)) for c in product(*positions)}
    least = [s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)]
    return sorted((a, b, sum(a <= p <= b for ps in positions for p in ps)) for a, b in least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), unique=True, max_size=14), st.integers(1, 3), st.randoms())
def test_covers_are_the_least_intervals(places, terms, rng):
    positions = [np.array(sorted(p for i, p in enumerate(places) if i % terms == t)) for t in range(terms)]
    if all(len(p) for p in positions):
        assert covers(positions) == brute_covers([p.tolist() for p in positions])


def test_phrases_and_density(spark, corpus):
    rows, df = corpus
    index = index_of(spark, df)
    asked = spark.createDataFrame([("p", "beta alpha alpha", "hot"), ("r", "alpha", None)], "query_id string, query string, user_id string")
    got = {(r.query_id, r.node_id): r.score for r in index.positional(asked, 1000, phrase=True).collect()}
    want = {}
    for d, t, u, *_ in rows:
        words = (t or "").split()
        n = sum(words[i : i + 3] == ["beta", "alpha", "alpha"] for i in range(len(words)))
        if n and u == "hot":
            want["p", d] = n
        if "alpha" in words:
            want["r", d] = words.count("alpha")
    assert got == want
    asked = spark.createDataFrame([("c", "gamma beta", None)], "query_id string, query string, user_id string")
    got = {r.node_id: round(r.score, 9) for r in index.positional(asked, 1000, scopes=["s1"]).collect()}
    want = {}
    for d, t, _, _, scope in rows:
        at = [[i for i, w in enumerate((t or "").split()) if w == x] for x in ("gamma", "beta")]
        if scope == "s1" and all(at):
            want[d] = round(sum(0.1 / (1 + (b - a) - (m - 1)) for a, b, m in brute_covers(at)), 9)
    assert got == want and len(got) > 10
    assert cover_density([np.array([3]), np.array([5])]) == 0.05 and phrases([np.array([1, 7]), np.array([2, 9])]) == 1


def test_bounds_hold_for_every_posting():
    rng = np.random.default_rng(3)
    for _ in range(200):
        tfs, dls = rng.integers(1, 30, 20), rng.integers(1, 400, 20)
        row = type("Row", (), {"max_tf": tfs.max(), "min_dl": dls.min(), "first": 0, "last": 19, "user_id": None, "node_type": None, "scope": None})
        bound = lexical_index._Block(row).bound(1.7, 1.2, 0.75, 55.0)
        assert all(1.7 * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / 55.0)) <= bound + 1e-12 for t, n in zip(tfs, dls, strict=True))
    assert math.isfinite(bound) and Counter(re.findall("a", "aa"))["a"] == 2 and T.NOW


def test_blocks_of_a_shard_by_hand():
    import pyarrow as pa

    none = pa.array([None] * 3, pa.string())
    docs = pa.table({"node_id": ["b", "a", "c"], "user_id": pa.array([None, None, "u"]), "node_type": none, "scope": none, "words": [["x", "y", "x"], ["y"], ["x"]], "shard": pa.array([4] * 3, pa.int32()), "dl": pa.array([3, 1, 1], pa.int32())})
    rows = sorted((r["term"], r["user_id"] or "", r["ords"], r["node_ids"], r["tfs"], r["dls"], r["places"], r["max_tf"], r["min_dl"]) for r in lexical_index.blocks_of_shard(docs).to_pylist())
    assert rows == [("x", "", [1], ["b"], [2], [3], [[0, 2]], 2, 3), ("x", "u", [2], ["c"], [1], [1], [[0]], 1, 1), ("y", "", [0, 1], ["a", "b"], [1, 1], [1, 3], [[0], [1]], 1, 1)]
