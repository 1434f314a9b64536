"""Closed-form checks of the memory engine."""

import datetime

import pytest
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.operators import quality, store
from engram.plans import queries
from engram.sources import tables as T


def test_weights_shift_recency_and_sum_to_one():
    w = S.Weights().with_recency(0.25, 0.05)
    assert w.recency_lambda == 0.05 and w.relevance_floor == S.Weights().relevance_floor
    with pytest.raises(ValueError):
        S.Weights(semantic=0.5)
    tuned = quality.tune(S.Weights(), [("used", "semantic"), ("corrected", None)])
    assert abs(tuned.semantic + tuned.lexical + tuned.graph + tuned.recency + tuned.salience + tuned.confidence - 1) < 1e-9


def test_transitions_follow_the_state_machine(spark):
    n = spark.createDataFrame([(s, s) for s in S.TRANSITIONS], "id string, lifecycle_state string").withColumn("updated_at", X.at(T.NOW))
    for to in S.TRANSITIONS:
        moved = store.transition(n, n.select("id"), to, T.NOW)
        got = {r.id: r.lifecycle_state for r in moved.nodes.collect()}
        assert got == {s: to if to in S.TRANSITIONS[s] else s for s in S.TRANSITIONS}
        assert {r.id for r in moved.rejected.collect()} == {s for s in S.TRANSITIONS if to not in S.TRANSITIONS[s]}


def test_days_ago_labels(spark):
    base = datetime.datetime(2024, 6, 30)
    cases = {0: "today", 1: "yesterday", 3: "3 days ago", 7: "1 week ago", 10: "~1 week ago (10 days)", 14: "~2 weeks ago (14 days)", 59: "~8 weeks ago (59 days)", 61: "~2.0 months ago (61 days)", 100: "~3.3 months ago (100 days)", 400: "~1.1 years ago (400 days)", -2: "in 2 days"}
    df = spark.createDataFrame([(d, base - datetime.timedelta(days=d)) for d in cases], "d int, t timestamp_ntz")
    assert {r.d: r.x for r in df.select("d", X.days_ago(F.col("t"), F.lit(base).cast("timestamp_ntz")).alias("x")).collect()} == cases


def test_flagship_is_ranked_without_gaps(spark, sf):
    rows = sorted(queries.retrieve(spark, sf).collect(), key=lambda r: r["rank"])
    assert {"VECTOR", "LEXICAL", "GRAPH", "PINNED"} <= {p for r in rows for p in r.paths.split(",")} and any(r.lexical_score and r.graph_proximity for r in rows)
    assert rows and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.composite_score >= b.composite_score for a, b in zip(rows, rows[1:]))


def conversation(spark):
    told = [("u", "s1", "I moved the red piano to the attic"), ("u", "s1", "The keys are in the blue jar"), ("u", "s1", "Thanks"), ("u", "s2", "Buy milk and bread"), ("v", "s3", "The red piano is loud")]
    rows = [(f"m{i}", c, u, s, "user", "personal" if u == "u" else "project") for i, (u, s, c) in enumerate(told)]
    return spark.createDataFrame(rows, "id string, content string, user_id string, session_id string, role string, scope string").withColumn("timestamp", F.to_timestamp_ntz(F.concat(F.lit("2024-01-01 00:00:0"), F.substring("id", 2, 1))))


def test_retrieval_brings_session_context_hints_and_a_note(spark):
    from engram.engine import MemoryEngine

    packing = S.Packing(vector_k=1, lexical_k=1, window=3, window_top=1)
    e = MemoryEngine(spark, packing_config=packing)
    e.store(conversation(spark), "2024-01-02 00:00:00")
    e.tables.nodes = e.tables.nodes.where("NOT endswith(id, '+')")
    asked = spark.createDataFrame([("q", "where is the red piano", "u")], "query_id string, query string, user_id string")
    rows = {r.id: r for r in e.retrieve(asked, "2024-01-03 00:00:00").collect()}
    best, context = rows["m0"], {i: r for i, r in rows.items() if r.paths == ["SESSION_CONTEXT"]}
    assert best["rank"] == 1 and context and set(context) <= {"m1", "m2"} and "m3" not in rows
    assert all(abs(r.composite_score - round(0.85 * best.composite_score, 10)) < 1e-9 and r["rank"] > 1 for r in context.values())
    noted = e.tables.operations.where("op_type = 'RETRIEVAL_REQUEST'").collect()
    assert [r.target_id for r in noted] == ["q"] and e.weights.version() in noted[0].payload
    everyone = spark.createDataFrame([("q", "where is the red piano", None)], "query_id string, query string, user_id string")
    assert {r.scope for r in e.hints(everyone, "2024-01-03 00:00:00", ["personal"]).collect()} == {"project"}


def test_jobs_as_projections_equal_transitions(spark, sf):
    from engram.operators import jobs, organizer

    n = T.migrate(T.nodes(spark, sf), S.NODES)
    t = T.empty_tables(spark)
    t.nodes = n
    act = organizer.sweep_actions(n, T.NOW)
    want = {"promote": store.promote(n, organizer.promotable(n, T.NOW), T.NOW).nodes, "tombstone_sweep": store.archive(n, organizer.expired(n, T.NOW), T.NOW).nodes}
    want["decay_sweep"] = store.deprecate(store.archive(n, act.where("action = 'archive'"), T.NOW).nodes, act.where("action = 'deprecate'"), T.NOW).nodes
    want["archive"] = store.archive(n, act.where("salience < 0.05"), T.NOW).nodes
    for name, nodes in want.items():
        done = jobs.run_job(name, t, T.NOW)
        states = lambda df: {(r.id, r.lifecycle_state, r.updated_at) for r in df.select("id", "lifecycle_state", "updated_at").collect()}
        assert states(done.tables.nodes) == states(nodes)
        moved = {r.id for r in done.changed.collect()}
        assert moved >= {i for i, *_ in states(nodes) - states(n)} and moved
