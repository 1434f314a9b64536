"""The whole job by brute force: no text, row, seed or step is left out."""

import json
import re
from collections import Counter

from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import scratch_folder
from engram.operators import analysis, ingest, organizer, research, retrieval, search
from engram.plans import queries
from engram.sources import tables as T


def test_hypervectors_take_every_word(spark, sf):
    rows = T.read(spark, sf, "documents").select("doc_id", "text").collect()
    texts = {r.doc_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in rows}
    assert max(map(len, texts.values())) > 20
    words = spark.createDataFrame([(w,) for w in sorted({w for ws in texts.values() for w in ws})], "w string")
    signs = {r.w: r.v for r in words.select("w", research.seeded_hv(F.col("w"), 64).alias("v")).collect()}
    sums = {d: [sum(x) for x in zip(*[signs[w] for w in ws])] for d, ws in texts.items() if ws}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    q = sums[min(sums)]
    want = {d: round(sum(a * b for a, b in zip(v, q)) / (norm(v) * norm(q)), 6) if norm(v) else 0.0 for d, v in sums.items()}
    got = queries.hypervector_topk(spark, sf).collect()
    assert len(got) == 10 and all(abs(want[r.doc_id] - r.similarity) < 2e-6 for r in got)
    assert min(r.similarity for r in got) >= sorted(want.values())[-10] - 2e-6


def test_every_pinned_node_is_a_candidate(spark, sf):
    kept = lambda n: n.epistemic_type not in ("hypothetical", "deprecated") and not (n.epistemic_type == "unverified" and n.confidence <= 0.3)
    want = {n.id for n in T.nodes(spark, sf).collect() if n.lifecycle_state in S.ACTIVE and (n.salience == 1.0 or n.node_type == "task") and kept(n)}
    got = {r.id for r in queries.candidate_merge(spark, sf).collect() if "PINNED" in r.paths}
    assert got == want and any(int(i) % 10 for i in want)


def test_chains_start_at_every_node_and_end_where_the_links_end(spark, sf):
    nodes = {r.id: r.content for r in T.nodes(spark, sf).select("id", "content").collect()}
    link = {r.target_id: r.source_id for r in queries._chain_edges(spark, sf).collect()}
    walks = {}
    for seed in nodes:
        walks[seed] = [seed]
        while walks[seed][-1] in link and len(walks[seed]) <= 100:
            walks[seed].append(link[walks[seed][-1]])
    want = {(s, i, x) for s, w in walks.items() for i, x in enumerate(w)}
    got = [tuple(r) for r in queries.supersedence_chain(spark, sf).collect()]
    assert max(map(len, walks.values())) > 5 and len(got) == len(want) and set(got) == want


def test_oscillations_look_ten_steps_back_from_every_node(spark, sf):
    nodes = {r.id: r.w for r in T.nodes(spark, sf).select("id", organizer.keywords(F.col("content")).alias("w")).collect()}
    back = {r.source_id: r.target_id for r in queries._chain_edges(spark, sf).collect()}
    want = {}
    for seed, words in nodes.items():
        at, cycles = seed, 0
        for step in range(1, 11):
            at = back.get(at)
            if at is None:
                break
            a, b = set(words), set(nodes[at])
            cycles += step % 2 == 0 and bool(a and b) and len(a & b) / len(a | b) >= 0.3
        if cycles:
            want[seed] = (cycles, round(min(cycles * 0.1, 0.3), 10))
    got = {r.seed: (r.cycles, r.penalty) for r in queries.oscillation_jaccard(spark, sf).collect()}
    assert got == want and any(c > 2 for c, _ in want.values())


def test_graph_candidates_reach_from_every_node(spark, sf):
    nodes = T.nodes(spark, sf).select("id", "lifecycle_state", "confidence", "created_at").collect()
    near = {n.id: set() for n in nodes}
    for e in queries._chain_edges(spark, sf).collect():
        near[e.source_id].add(e.target_id)
        near[e.target_id].add(e.source_id)
    live = [n for n in nodes if near[n.id] and n.lifecycle_state in S.LIVE]
    order = sorted(live, key=lambda n: (-n.confidence, -n.created_at.timestamp(), n.id))
    got = {r.id: r.graph_proximity for r in queries.graph_candidate_scores(spark, sf).collect()}
    assert got == {n.id: 1.0 for n in order[:150]}


def conflicts(rows):
    rows = sorted(rows, key=lambda r: (r.created_at, r.id))
    same = lambda r: (r.user_id, r.subject.strip().lower(), "works_at" if r.predicate == "joined" else r.predicate)
    out = set()
    for i, r in enumerate(rows):
        for n in rows[i + 1 :]:
            if same(r) == same(n) and r.object.strip().lower() != n.object.strip().lower():
                out.add((r.id, n.id, "contradict" if n.temporal_intent == "assertion" else "supersede"))
                break
    return out


def test_every_repeat_of_a_fact_meets_the_change_after_it(spark, sf):
    day = "timestamp_ntz'2024-01-0{} 00:00:00'".format
    rows = [("a", "x", 1, None), ("b", "X ", 2, None), ("c", "y", 3, None), ("d", "y", 4, "assertion"), ("e", "x", 5, "assertion")]
    df = spark.createDataFrame([(i, "u", "s", "joined" if i == "b" else "works_at", o, d, t) for i, o, d, t in rows], "id string, user_id string, subject string, predicate string, object string, d int, temporal_intent string")
    df = df.withColumn("created_at", F.expr(f"{day(1)} + make_dt_interval(d)")).drop("d")
    want = {("a", "c", "supersede"), ("b", "c", "supersede"), ("c", "e", "contradict"), ("d", "e", "contradict")}
    assert {tuple(r) for r in ingest.fact_conflicts(df).collect()} == want == conflicts(df.collect())
    got = [tuple(r) for r in queries.fact_conflicts(spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == conflicts(queries._facts(spark, sf).collect())


def test_bm25_gives_every_match_and_drops_no_term(spark):
    docs = spark.range(50).select(F.col("id").cast("string").alias("node_id"), F.when(F.col("id") % 2 == 0, "ab cd").otherwise("ab").alias("content"))
    q = spark.createDataFrame([("q", "ab cd")], "query_id string, query string")
    assert search.bm25(docs, q, None).count() == 50 and search.bm25(docs, q, None, match_all=True).count() == 25
    assert search.bm25(docs, q, 3).count() == 3
    many = spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(20_000)) + " cd")], "query_id string, query string")
    assert search.bm25(docs, many, None).count() == 25
    plain, indexed = search.bm25(docs, q, 50), search.bm25_indexed(*search.lexical_index(docs), q, 50)
    assert sorted((r.node_id, round(r.score, 9)) for r in plain.collect()) == sorted((r.node_id, round(r.score, 9)) for r in indexed.collect())


def test_recall_counts_relevant_matches_below_the_hits(spark, sf):
    good = {str(r.doc_id) for r in T.read(spark, sf, "labels").where("quality > 0").collect()}
    texts = {str(r.doc_id): set(re.findall(r"[^\W_]+", (r.text or "").lower())) for r in T.read(spark, sf, "documents").select("doc_id", "text").collect()}
    terms = {r.query_id: set(r.query.split()) for r in queries._queries(spark).collect()}
    want = {q: sum(1 for d in good if texts.get(d, set()) & ws) for q, ws in terms.items()}
    got = {r.query_id: r.all_relevant for r in queries._graded(spark, sf).collect()}
    assert got == {q: want[q] for q in got} and max(want.values()) > 20


def test_whole_tables_are_migrated_exported_and_checked(spark, sf):
    nodes = {r.id for r in T.nodes(spark, sf).select("id").collect()}
    assert {r.id for r in queries.migrated_rows(spark, sf).collect()} == nodes
    rows = T.export_json(queries._memory(spark, sf)).collect()
    pairs = {(r.source_id, r.target_id) for r in queries._chain_edges(spark, sf).collect()}
    assert Counter(r.kind for r in rows) == {"node": len(nodes), "edge": len(pairs), "event": len(nodes)}
    values = {k: [json.loads(r.value) for r in rows if r.kind == k] for k in ("node", "edge", "event")}
    assert {v["id"] for v in values["node"]} == {v["id"] for v in values["event"]} == nodes and all("confidence" in v and "created_at" in v for v in values["node"])
    assert {(v["source_id"], v["target_id"]) for v in values["edge"]} == pairs
    assert queries._memory(spark, sf).edges.count() == len(pairs)
    assert {r.check_name: r.violations for r in queries.doctor_checks(spark, sf).collect()}["edges start at nodes"] == 0
    assert {r.n_out for r in queries.entity_snapshot(spark, sf).collect()} == {1}


def test_terms_asked_again_are_joined_once(spark, monkeypatch):
    from engram.operators import graph

    nodes = spark.createDataFrame([("a", "Anna Kern", "entity", "stable"), ("b", "Bernd", "entity", "stable")], "id string, content string, node_type string, lifecycle_state string")
    terms = spark.createDataFrame([("q", "ern"), ("q", "ERN"), ("q", "ern"), ("p", "ann"), ("p", "")], "query_id string, term string")
    joined = []
    monkeypatch.setattr(graph, "small", lambda df: joined.append(df.count()) or df)
    assert {tuple(r) for r in graph.entity_seeds(nodes, terms).collect()} == {("q", "a"), ("q", "b"), ("p", "a")}
    assert joined == [3]


def test_words_are_counted_in_their_text(spark):
    rows = [("a", "The cat, the dog; THE end", "en"), ("b", "", "en"), ("c", None, "de"), ("d", "eins", "de"), ("e", "x " * 3000 + "y", "de")]
    docs = lambda more: spark.createDataFrame(rows + more, "node_id string, content string, user_id string").coalesce(1)
    for more in ([], [("d", "zwei", "de"), ("d", "eins zwei drei", "de")]):
        postings, lengths = search.lexical_index(docs(more))
        words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
        want = Counter((w, i, len(words(t)), u) for i, t, u in rows + more for w in words(t))
        assert Counter({(r.term, r.node_id, r.dl, r.user_id): r.tf for r in postings.collect()}) == want and postings.count() == len(want)
        assert sorted(tuple(r) for r in lengths.collect()) == sorted((i, len(words(t))) for i, t, _ in rows + more)
    plan = search.lexical_index(docs([]))[0]._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan  # no shuffle of words, only of texts


def test_ways_of_all_nodes_equal_steps_one_by_one(spark, monkeypatch):
    from engram.operators import graph

    pairs = [(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n3", "n9"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("t", "s")]
    edges = spark.createDataFrame([(new, old, "supersedes") for old, new in pairs] + [("x", "n0", "mentions")], "source_id string, target_id string, edge_type string")
    nodes = sorted({x for p in pairs for x in p} | {"alone"})
    seeds = spark.createDataFrame([(n,) for n in nodes], "seed string")
    monkeypatch.setattr(graph, "_ways", lambda *a, ways=graph._ways: asked.append(a) or ways(*a))
    asked = []
    for forward in (True, False):
        to = {}
        for a, b in sorted(p if forward else p[::-1] for p in pairs):
            to.setdefault(a, b)
            to[a] = min(to[a], b)
        for most in (1, 5, 100):
            want = set()
            for n in nodes:
                way = [n]
                while len(way) <= most and to.get(way[-1], n) not in way:
                    way.append(to[way[-1]])
                want |= {(n, i, x) for i, x in enumerate(way)}
            got = [tuple(r) for r in graph.supersedence_chain(edges, seeds, "forward" if forward else "backward", most).collect()]
            assert len(got) == len(want) and set(got) == want
    assert len(asked) == 6  # many seeds carry their ways, no row a step in the rounds
    few = [tuple(r) for r in graph.supersedence_chain(edges, seeds.where("seed = 'n0'"), "forward").collect()]
    assert len(asked) == 6 and sorted(few) == sorted(("n0", i, f"n{i}") for i in range(13))


def _shuffled(spark) -> int:
    """Records written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _remembered(spark, n: int, pinned: str):
    """n nodes of two users, some pinned, and what the query's contract needs of them."""
    ids = spark.range(n).withColumn("no", F.col("id"))
    given = {"node_type": "fact", "lifecycle_state": "stable", "epistemic_type": "observed", "confidence": 0.5, "salience_base": 0.5, "confidence_base": 0.5}
    rows = ids.withColumns({"id": F.lpad(F.col("no").cast("string"), 6, "0"), "user_id": F.when(F.col("no") % 2 == 0, "u").otherwise("v"), "content": F.concat(F.lit("word "), F.col("no").cast("string")), "salience": F.when(F.expr(pinned), 1.0).otherwise(0.5)} | {k: F.lit(v) for k, v in given.items()})
    times = {c: X.at("2024-01-01 00:00:00") for c in ("created_at", "updated_at", "valid_from", "last_reinforced_at")}
    return T.migrate(rows.withColumns({"session_id": F.col("id")} | times).drop("no"), S.NODES)


def _ask(spark, nodes, rows, **how):
    vectors = spark.createDataFrame([("000001", [1.0, 0.0])], "node_id string, embedding array<float>")
    asked = spark.createDataFrame([(q, text, user, [1.0, 0.0]) for q, text, user in rows], "query_id string, query string, user_id string, embedding array<float>")
    edges = spark.createDataFrame([], S.EDGES)
    return retrieval.retrieve(nodes, edges, vectors, None, analysis.analyze(asked, T.NOW), T.NOW, **how)


def test_retrieval_leaves_the_nodes_where_they_lie(spark):
    n = 20_000
    nodes = _remembered(spark, n, "no % 2 = 0")
    nodes.write.mode("overwrite").parquet(folder := scratch_folder(spark, "nodes"))
    nodes = spark.read.parquet(folder)
    before = _shuffled(spark)
    rows = _ask(spark, nodes, [("q", "find '77'", None)]).where("rank <= 5").collect()
    assert len(rows) == 5 and _shuffled(spark) - before < 2 * n  # one narrow shuffle of the nodes is for the walk along the edges


def test_pinned_candidates_and_further_hits(spark):
    nodes = _remembered(spark, 40, "no < 4")
    rows = _ask(spark, nodes, [("q", "see '7' and '3' and 21", None), ("p", "see '6' and '9'", "u")], config=S.Packing(lexical_k=1, window=0)).collect()
    paths = {(r.query_id, r.id): (r.paths, r.path_count) for r in rows}
    score = {(r.query_id, r.id): r.lexical_score for r in rows}
    # without a user everybody's pinned nodes, else the user's own
    assert {i for (q, i), (p, _) in paths.items() if q == "q" and "PINNED" in p} == {"000000", "000001", "000002", "000003"}
    assert {i for (q, i), (p, _) in paths.items() if q == "p" and "PINNED" in p} == {"000000", "000002"}
    assert paths["q", "000001"] == (["PINNED", "VECTOR"], 2)
    # 3 is the question's best hit; 7 comes of its name alone; 6 is the user's, 9 is another's
    assert paths["q", "000003"] == (["LEXICAL", "PINNED"], 2) and score["q", "000003"] == 1.0
    assert paths["q", "000007"] == (["LEXICAL"], 1) and ("q", "000021") not in paths
    assert paths["p", "000006"] == (["LEXICAL"], 1) and ("p", "000009") not in paths
    # a pinned node that only a name finds is a candidate already
    late = {r.id: r for r in _ask(spark, nodes, [("q", "see 0 '3'", None)], config=S.Packing(lexical_k=1, window=0)).collect()}["000003"]
    assert late.paths == ["PINNED"] and late.lexical_score == 0.0


def test_deep_ranks_in_two_steps_equal_one(spark):
    scored = spark.range(5000).select(F.concat(F.lit("q"), F.col("id") % 2).alias("query_id"), F.col("id").cast("string").alias("node_id"), (F.col("id") % 97 / 7.0).alias("score"))
    got = {(r.query_id, r.node_id, r.rn) for r in search.best_hits(scored, 1200).collect()}
    want = set()
    for q in ("q0", "q1"):
        own = sorted((r for r in scored.collect() if r.query_id == q), key=lambda r: (-round(r.score, 8), r.node_id))
        want |= {(q, r.node_id, i + 1) for i, r in enumerate(own[:1200])}
    assert got == want


def test_lengths_summed_in_place_give_the_same_scores(spark):
    docs = spark.createDataFrame([("a", "red piano red"), ("b", ""), ("c", None), ("d", "piano in the attic"), ("e", "blue")], "node_id string, content string")
    q = spark.createDataFrame([("q", "red piano"), ("p", "attic"), ("n", "nothing")], "query_id string, query string")
    rows = lambda **how: {(r.query_id, r.node_id, round(r.score, 12), r.rn) for r in search.bm25(docs, q, 10, **how).collect()}
    assert rows(distinct=True) == rows() != set() and rows(distinct=True, hint=F.broadcast) == rows()
    assert search.bm25(docs.where("false"), q, 10, distinct=True).count() == 0
