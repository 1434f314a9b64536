"""Driver queries over the given tables, each through its operator, and their SQL twins in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept, scratch_folder
from engram.operators import analysis, graph, ingest, organizer, packing, quality, research, retrieval, search, store
from engram.sources import tables as T
from engram.streaming import ingest as streams

NOW = T.NOW
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, *columns: str, to: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in columns})


def _events(spark, sf):
    e = T.read(spark, sf, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("ts").alias("timestamp"), F.concat_ws(" ", "event_type", "props").alias("content"), F.sha2(F.concat_ws(" ", "event_type", "props"), 256).alias("content_hash"), F.col("user_id").cast("string").alias("user_id"), F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"), F.element_at(F.array(*map(F.lit, S.SCOPES)), (F.col("user_id") % 6 + 1).cast("int")).alias("scope"))


def query_vector(spark, sf) -> list[float]:
    return T.read(spark, sf, "embeddings").where("vec_id = 0").first().embedding


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Vector and pinned candidates of one query joined to their nodes."""
    v = T.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), "embedding")
    sem = search.vector_topk(v, query_vector(spark, sf), 200).select(F.lit("q").alias("query_id"), F.col("node_id").alias("id"), "score")
    nodes = T.nodes(spark, sf)
    pin = retrieval.pinned(nodes).select(F.lit("q").alias("query_id"), "id", F.lit(0.0).alias("score"))
    merged = retrieval.merge({"VECTOR": (sem, "semantic_score"), "PINNED": (pin, "none")})
    return retrieval.epistemic_filter(merged.join(nodes, "id"))[0]


# --- sources, scans


@query
def events_by_user(spark, sf):
    return T.events_by_user(_events(spark, sf), "7", limit=50).select("id", "timestamp", "content")


@query
def events_by_hash(spark, sf):
    e = _events(spark, sf)
    wanted = e.where("cast(id as int) % 50 = 0").select("content_hash", "user_id").distinct()
    return T.events_by_hash(e, wanted).select("id", "user_id", "content_hash")


@query
def nodes_projection(spark, sf):
    out = T.nodes(spark, sf).select("id", "node_type", "user_id", "session_id", "scope", "content", "lifecycle_state", "epistemic_type", "source_type", "decay_profile", "confidence_base", "salience_base", "reinforcement_boost", "pinned", "ttl_days", "created_at", "last_reinforced_at", "event_time", "valid_to")
    return _r(out, "confidence_base", "salience_base", "reinforcement_boost")


@query
def nodes_filtered_topn(spark, sf):
    return store.query_nodes(T.nodes(spark, sf), node_type="decision", min_confidence=0.5, limit=100).select("id", "created_at", "confidence").transform(_r, "confidence")


@query
def nodes_valid_asof(spark, sf):
    return store.valid_at(T.nodes(spark, sf), "2024-01-15 00:00:00").groupBy("node_type").agg(F.count("*").alias("n"))


@query
def knowledge_asof(spark, sf):
    return store.known_at(T.nodes(spark, sf), "2024-01-10 12:00:00").groupBy("scope").agg(F.count("*").alias("n"))


@query
def event_time_range(spark, sf):
    return store.happened_between(T.nodes(spark, sf), "2024-01-05 00:00:00", "2024-01-06 00:00:00").select("id")


def _stats(by):
    def run(spark, sf):
        return T.statistics(T.nodes(spark, sf), by)

    return run


for _by in ("node_type", "lifecycle_state", "scope"):
    QUERIES[f"stats_by_{_by}"] = _stats(_by)


@query
def info_scan(spark, sf):
    return T.info({"nodes": (T.nodes(spark, sf), "updated_at"), "events": (_events(spark, sf), "timestamp")})


def _memory(spark, sf):
    """Whole nodes, the supersedes edges between them, and whole events."""
    t = T.empty_tables(spark)
    t.nodes, t.edges, t.events = T.nodes(spark, sf), T.migrate(_chain_edges(spark, sf), S.EDGES), T.migrate(_events(spark, sf), S.EVENTS)
    return t


@query
def export_nodes(spark, sf):
    out = T.export_json(_memory(spark, sf))
    return out.select("kind", *[F.get_json_object("value", f"$.{c}").alias(c) for c in ("id", "content", "user_id", "source_id", "target_id")])


@query
def doctor_checks(spark, sf):
    return T.doctor(_memory(spark, sf))


@query
def encrypt_round_trip(spark, sf):
    n = T.nodes(spark, sf).select("id", "content")
    return T.decrypt(T.encrypt(n, ["content"], "0123456789abcdef"), ["content"], "0123456789abcdef")


@query
def migrated_rows(spark, sf):
    old = T.nodes(spark, sf).select("id", F.when(F.col("id") % 2 == 0, F.col("scope")).alias("scope"), "confidence", "salience", "updated_at")
    return T.migrate(old, S.NODES).select("id", "scope", "epistemic_type", "source_type", "decay_profile", "pinned")


# --- lifecycle


@query
def transition_promote(spark, sf):
    n = T.nodes(spark, sf)
    return store.promote(n, n.where("id % 4 = 0").select("id"), NOW).nodes.groupBy("lifecycle_state").agg(F.count("*").alias("n"))


@query
def transition_rejected(spark, sf):
    n = T.nodes(spark, sf)
    return store.deprecate(n, n.where("id % 50 = 0").select("id"), NOW).rejected


@query
def archive_rows(spark, sf):
    n = T.nodes(spark, sf)
    return store.archive(n, n.where("id % 3 = 0").select("id"), NOW).nodes.groupBy("lifecycle_state").agg(F.count("*").alias("n"))


def _chain_pairs(spark, sf):
    n = T.nodes(spark, sf).select("id", "user_id", "node_type", "created_at", F.col("id").cast("long").alias("no"))
    w = Window.partitionBy("user_id", "node_type").orderBy("created_at", "no")
    return n.withColumns({"new_id": F.lead("id").over(w)}).where("new_id IS NOT NULL AND no % 4 <> 0").select(F.col("id").alias("old_id"), "new_id")


@query
def supersede_rows(spark, sf):
    return store.supersede(T.nodes(spark, sf), _chain_pairs(spark, sf), NOW).nodes.where("superseded_by IS NOT NULL").select("id", "superseded_by", "lifecycle_state")


def _contradictions(spark, sf):
    n = T.nodes(spark, sf)
    p = n.where("id % 10 = 5").select(F.col("id").alias("a_id"), (F.col("id").cast("long") + 5).cast("string").alias("b_id"))
    return n, p, store.contradict(n, p, NOW)


@query
def contradiction_edges(spark, sf):
    return _contradictions(spark, sf)[2].edges.select("source_id", "target_id", "edge_type", "user_id")


@query
def contradiction_resolved(spark, sf):
    n, p, c = _contradictions(spark, sf)
    r = store.resolve(c.nodes, c.edges, p.select(F.col("b_id").alias("winner_id"), F.col("a_id").alias("loser_id")), NOW)
    return r.nodes.groupBy("lifecycle_state").agg(F.count("*").alias("n"))


@query
def contradiction_pairs(spark, sf):
    _, _, c = _contradictions(spark, sf)
    return graph.counterparts(c.nodes, c.edges).where("conflict_flag").select("id", "counterpart_id")


@query
def reinforce_update(spark, sf):
    n = T.nodes(spark, sf)
    hits = n.where("id % 7 = 0").select("id", F.lit("x1").alias("evidence_id")).unionByName(n.where("id % 14 = 0").select("id", F.lit("x2").alias("evidence_id")))
    out = store.reinforce(n, hits, NOW).select("id", "reinforcement_boost", "confidence_base", F.size("evidence_refs").alias("n_evidence"))
    return _r(out, "reinforcement_boost", "confidence_base")


@query
def node_updates(spark, sf):
    n = T.nodes(spark, sf)
    up = n.where("id % 9 = 0").select("id", F.upper("content").alias("content"), F.lit("x").alias("user_id"))
    return store.update_nodes(n, up, NOW).select("id", "user_id", "content", "updated_at")


@query
def epistemic_backfill(spark, sf):
    n = T.nodes(spark, sf).withColumn("epistemic_type", F.when(F.col("id") % 2 == 0, F.col("epistemic_type")))
    return store.backfill_epistemic(n).groupBy("node_type", "epistemic_type").agg(F.count("*").alias("n"))


# --- graph


@query
def neighborhood_k(spark, sf):
    seeds = T.read(spark, sf, "customer").where("c_custkey % 50 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("seed"))
    return graph.k_hop(T.tree_edges(spark, sf), seeds, 2)


@query
def shortest_path_len(spark, sf):
    pairs = spark.createDataFrame([("c1", "c2"), ("s1", "c7"), ("r0", "c3"), ("s2", "n3")], "source string, target string")
    return graph.shortest_paths(T.tree_edges(spark, sf), pairs).select("source", "target", "hops")


def _chain_edges(spark, sf):
    return _chain_pairs(spark, sf).select(F.col("new_id").alias("source_id"), F.col("old_id").alias("target_id"), F.lit("supersedes").alias("edge_type"))


@query
def supersedence_chain(spark, sf):
    seeds = T.nodes(spark, sf).select(F.col("id").alias("seed"))
    return graph.supersedence_chain(_chain_edges(spark, sf), seeds, "forward").select("seed", F.col("step").cast("long").alias("step"), "node_id")


@query
def graph_candidate_scores(spark, sf):
    e = _chain_edges(spark, sf)
    seeds = T.nodes(spark, sf).select(F.lit("q").alias("query_id"), F.col("id").alias("seed"))
    return graph.graph_candidates(T.nodes(spark, sf), e, seeds, 3, 150)


def _entities(spark, sf):
    c = T.read(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("content"), F.lit("entity").alias("node_type"))
    o = T.read(spark, sf, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("content"), F.when(F.col("o_orderstatus") == "O", "task").otherwise("fact").alias("node_type"))
    nodes = c.unionByName(o).withColumn("lifecycle_state", F.lit("stable"))
    return nodes, T.tree_edges(spark, sf)


@query
def entity_snapshot(spark, sf):
    return graph.snapshots(*_entities(spark, sf)).select("entity_id", F.coalesce(F.size("facts"), F.lit(0)).cast("long").alias("n_facts"), F.coalesce(F.size("tasks"), F.lit(0)).cast("long").alias("n_tasks"), "n_in", "n_out")


# --- search


@query
def vector_topk(spark, sf):
    return search.vector_topk(T.vectors(spark, sf), query_vector(spark, sf), 20).transform(_r, "score")


@query
def vector_topk_scoped(spark, sf):
    return search.vector_topk(T.vectors(spark, sf), query_vector(spark, sf), 10, "user_id = '3'").transform(_r, "score")


@query
def vector_topk_batch(spark, sf):
    q = T.vectors(spark, sf).where("cast(node_id as int) % 50 = 0").select(F.col("node_id").alias("query_id"), "user_id", "embedding")
    return search.vector_topk_batch(T.vectors(spark, sf), q, 5).select("query_id", "node_id", "score", "rn").transform(_r, "score")


@query
def novelty_score(spark, sf):
    v = T.vectors(spark, sf)
    q = v.where("cast(node_id as int) % 25 = 0").select(F.col("node_id").alias("query_id"), "user_id", "embedding")
    return search.novelty(q, v.where("cast(node_id as int) % 25 <> 0")).select("query_id", "novelty", "salience_change", "is_novel").transform(_r, "novelty")


@query
def remention_hits(spark, sf):
    v = T.vectors(spark, sf)
    q = v.where("cast(node_id as int) % 25 = 0").select(F.col("node_id").alias("query_id"), "user_id", "embedding")
    return search.vector_topk_batch(v.where("cast(node_id as int) % 25 <> 0"), q, 5).where("score >= 0.2").select("query_id", "node_id").distinct()


def _queries(spark):
    return spark.createDataFrame([("q1", "the of and"), ("q2", "que los del"), ("q3", "und die")], "query_id string, query string")


@query
def bm25_topk(spark, sf):
    return search.bm25(T.lexical_docs(spark, sf), _queries(spark), 20).select("query_id", "node_id", "score").transform(_r, "score")


@query
def bm25_minmax(spark, sf):
    return search.minmax(search.bm25(T.lexical_docs(spark, sf), _queries(spark), 20)).select("query_id", "node_id", "score").transform(_r, "score", to=5)


@query
def lexical_match_all(spark, sf):
    return search.bm25(T.lexical_docs(spark, sf), _queries(spark), None, match_all=True).groupBy("query_id").agg(F.count("*").alias("n"))


# --- ranking


@query
def confidence_prior(spark, sf):
    n = T.nodes(spark, sf)
    return n.select("epistemic_type", "source_type", ingest.confidence_prior(F.col("epistemic_type"), F.col("source_type")).alias("prior")).distinct()


@query
def epistemic_filter(spark, sf):
    return retrieval.epistemic_filter(T.nodes(spark, sf))[0].select("id")


@query
def excluded_reasons(spark, sf):
    return retrieval.epistemic_filter(T.nodes(spark, sf))[1].groupBy("reason").agg(F.count("*").alias("n"))


@query
def effective_decay(spark, sf):
    n = T.nodes(spark, sf)
    return n.select("id", X.effective_salience(NOW).alias("salience"), X.effective_confidence(NOW).alias("confidence")).transform(_r, "salience", "confidence")


@query
def candidate_merge(spark, sf):
    out = candidates(spark, sf)
    return out.select("id", "semantic_score", "path_count", F.array_join("paths", ",").alias("paths")).transform(_r, "semantic_score")


@query
def composite_rank(spark, sf):
    out = retrieval.ranked(retrieval.composite(candidates(spark, sf), NOW), 20)
    return out.select("id", "composite_score", F.col("rank").cast("long").alias("rank")).transform(_r, "composite_score")


@query
def current_state_rank(spark, sf):
    c = candidates(spark, sf).withColumn("content", F.when(F.col("id") % 3 == 0, F.concat(F.lit("switched to "), "content")).otherwise(F.col("content")))
    out = retrieval.ranked(retrieval.composite(c, NOW, current_state=True), 20)
    return out.select("id", "composite_score", F.col("rank").cast("long").alias("rank")).transform(_r, "composite_score")


@query
def temporal_affinity(spark, sf):
    n = T.nodes(spark, sf).withColumn("content", F.when(F.col("id") % 2 == 0, F.concat("content", F.lit(" on 2024-01-07"))).otherwise(F.col("content")))
    return n.select("id", retrieval.temporal_affinity(X.at("2024-01-10 00:00:00"), X.at("2024-01-12 00:00:00")).alias("affinity")).transform(_r, "affinity")


@query
def session_expand(spark, sf):
    scored = retrieval.ranked(retrieval.composite(candidates(spark, sf), NOW))
    return retrieval.session_expand(scored, T.nodes(spark, sf)).select("id", "trigger_id", "composite_score").transform(_r, "composite_score")


@query
def cross_scope_hints(spark, sf):
    out = retrieval.cross_scope(retrieval.composite(candidates(spark, sf), NOW), ["personal", "project"])
    return out.select("id", "scope", "composite_score").transform(_r, "composite_score")


@query
def multi_query_fusion(spark, sf):
    v = T.vectors(spark, sf)
    q = v.where("cast(node_id as int) % 50 = 0").select(F.col("node_id").alias("query_id"), "user_id", "embedding")
    hits = search.vector_topk_batch(v, q, 40, per_user=False)
    return retrieval.fuse(hits.select(F.col("query_id").cast("int").alias("query_no"), F.col("node_id").alias("id"), F.round("score", 6).alias("composite_score")), 150)


@query
def abstention_levels(spark, sf):
    n = T.nodes(spark, sf).groupBy("user_id").agg(F.max("confidence").alias("best"))
    return n.select("user_id", retrieval.abstention(F.round("best", 6) - 0.4).alias("abstain"))


# --- packing, formatting


def _packable(spark, sf):
    return retrieval.ranked(retrieval.composite(candidates(spark, sf), NOW))


@query
def pack_sections(spark, sf):
    return packing.with_costs(_packable(spark, sf)).groupBy("section", "tier").agg(F.count("*").alias("n"), F.sum("cost_full").alias("tokens"))


@query
def pack_budget_prefix(spark, sf):
    return packing.prefix_pack(_packable(spark, sf), 300).select("id", F.col("no").cast("long").alias("no"), "used")


@query
def greedy_pack(spark, sf):
    return packing.greedy_pack(_packable(spark, sf), S.Packing(budget=400)).select("id", "no", "section", "level", "tokens")


@query
def format_days_ago(spark, sf):
    return T.nodes(spark, sf).select("id", X.days_ago(F.col("created_at"), X.at(NOW)).alias("label"))


@query
def agg_dedup_lines(spark, sf):
    d = T.read(spark, sf, "documents").select(F.lit("q").alias("query_id"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("timestamp_ntz").alias("event_time"), X.at(NOW).alias("created_at"))
    return packing.aggregation_lines(d).select("id")


@query
def intent_classify(spark, sf):
    rows = ["who is Ada", "tell me about Grace Hopper", "when did it start", "what is linked to billing", "how does it work", "plain words", "notes of 2024-01-02", "how many tests"]
    q = spark.createDataFrame([(r,) for r in rows], "query string")
    return q.select("query", X.intent(F.col("query")).alias("intent"), X.context_type(F.col("query")).alias("kind"), F.array_join(X.entities(F.col("query")), "|").alias("entities"))


# --- ingestion


@query
def qa_pairs(spark, sf):
    return ingest.qa_pairs(T.read(spark, sf, "conversations"))


def _facts(spark, sf):
    n = T.nodes(spark, sf)
    return n.select("id", "user_id", F.col("node_type").alias("subject"), F.when(F.col("id") % 2 == 0, "works_at").otherwise("joined").alias("predicate"), F.col("lifecycle_state").alias("object"), "created_at", F.when(F.col("id") % 3 == 0, "assertion").alias("temporal_intent"))


@query
def fact_conflicts(spark, sf):
    return ingest.fact_conflicts(_facts(spark, sf))


def _notices(spark, sf):
    n = T.nodes(spark, sf)
    text = F.when(F.col("id") % 5 == 0, F.concat(F.lit("Migrated from Task 7 to "), "content")).when(F.col("id") % 5 == 1, F.concat(F.lit("No longer using "), "content")).otherwise(F.col("content"))
    return n.select("id", text.alias("content"))


@query
def change_terms(spark, sf):
    n = _notices(spark, sf)
    return n.where(X.change_signal(F.col("content"))).select("id", F.array_join(X.superseded_terms(F.col("content")), ",").alias("terms"))


@query
def stored_nodes(spark, sf):
    c = T.read(spark, sf, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("content"), F.lit("u").alias("user_id"), F.col("conv_id").cast("string").alias("session_id"), "role")
    return ingest.store(c, NOW).groupBy("node_type", "epistemic_type", "source_type", "confidence", "decay_profile", "ttl_days").agg(F.count("*").alias("n"))


@query
def grounded_facts(spark, sf):
    rows = [("e1", "u1", "Ada Lovelace works at Engines. Bob lives in Paris."), ("e2", "u1", "ada lovelace likes maths"), ("e3", "u2", "Carol uses Spark, and Bob is tall.")]
    x = ingest.grounded(ingest.extract(spark.createDataFrame(rows, "id string, user_id string, content string")))
    return ingest.materialise(x, T.empty_tables(spark).nodes, NOW)[0].select("user_id", "node_type", "content")


@query
def knowledge_profiles(spark, sf):
    n = T.nodes(spark, sf).withColumn("content", F.initcap("content"))
    return ingest.knowledge_profiles(n, 3).select("user_id", "name", "notes")


# --- maintenance


@query
def promote_candidates(spark, sf):
    return organizer.promotable(T.nodes(spark, sf), NOW)


@query
def decay_sweep_actions(spark, sf):
    return organizer.sweep_actions(T.nodes(spark, sf), NOW).select("id", "action")


@query
def ttl_sweep(spark, sf):
    return organizer.expired(T.nodes(spark, sf), "2024-04-20 00:00:00")


@query
def exact_dups(spark, sf):
    d = T.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.col("text").alias("content"), F.lit("stable").alias("lifecycle_state"))
    return organizer.exact_duplicates(d).select("canonical_id", "id")


def _near(spark, sf, t=0.35):
    return organizer.near_duplicates(T.vectors(spark, sf).withColumn("user_id", F.lit("u")), t)


@query
def near_dups(spark, sf):
    return _near(spark, sf, 0.40).select("a_id", "b_id", "similarity").transform(_r, "similarity")


@query
def canonical_pick(spark, sf):
    groups = organizer.group_pairs(_near(spark, sf, 0.40).select("a_id", "b_id"))
    return organizer.canonical(groups, T.nodes(spark, sf)).select("duplicate_id", "canonical_id")


@query
def alias_pairs(spark, sf):
    names = ["Kubernetes", "k8s", "K8S", "Postgres", "PostgreSQL", "pg", "Spark", "spark", "JS", "Rust"]
    e = spark.createDataFrame([(f"e{i}", "u", x, "entity", "stable") for i, x in enumerate(names)], "id string, user_id string, content string, node_type string, lifecycle_state string")
    return organizer.alias_pairs(e)


def _rolled(level):
    def run(spark, sf):
        return organizer.calendar(T.nodes(spark, sf)).where(F.col("level") == level).select("user_id", "period", "n", "salience", "confidence").transform(_r, "salience", "confidence")

    return run


@query
def daily_rollup(spark, sf):
    n = T.nodes(spark, sf).where(F.col("lifecycle_state").isin(S.LIVE))
    rows = n.select("user_id", F.col("created_at").alias("t"), "id", "content", "salience_base", "confidence_base", "created_at")
    return organizer.roll_up(rows, "daily", 2).select("user_id", "period", "n", "salience", "confidence", "content").transform(_r, "salience", "confidence")


@query
def weekly_rollup(spark, sf):
    n = T.nodes(spark, sf).where(F.col("lifecycle_state").isin(S.LIVE))
    rows = n.select("user_id", F.col("created_at").alias("t"), "id", "content", "salience_base", "confidence_base", "created_at")
    return organizer.roll_up(rows, "weekly").select("user_id", "period", "n", "salience", "confidence").transform(_r, "salience", "confidence")


@query
def monthly_rollup(spark, sf):
    n = T.nodes(spark, sf).where(F.col("lifecycle_state").isin(S.LIVE))
    rows = n.select("user_id", F.col("created_at").alias("t"), "id", "content", "salience_base", "confidence_base", "created_at")
    return organizer.roll_up(rows, "monthly").select("user_id", "period", "n", "salience", "confidence").transform(_r, "salience", "confidence")


QUERIES["calendar_daily"] = _rolled("daily")


@query
def oscillation_jaccard(spark, sf):
    n = T.nodes(spark, sf)
    seeds = n.select(F.col("id").alias("seed"))
    chains = graph.supersedence_chain(_chain_edges(spark, sf), seeds, "backward", 10)
    return organizer.oscillations(chains, n).select("seed", "cycles", "penalty")


@query
def greedy_clusters(spark, sf):
    return organizer.greedy_clusters(T.vectors(spark, sf).withColumn("user_id", F.lit("u")), 0.35, 3).select("leader", "node_id")


@query
def cluster_summaries(spark, sf):
    c = organizer.greedy_clusters(T.vectors(spark, sf).withColumn("user_id", F.lit("u")), 0.35, 3)
    return organizer.cluster_summaries(c, T.nodes(spark, sf)).transform(_r, "confidence", "salience")


# --- quality, research, streaming


@query
def quality_metrics(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ["used", "ignored", "corrected", "contradicted"])), (F.col("event_id") % 4 + 1).cast("int"))
    signals = T.read(spark, sf, "events").select(kind.alias("signal_type"), F.col("ts").alias("timestamp"))
    return quality.feedback_rates(quality.recent(signals, NOW, 20)).transform(_r, "used_rate", "ignored_rate", "corrected_rate", "contradicted_rate", "quality_score")


def _graded(spark, sf):
    docs, labels = T.lexical_docs(spark, sf), T.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("node_id"), F.col("quality").alias("grade"))
    every = search.bm25(docs, _queries(spark), None).join(labels, "node_id", "left").na.fill(0, ["grade"])
    total = every.groupBy("query_id").agg(F.sum("grade").alias("all_relevant"))
    hits = search.best_hits(every, 20)
    return hits.join(total, "query_id").select("query_id", F.col("rn").alias("rank"), "grade", "all_relevant")


@query
def precision_recall_at_k(spark, sf):
    return quality.ranking_metrics(_graded(spark, sf), 10).select("query_id", "precision_at_k", "recall_at_k", "f1").transform(_r, "precision_at_k", "recall_at_k", "f1")


@query
def ndcg_mrr(spark, sf):
    return quality.ranking_metrics(_graded(spark, sf), 10).select("query_id", "ndcg_at_k", "mrr").transform(_r, "ndcg_at_k", "mrr")


@query
def hypervector_topk(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", search.tokens(F.col("text")).alias("words")).where("size(words) > 0")
    hv = research.bundle_words(d, "doc_id", dim=64)
    first = research.bundle_words(d.orderBy("doc_id").limit(1), "doc_id", dim=64).first()
    return hv.select("doc_id", F.round(X.cosine(F.col("hv"), F.array(*[F.lit(x) for x in first.hv])), 6).alias("similarity")).orderBy(F.desc("similarity"), "doc_id").limit(10)


@query
def topic_narratives(spark, sf):
    n = T.nodes(spark, sf).select(F.concat_ws("/", "user_id", "node_type").alias("topic"), F.col("id").cast("long").alias("id"), F.col("created_at").alias("day"), "content")
    return research.narratives(n).select("topic", "current_state", F.size("history").cast("long").alias("older"))


@query
def stream_daily_counts(spark, sf):
    schema = T.read(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.drain(streams.daily_counts(stream), scratch_folder(spark, "daily"), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "user_id", "n", F.round("total", 4).alias("total"))


# --- the flagship: one retrieval from candidates to ranked rows


def _world(spark, sf):
    """The nodes, an entity per kind of event, and the edges from nodes to their kind's entity."""
    nodes, events = T.nodes(spark, sf), T.read(spark, sf, "events")
    kinds = kept(events.select(F.col("event_type").alias("content")).distinct())  # every scan of the nodes has them
    given = {"node_type": "entity", "lifecycle_state": "stable", "epistemic_type": "observed", "decay_profile": "slow", "scope": "system"}
    numbers = {"confidence": 0.9, "confidence_base": 0.9, "salience": 0.5, "salience_base": 0.5, "reinforcement_boost": 0.0}
    times = ("created_at", "updated_at", "valid_from", "last_reinforced_at")
    entities = kinds.withColumns({"id": F.concat(F.lit("e:"), "content"), "pinned": F.lit(False)} | {k: F.lit(v) for k, v in (given | numbers).items()} | {t: X.at("2024-01-01 00:00:00") for t in times})
    edges = events.select(F.col("event_id").cast("string").alias("source_id"), F.concat(F.lit("e:"), "event_type").alias("target_id"), F.lit("mentions").alias("edge_type"))
    return T.migrate(nodes, S.NODES).unionByName(T.migrate(entities, S.NODES)), edges


#: A question with a name in quotes and a day, so that all four paths and the temporal term count.
QUESTION = "when did 'purchase' 42 happen on 2024-01-12"


@query
def retrieve(spark, sf):
    nodes, edges = _world(spark, sf)
    vectors = T.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), "embedding")
    asked = spark.createDataFrame([("q", QUESTION, None, query_vector(spark, sf))], "query_id string, query string, user_id string, embedding array<float>").coalesce(1)
    scored = retrieval.retrieve(nodes, edges, vectors, None, analysis.analyze(asked, NOW), NOW).where("rank <= 50")
    terms = ["semantic_score", "lexical_score", "graph_proximity", "composite_score"]
    return scored.select("id", "node_type", *terms, F.array_join("paths", ",").alias("paths"), F.col("rank").cast("long").alias("rank")).transform(_r, *terms)
