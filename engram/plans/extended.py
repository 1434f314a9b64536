"""Further driver queries, each with its SQL twin beside it. `nodes` in SQL is the projection of `oracles`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.operators import analysis, graph, ingest, jobs, organizer, packing, quality, research, retrieval, search, store, write
from engram.plans import queries as Q
from engram.plans.oracles import _AGO, _DECAY, _N, _NOW, _PAIRS, _nodes
from engram.sources import tables as T

NOW = T.NOW
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


_ACTIVE, _LIVE = "('tentative','stable')", "('tentative','stable','contested')"
_TREE = """edges AS (SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


# --- point reads, appends, reports


@query(_nodes(f"SELECT id, lifecycle_state, content FROM nodes WHERE id = '5' AND lifecycle_state IN {_ACTIVE}"))
def node_by_id(spark, sf):
    return store.get_node(T.nodes(spark, sf), "5").select("id", "lifecycle_state", "content")


@query(f"WITH {_TREE} SELECT source_id, target_id FROM edges WHERE target_id = 'n3'")
def edges_to_node(spark, sf):
    return store.query_edges(T.tree_edges(spark, sf), target_id="n3", edge_type="part_of").select("source_id", "target_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id, event_type || ' ' || props AS content FROM events WHERE event_id = 7")
def event_by_id(spark, sf):
    return T.event(Q._events(spark, sf), "7").select("id", "content")


@query("SELECT user_id, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS user_id FROM events UNION ALL SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_id % 100 = 0) GROUP BY 1")
def event_append(spark, sf):
    e = Q._events(spark, sf)
    known, fresh = e.where("cast(id as int) % 2 = 0"), e.where("cast(id as int) % 100 = 0").withColumn("id", F.concat(F.lit("x"), "id"))
    return T.append_events(e, known.unionByName(fresh).unionByName(fresh)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT 'part_of' AS edge_type, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) AS n")
def stats_by_edge_type(spark, sf):
    return T.statistics(T.tree_edges(spark, sf), "edge_type")


@query(_nodes("SELECT round(avg(confidence), 6) AS avg_confidence, round(avg(salience), 6) AS avg_salience FROM nodes"))
def node_averages(spark, sf):
    return T.averages(T.nodes(spark, sf)).transform(Q._r, "avg_confidence", "avg_salience")


@query(f"WITH RECURSIVE {_N} {_PAIRS}, ahead AS (SELECT id AS seed, 0 AS step, id AS node_id FROM nodes UNION ALL SELECT seed, step + 1, new_id FROM ahead JOIN pairs ON node_id = old_id WHERE step < 100), behind AS (SELECT id AS seed, 0 AS step, id AS node_id FROM nodes UNION ALL SELECT seed, step - 1, old_id FROM behind JOIN pairs ON node_id = new_id WHERE step > -100) SELECT seed, min(step) AS first_step, max(step) AS last_step, count(*) AS n, count(CASE WHEN lifecycle_state = 'stable' THEN 1 END) AS stable FROM (SELECT * FROM ahead UNION ALL SELECT * FROM behind WHERE step < 0) JOIN nodes ON node_id = id GROUP BY 1")
def chain_report(spark, sf):
    n = T.nodes(spark, sf)
    rows = graph.chain_report(n, Q._chain_edges(spark, sf), n.select(F.col("id").alias("seed")))
    return rows.groupBy("seed").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("n"), F.count_if(F.col("lifecycle_state") == "stable").alias("stable"))


# --- graph


@query(_nodes(f"""SELECT seed, node_id, hop FROM (SELECT seed, node_id, min(hop) AS hop FROM (SELECT a AS seed, b AS node_id, 1 AS hop FROM links UNION ALL SELECT x.a, y.b, 2 FROM links x JOIN links y ON x.b = y.a) WHERE seed <> node_id GROUP BY 1, 2) JOIN nodes ON id = node_id
  WHERE lifecycle_state IN {_ACTIVE} AND valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20') AND confidence >= 0.4""", _PAIRS + ", links AS (SELECT old_id AS a, new_id AS b FROM pairs UNION SELECT new_id, old_id FROM pairs)"))
def neighborhood_nodes(spark, sf):
    n = T.nodes(spark, sf)
    return graph.neighborhood(n, Q._chain_edges(spark, sf), n.select(F.col("id").alias("seed")), 2, min_confidence=0.4, valid="2024-01-20 00:00:00").select("seed", "node_id", "hop")


@query("SELECT DISTINCT q AS query_id, 'c' || c_custkey AS seed FROM customer, (VALUES ('q1', 'customer#00000001'), ('q1', '#000000012'), ('q2', 'CUSTOMER#000000100')) v(q, t) WHERE contains(lower(c_name), lower(t))")
def entity_seed_match(spark, sf):
    nodes, _ = Q._entities(spark, sf)
    terms = spark.createDataFrame([("q1", "customer#00000001"), ("q1", "#000000012"), ("q2", "CUSTOMER#000000100")], "query_id string, term string")
    return graph.entity_seeds(nodes, terms)


@query(f"WITH {_TREE} SELECT CASE WHEN source_id LIKE 's%' AND CAST(substr(source_id, 2) AS INT) % 2 = 1 THEN 's' || (CAST(substr(source_id, 2) AS INT) + 1) ELSE source_id END AS source_id, target_id, 'part_of' AS edge_type FROM edges")
def edge_transfer(spark, sf):
    s = T.read(spark, sf, "supplier").where("s_suppkey % 2 = 1").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("duplicate_id"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("canonical_id"))
    return graph.transfer_edges(T.tree_edges(spark, sf), s).select("source_id", "target_id", "edge_type")


@query(_nodes("SELECT id, CAST(CASE WHEN no % 2 = 0 AND no + 1 IN (SELECT no FROM nodes) THEN n_evidence + CASE WHEN (no + 1) % 3 = 0 THEN 1 ELSE 0 END ELSE n_evidence END AS INT) AS n FROM nodes"))
def evidence_merge(spark, sf):
    n = T.nodes(spark, sf)
    merged = n.where("cast(id as int) % 2 = 1").select(F.col("id").alias("duplicate_id"), (F.col("id").cast("int") - 1).cast("string").alias("canonical_id"))
    return organizer.merge_evidence(n, merged).select("id", F.size("evidence_refs").alias("n"))


@query("SELECT 'c' || c_custkey AS entity_id, 'Entity: ' || c_name || coalesce('. Known facts: ' || f, '') || coalesce('. Active tasks: ' || t, '') || '.' AS summary FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority || ' ' || o_orderkey END, ', ' ORDER BY 'o' || o_orderkey) AS f, string_agg(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority || ' ' || o_orderkey END, ', ' ORDER BY 'o' || o_orderkey) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def entity_summaries(spark, sf):
    return graph.snapshots(*Q._entities(spark, sf)).select("entity_id", "summary")


@query("SELECT 'c' || c_custkey AS entity_id, '[Entity Snapshot: ' || c_name || ']' || chr(10) || '  ID: c' || c_custkey || chr(10) || '  Generated: 2024-02-01T00:00:00' || coalesce(chr(10) || '  Facts:' || chr(10) || f, '') || coalesce(chr(10) || '  Tasks:' || chr(10) || t, '') || chr(10) || '  Relationships: ' || (coalesce(n, 0) + 1) || ' edges' AS text FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(CASE WHEN o_orderstatus <> 'O' THEN '    - ' || o_orderpriority || ' ' || o_orderkey END, chr(10) ORDER BY 'o' || o_orderkey) AS f, string_agg(CASE WHEN o_orderstatus = 'O' THEN '    - ' || o_orderpriority || ' ' || o_orderkey END, chr(10) ORDER BY 'o' || o_orderkey) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def snapshot_texts(spark, sf):
    return graph.render_snapshots(graph.snapshots(*Q._entities(spark, sf)), X.at(NOW))


# --- search


_TOKENS = r"toks AS (SELECT CAST(doc_id AS VARCHAR) AS node_id, lang, source, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM documents)"


@query(f"WITH {_TOKENS}, p AS (SELECT node_id, unnest(ts) AS term FROM toks) SELECT term, count(DISTINCT node_id) AS df, count(*) AS tf FROM p GROUP BY 1 ORDER BY tf DESC, term LIMIT 100")
def lexical_index_terms(spark, sf):
    postings, _ = search.lexical_index(T.lexical_docs(spark, sf))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).orderBy(F.desc("tf"), "term").limit(100)


@query(rf"""WITH {_TOKENS}, qs(query_id, asker, term) AS (VALUES ('q1', 'en', 'the'), ('q1', 'en', 'of'), ('q2', 'es', 'que'), ('q2', 'es', 'los')),
  st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM toks), tf AS (SELECT node_id, lang, term, dl, count(*) AS tf FROM (SELECT node_id, lang, unnest(ts) AS term, len(ts) AS dl FROM toks) WHERE term IN (SELECT term FROM qs) GROUP BY ALL),
  dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sc AS (SELECT query_id, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN dfs USING (term) JOIN qs USING (term), st WHERE lang = asker GROUP BY query_id, node_id)
  SELECT query_id, node_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, node_id) <= 20""")
def bm25_of_user(spark, sf):
    q = spark.createDataFrame([("q1", "the of", "en"), ("q2", "que los", "es")], "query_id string, query string, user_id string")
    postings, lengths = search.lexical_index(T.lexical_docs(spark, sf))
    return search.bm25_indexed(postings, lengths, q, 20).select("query_id", "node_id", "score").transform(Q._r, "score")


@query("SELECT CAST(vec_id AS VARCHAR) AS node_id FROM embeddings WHERE vec_id % 3 <> 0")
def index_delete(spark, sf):
    v = T.vectors(spark, sf)
    return search.delete_indexed(v, v.where("cast(node_id as int) % 3 = 0")).select("node_id")


# --- questions


_ASKED = ["When did Ada Lovelace move, 2024-01-05 or yesterday?", "how many tests ran 2 weeks ago", "what do I use now", "is it related to billing", "did we talk about 'red pens' recently?", "plain words", "notes of March 3, 2023"]


@query(f"""SELECT * FROM (VALUES
  ('{_ASKED[0]}', 'entity_lookup', 'Ada Lovelace', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-31 00:00:00', false, false, true),
  ('{_ASKED[1]}', 'temporal', '', TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-18 00:00:00', true, false, false),
  ('{_ASKED[2]}', 'factual', '', NULL, NULL, false, true, false),
  ('{_ASKED[3]}', 'relational', '', NULL, NULL, false, false, false),
  ('{_ASKED[4].replace("'", "''")}', 'temporal', 'red pens', NULL, NULL, false, true, true),
  ('{_ASKED[5]}', 'semantic', '', NULL, NULL, false, false, false),
  ('{_ASKED[6]}', 'entity_lookup', 'March', TIMESTAMP '2023-03-03 00:00:00', TIMESTAMP '2023-03-03 00:00:00', false, false, false)
  ) v(query, intent, entities, time_from, time_to, is_aggregation, is_current_state, is_episodic)""")
def analyze_queries(spark, sf):
    q = spark.createDataFrame([(x, x) for x in _ASKED], "query_id string, query string")
    return analysis.analyze(q, NOW).select("query", "intent", F.array_join("entities", "|").alias("entities"), "time_from", "time_to", "is_aggregation", "is_current_state", "is_episodic")


@query("SELECT * FROM (VALUES ('a', 0, 'books'), ('a', 1, 'read'), ('a', 2, 'year'), ('a', 3, 'books read'), ('a', 4, 'read year'), ('b', 0, 'hikes')) v(query_id, no, query)")
def fan_out_terms(spark, sf):
    return retrieval.fan_out_terms(spark.createDataFrame([("a", "How many books did I read last year?"), ("b", "count my hikes"), ("c", "how many")], "query_id string, query string"))


@query("SELECT * FROM (VALUES ('a', 'COMPUTED: ''3 weeks ago'' from 2024-02-01 = approximately 2024-01-11 (21 days before)'), ('b', 'COMPUTED: ''1 months ago'' from 2024-02-01 = approximately 2024-01-02 (30 days before)' || chr(10) || 'COMPUTED: ''10 days ago'' from 2024-02-01 = approximately 2024-01-22 (10 days before)'), ('c', 'COMPUTED: ''last Thursday'' from 2024-02-01 = 2024-01-25 (7 days before)'), ('d', 'COMPUTED: ''past weekend'' = Saturday 2024-01-27 (5 days before 2024-02-01)'), ('e', '')) v(query_id, text)")
def computed_dates(spark, sf):
    rows = [("a", "what did I do three weeks ago"), ("b", "10 days ago, or a month ago?"), ("c", "the talk last Thursday"), ("d", "what about the weekend"), ("e", "nothing")]
    q = spark.createDataFrame(rows, "query_id string, query string")
    return q.select("query_id", packing.time_offsets(F.col("query"), X.at(NOW)).alias("text"))


# --- texts for a prompt: a user's nodes, newest first


def _shown(spark, sf):
    n = T.nodes(spark, sf).withColumn("query_id", F.col("user_id"))
    rows = n.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("created_at"), "id")))
    return rows, n.select("query_id").distinct().withColumn("query", F.lit("what happened 3 days ago"))


_SHOWN = f", shown AS (SELECT *, coalesce(event_time, created_at) AS t, date_diff('day', CAST(coalesce(event_time, created_at) AS DATE), CAST({_NOW} AS DATE)) AS d FROM (SELECT *, user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS rank FROM nodes) WHERE rank <= 50)"
_TODAY = "'Today''s date: 2024-02-01' || chr(10)"
_OFFSET = "'COMPUTED: ''3 days ago'' from 2024-02-01 = approximately 2024-01-29 (3 days before)' || chr(10)"
_LINE = "'[' || i || '] (' || strftime(t, '%Y-%m-%d') || {mark} || ') ' || content"


def _text(mark: str, order: str, head: str, rows: str = "shown") -> str:
    return _nodes(f"SELECT query_id, {head} || string_agg({_LINE.format(mark=mark)}, chr(10) ORDER BY i) AS text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM {rows}) GROUP BY query_id", _SHOWN)


@query(_text(f"', ' || {_AGO}", "t, rank", f"{_TODAY} || {_OFFSET} || chr(10)"))
def format_temporal_text(spark, sf):
    return packing.format_temporal(*_shown(spark, sf), NOW)


@query(_text("''", "rank", f"{_TODAY} || chr(10)"))
def format_default_text(spark, sf):
    return packing.format_default(_shown(spark, sf)[0], NOW)


_MARK = "CASE WHEN i = n THEN ' [MOST RECENT — USE THIS VALUE]' WHEN i - 1 >= n - 3 THEN ' [RECENT]' WHEN i - 1 < n - 5 THEN ' [OLDER]' ELSE '' END"


@query(_text(_MARK, "t, rank", "'" + packing.KNOWLEDGE_UPDATE_HEAD.replace("\n", "' || chr(10) || '") + "'"))
def format_updates_text(spark, sf):
    return packing.format_updates(_shown(spark, sf)[0])


_RULES = packing.AGGREGATION_RULES.replace("'", "''").replace("\n", "' || chr(10) || '")


@query(_text(f"', ' || {_AGO}", "t, rank", f"'AGGREGATION TASK: The question asks for a count, total, or list.' || chr(10) || 'Below are ' || max(n) || ' unique entries (duplicates removed) in chronological order.' || chr(10) || '{_RULES}' || {_TODAY} || {_OFFSET} || chr(10)", "(SELECT * FROM shown QUALIFY row_number() OVER (PARTITION BY query_id, left(lower(trim(content)), 100) ORDER BY t, id) = 1)"))
def format_aggregation_text(spark, sf):
    return packing.format_aggregation(*_shown(spark, sf), NOW)


@query(_nodes(f"SELECT query_id, '## User Profile' || chr(10) || '### Known Facts' || chr(10) || string_agg('- ' || content || CASE WHEN lifecycle_state = 'tentative' THEN ' (tentative)' ELSE '' END, chr(10) ORDER BY confidence DESC, rank) || chr(10) AS text FROM shown WHERE node_type = 'fact' AND lifecycle_state IN {_ACTIVE} GROUP BY 1", _SHOWN))
def profile_text(spark, sf):
    return packing.profile(_shown(spark, sf)[0])


_CONTESTED = f", con AS (SELECT *, CASE WHEN no % 2 = 0 THEN CAST(no + 150 AS VARCHAR) END AS other_id FROM shown), lines AS (SELECT a.query_id, a.rank, CASE WHEN b.id IS NULL THEN '- CONTESTED: \"' || a.content || '\" (contradicting memory not in results)' WHEN a.t >= b.t THEN '- NEWER: \"' || a.content || '\" vs OLDER: \"' || b.content || '\"' ELSE '- NEWER: \"' || b.content || '\" vs OLDER: \"' || a.content || '\"' END AS line FROM con a LEFT JOIN con b ON a.query_id = b.query_id AND a.other_id = b.id WHERE a.other_id IS NOT NULL AND (b.id IS NULL OR b.other_id IS DISTINCT FROM a.id OR a.rank < b.rank))"


@query(_nodes("SELECT query_id, '" + packing.CONFLICT_HEAD.replace("\n", "' || chr(10) || '") + "' || string_agg(line, chr(10) ORDER BY rank) || chr(10) AS text FROM lines GROUP BY 1", _SHOWN + _CONTESTED))
def conflict_text(spark, sf):
    rows, _ = _shown(spark, sf)
    no = F.col("id").cast("long")
    return packing.conflicts(rows.withColumns({"conflict_flag": no % 2 == 0, "counterpart_id": F.when(no % 2 == 0, (no + 150).cast("string"))}))


# --- ranking extras


@query(_nodes("SELECT id, round(CASE WHEN r <= 100 THEN 0.7 / (1 + exp(-(length(content) / 10.0::DOUBLE - 1))) + 0.3 * confidence ELSE confidence END, 6) AS reranked FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, id) AS r FROM nodes)"))
def rerank_scores(spark, sf):
    n = T.nodes(spark, sf).withColumns({"query_id": F.col("user_id"), "query": F.lit("x"), "composite_score": F.col("confidence"), "path_score": F.lit(0.0)})
    out = retrieval.rerank(retrieval.ranked(n), lambda q, c: c.str.len() / 10 - 1)
    return out.select("id", "reranked").transform(Q._r, "reranked")


@query(_nodes("SELECT user_id AS target_id, 'RETRIEVAL_REQUEST' AS op_type, count(*) AS n, round(max(confidence), 6) AS best FROM nodes GROUP BY 1"))
def retrieval_log_rows(spark, sf):
    n = T.nodes(spark, sf).select(F.col("user_id").alias("query_id"), F.col("confidence").alias("composite_score"))
    out = retrieval.retrieval_log(n, NOW)
    return out.select("target_id", "op_type", F.get_json_object("payload", "$.n").cast("long").alias("n"), F.get_json_object("payload", "$.best").cast("double").alias("best")).transform(Q._r, "best")


# --- writing


@query(_nodes("SELECT new_id, old_id FROM pairs JOIN nodes o ON old_id = o.id JOIN nodes n ON new_id = n.id WHERE n.no % 5 = 0 AND (contains(o.content, 'task') OR contains(o.content, '7'))", _PAIRS))
def store_supersedence(spark, sf):
    n = T.nodes(spark, sf)
    near = Q._chain_pairs(spark, sf).join(n.select(F.col("id").alias("old_id"), "content"), "old_id").select(F.col("new_id").alias("query_id"), F.col("old_id").alias("node_id"), "content")
    return ingest.store_supersedence(Q._notices(spark, sf), near).select("new_id", "old_id")


def _memory(spark, sf):
    """Nodes that have a vector, under the vector's label as user; every 25th is a new message instead."""
    n = T.nodes(spark, sf).join(T.vectors(spark, sf).select(F.col("node_id").alias("id"), F.col("user_id").alias("label"), "embedding"), "id").withColumn("user_id", F.col("label")).drop("label")
    n = n.withColumn("node_type", F.when(F.col("id").cast("int") % 4 == 1, "instruction").otherwise(F.col("node_type")))
    old, new = n.where("cast(id as int) % 25 <> 0"), n.where("cast(id as int) % 25 = 0")
    t = T.empty_tables(spark)
    t = replace(t, nodes=T.migrate(old.drop("embedding"), S.NODES), vectors=T.migrate(old.select(F.col("id").alias("node_id"), "user_id", "embedding"), S.VECTORS))
    kind = F.element_at(F.split("content", " "), 1)
    text = F.when(F.col("id").cast("int") % 50 == 0, F.concat(F.lit("Migrated from "), kind, F.lit(" to paper"))).otherwise(F.col("content"))
    session = F.concat(F.lit("s"), F.col("user_id"))
    role = F.when(F.col("id").cast("int") % 50 == 0, "user").otherwise("assistant")
    return t, new.select("id", text.alias("content"), "user_id", session.alias("session_id"), role.alias("role"), F.col("created_at").alias("timestamp"), "embedding")


_STORE = f"""
, mem AS (SELECT n.id, n.no, CASE WHEN no % 4 = 1 THEN 'instruction' ELSE node_type END AS node_type, CAST(label AS VARCHAR) AS user_id, content, lifecycle_state, n_evidence, reinforcement_boost, embedding::DOUBLE[] AS v FROM nodes n JOIN embeddings ON vec_id = no),
near AS (SELECT a.id AS new_id, a.no AS new_no, split_part(a.content, ' ', 1) AS kind, b.id, b.node_type, b.content, b.lifecycle_state, list_cosine_similarity(a.v, b.v) AS score, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.id) AS rn
  FROM mem a JOIN mem b USING (user_id) WHERE a.no % 25 = 0 AND b.no % 25 <> 0 AND b.lifecycle_state IN {_LIVE}),
hits AS (SELECT id, count(DISTINCT new_id) AS refs FROM near WHERE rn <= 5 AND lifecycle_state IN {_ACTIVE} AND (score >= 0.2 OR (node_type = 'instruction' AND score >= 0.25)) GROUP BY 1),
gone AS (SELECT id, min(new_id) AS new_id FROM near WHERE rn <= 10 AND lifecycle_state IN {_ACTIVE} AND new_no % 50 = 0 AND contains(lower(content), kind) GROUP BY 1),
fresh AS (SELECT a.id, least(greatest(1 - coalesce(max(CASE WHEN rn <= 5 THEN score END), 0), 0.0), 1.0) AS novelty FROM mem a LEFT JOIN near ON new_id = a.id WHERE a.no % 25 = 0 GROUP BY 1),
msg AS (SELECT m.id, m.no, m.user_id, n.created_at, CASE WHEN m.no % 50 = 0 THEN 'user' ELSE 'assistant' END AS role FROM mem m JOIN nodes n ON n.id = m.id WHERE m.no % 25 = 0),
twos AS (SELECT id FROM (SELECT id, role, lag(role) OVER (PARTITION BY user_id ORDER BY created_at, id) AS p FROM msg) WHERE p <> role)
"""


_WORTH = "CASE WHEN novelty >= 0.7 THEN 0.65 WHEN novelty <= 0.3 THEN 0.4 ELSE 0.5 END::DOUBLE"


@query(_nodes(f"""SELECT m.id, CASE WHEN g.new_id IS NOT NULL THEN 'superseded' ELSE lifecycle_state END AS lifecycle_state, g.new_id AS superseded_by, CAST(n_evidence + coalesce(refs, 0) AS INT) AS refs, NULL::DOUBLE AS salience FROM mem m LEFT JOIN gone g ON g.id = m.id LEFT JOIN hits t ON t.id = m.id WHERE no % 25 <> 0
  UNION ALL SELECT id, 'tentative', NULL, 1, {_WORTH} FROM fresh UNION ALL SELECT t.id || '+', 'tentative', NULL, 1, {_WORTH} FROM twos t JOIN fresh f ON f.id = t.id""", _STORE))
def stored_batch(spark, sf):
    tables, messages = _memory(spark, sf)
    out = write.store_batch(tables, messages, NOW, write.StoreConfig(remention=0.2, instruction=0.25)).nodes
    new = (F.col("id").try_cast("int") % 25 == 0) | F.col("id").endswith("+")
    return out.select("id", "lifecycle_state", "superseded_by", F.size("evidence_refs").alias("refs"), F.when(new, F.round("salience", 6)).alias("salience"))


_SAID = [("e1", "u1", "Ada Lovelace works at Engines. Ada Lovelace knows Bob. Bob lives in Paris."), ("e2", "u1", "ada likes maths"), ("e3", "u2", "Carol uses Spark, and Bob is tall."), ("e4", None, "nobody"), ("e5", "u2", "  ")]


@query("""SELECT * FROM (VALUES ('edge', 'u1', 'ada lovelace has_fact Ada Lovelace works_at Engines'), ('edge', 'u1', 'bob has_fact Bob lives_in Paris'), ('edge', 'u1', 'ada lovelace relates_to Bob'), ('edge', 'u2', 'carol has_fact Carol uses Spark'), ('edge', 'u2', 'bob has_fact Bob is tall'),
  ('node', 'u1', 'entity Ada Lovelace'), ('node', 'u1', 'entity Bob'), ('node', 'u1', 'entity Engines'), ('node', 'u1', 'entity Paris'), ('node', 'u2', 'entity Carol'), ('node', 'u2', 'entity Spark'), ('node', 'u2', 'entity Bob'),
  ('node', 'u1', 'fact Ada Lovelace works_at Engines'), ('node', 'u1', 'fact Bob lives_in Paris'), ('node', 'u2', 'fact Carol uses Spark'), ('node', 'u2', 'fact Bob is tall'), ('dead', NULL, 'e4 no user'), ('dead', NULL, 'e5 no text')) v(kind, user_id, what)""")
def ingested_batch(spark, sf):
    tables = T.empty_tables(spark)
    out, dead = write.ingest_batch(tables, spark.createDataFrame(_SAID, "id string, user_id string, content string").withColumn("scope", F.lit("personal")), NOW)
    n = out.nodes.select("id", "content")
    edges = out.edges.join(n.select(F.col("id").alias("source_id"), F.lower("content").alias("a")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("content").alias("b")), "target_id")
    rows = out.nodes.select(F.lit("node").alias("kind"), "user_id", F.concat_ws(" ", "node_type", "content").alias("what"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("kind"), "user_id", F.concat_ws(" ", "a", "edge_type", "b").alias("what")))
    return rows.unionByName(dead.select(F.lit("dead").alias("kind"), F.lit(None).cast("string").alias("user_id"), F.concat_ws(" ", "id", "reason").alias("what")))


# --- upkeep


@query(_nodes(f"SELECT no::VARCHAR AS old_id, session_id AS leader FROM nodes WHERE confidence < 0.8 AND date_diff('microsecond', created_at, {_NOW}) / 86400000000.0 > 7"))
def forget_candidates(spark, sf):
    n = T.nodes(spark, sf)
    return organizer.forgettable(n.select(F.col("session_id").alias("leader"), F.col("id").alias("node_id")), n, NOW)


@query(_nodes(f"SELECT user_id, strftime(created_at, '%Y-%m-%d') AS period FROM nodes WHERE lifecycle_state IN {_LIVE} GROUP BY 1, 2 HAVING count(*) >= 5 AND NOT ends_with(period, '1')"))
def new_periods(spark, sf):
    told = organizer.calendar(T.nodes(spark, sf)).where("level = 'daily'")
    return organizer.new_periods(told, told.where(F.col("period").endswith("1"))).select("user_id", "period")


@query(_nodes(f"SELECT user_id, period, sum(shown)::BIGINT AS edges, count(*) AS n FROM (SELECT user_id, strftime(created_at, '%Y-%m') AS period, least(count(*), 10) AS shown FROM nodes WHERE lifecycle_state IN {_LIVE} GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1, 2"))
def summary_nodes(spark, sf):
    n = T.nodes(spark, sf).where(F.col("lifecycle_state").isin(S.LIVE))
    nodes, edges = organizer.summary_nodes(organizer.roll_up(n.select("user_id", F.col("created_at").alias("t"), "id", "content", "salience_base", "confidence_base", "created_at"), "monthly"), NOW)
    return nodes.select(F.col("id").alias("source_id"), "user_id", F.get_json_object("metadata", "$.period").alias("period")).join(edges.select("source_id"), "source_id").groupBy("user_id", "period").agg(F.count("*").alias("edges"), F.countDistinct("source_id").alias("n"))


_JOBS = f"""
, j0 AS (SELECT id, no, node_type, ttl_days, pinned, created_at, s_moved, c_moved, CASE WHEN lifecycle_state = 'tentative' AND date_diff('microsecond', created_at, {_NOW}) / 86400000000.0 >= 7 AND n_evidence >= 1 THEN 'stable' ELSE lifecycle_state END AS st FROM dec),
j1 AS (SELECT *, CASE WHEN st IN {_LIVE} AND NOT pinned AND (node_type NOT IN ('entity', 'fact') OR ttl_days IS NOT NULL) THEN CASE WHEN s_moved < 0.05 THEN 'archived' WHEN c_moved < 0.15 THEN CASE WHEN st = 'contested' THEN 'deprecated' ELSE 'archived' END WHEN s_moved < 0.10 AND c_moved < 0.40 THEN 'archived' ELSE st END ELSE st END AS st1 FROM j0),
j2 AS (SELECT *, CASE WHEN ttl_days IS NOT NULL AND NOT pinned AND created_at + to_days(ttl_days) < {_NOW} THEN 'archived' ELSE st1 END AS st2 FROM j1)
"""


@query(_nodes("SELECT id, st2 AS lifecycle_state FROM j2", _DECAY + _JOBS))
def organize_pass(spark, sf):
    t = replace(T.empty_tables(spark), nodes=T.migrate(T.nodes(spark, sf), S.NODES), vectors=None)
    done = jobs.organize(t, NOW, ["promote", "decay_sweep", "archive", "tombstone_sweep", "centrality_boost", "no_such_job"])
    return done[-1].tables.nodes.select("id", "lifecycle_state")


@query("SELECT * FROM (VALUES ('promote', 'done'), ('decay_sweep', 'done'), ('archive', 'done'), ('feedback_apply', 'done'), ('centrality_boost', 'stub'), ('tombstone_sweep', 'done'), ('snapshot_generation', 'done'), ('no_such_job', 'skipped')) v(job, status)")
def job_statuses(spark, sf):
    t = replace(T.empty_tables(spark), nodes=T.migrate(T.nodes(spark, sf), S.NODES))
    names = ["promote", "decay_sweep", "archive", "tombstone_sweep", "centrality_boost", "feedback_apply", "snapshot_generation", "no_such_job"]
    return spark.createDataFrame([(r.job, r.status) for r in jobs.organize(t, NOW, names)], "job string, status string")


@query("""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lower(trim(text, ' ')) AS k FROM documents), g AS (SELECT k, min(CAST(id AS BIGINT)) AS first FROM d GROUP BY 1 HAVING count(*) > 1)
  SELECT d.id, CASE WHEN CAST(d.id AS BIGINT) <> first THEN CAST(first AS VARCHAR) END AS superseded_by FROM d LEFT JOIN g USING (k)""")
def deduplicated_nodes(spark, sf):
    d = T.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.col("text").alias("content"), F.lit("stable").alias("lifecycle_state"), F.lit(0.5).alias("confidence_base"), (F.lit(NOW).cast("timestamp_ntz") + F.make_dt_interval(F.col("doc_id").cast("int"))).alias("created_at"), F.array().cast("array<string>").alias("evidence_refs"))
    t = replace(T.empty_tables(spark), nodes=T.migrate(d, S.NODES), vectors=None)
    return jobs.run_job("deduplicate", t, NOW).tables.nodes.select("id", "superseded_by")


_NAMES = [("e0", "Kubernetes"), ("e1", "k8s"), ("e2", "K8S"), ("e3", "pg"), ("e4", "PostgreSQL"), ("e5", "spark"), ("e6", "Spark"), ("e7", "Rust"), ("e8", "Rusty")]


@query("SELECT * FROM (VALUES ('e1', 'e0', 'supersedes'), ('e2', 'e0', 'supersedes'), ('e3', 'e4', 'supersedes'), ('e6', 'e5', 'supersedes'), ('e8', 'e7', 'relates_to'), ('x', 'e0', 'mentions')) v(target_id, source_id, edge_type)")
def alias_resolution(spark, sf):
    rows = spark.createDataFrame(_NAMES, "id string, content string").withColumns({"user_id": F.lit("u"), "node_type": F.lit("entity"), "lifecycle_state": F.lit("stable"), "confidence_base": F.lit(0.5), "created_at": X.at(NOW), "evidence_refs": F.array("id")})
    nodes = T.migrate(rows, S.NODES)
    edges = T.migrate(spark.createDataFrame([("m", "e1", "x", "mentions", "u")], "id string, source_id string, target_id string, edge_type string, user_id string"), S.EDGES)
    aliases = organizer.alias_pairs(nodes).unionByName(spark.createDataFrame([("e7", "e8", "semantic", 0.86)], "a_id string, b_id string, reason string, similarity double"))
    return organizer.resolve_aliases(nodes, edges, aliases, NOW)[1].select("target_id", "source_id", "edge_type")


@query("SELECT CAST(a.vec_id AS VARCHAR) AS x, CAST(b.vec_id AS VARCHAR) AS y, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR) WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3")
def semantic_alias_pairs(spark, sf):
    v = T.vectors(spark, sf)
    n = v.select(F.col("node_id").alias("id"), F.lit("entity").alias("node_type"), F.lit("stable").alias("lifecycle_state"))
    none = spark.createDataFrame([], "a_id string, b_id string")
    return organizer.semantic_aliases(n, v, none, 0.3).select(F.col("a_id").alias("x"), F.col("b_id").alias("y"), "similarity").transform(Q._r, "similarity")


# --- quality, research


@query("SELECT lang AS category, round(avg((contains(lower(text), 'the')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'und')::INT) / 3.0::DOUBLE), 6) AS score, round(avg(1 - (contains(lower(text), 'license')::INT + contains(lower(text), 'los')::INT) / 2.0::DOUBLE), 6) AS clean FROM documents WHERE text IS NOT NULL GROUP BY 1")
def category_scores(spark, sf):
    d = T.read(spark, sf, "documents").where("text IS NOT NULL")
    words = lambda *w: F.array(*map(F.lit, w))
    found = quality.category_means(d.select(F.col("lang").alias("category"), quality.keyword_match(F.col("text"), words("the", "QUE", "und")).alias("score")))
    clean = quality.category_means(d.select(F.col("lang").alias("category"), quality.keyword_exclusion(F.col("text"), words("License", "los")).alias("score")))
    return found.join(clean.withColumnRenamed("score", "clean"), "category").transform(Q._r, "score", "clean")


_TRUTH = "(VALUES ('1', ['click', '42'], 2), ('2', ['purchase'], 1), ('3', ['nothing'], 1)) v(query_id, words, g)"


@query(_nodes(f"""SELECT query_id, round(coalesce(sum(hit), 0) / greatest(count(r), 1), 6) AS precision, round(len(list_distinct(flatten(coalesce(list(found) FILTER (found IS NOT NULL), [])))) / len(any_value(words))::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN r END), 0), 6) AS mrr_of_top FROM
  (SELECT query_id, words, r, (len(list_filter(words, lambda w: contains(content, w))) > 0)::INT AS hit, list_filter(words, lambda w: contains(content, w)) AS found FROM {_TRUTH} LEFT JOIN (SELECT user_id, content, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS r FROM nodes) n ON n.user_id = query_id AND r <= 5) GROUP BY 1"""))
def keyword_metrics(spark, sf):
    rows, _ = _shown(spark, sf)
    truth = spark.createDataFrame([("1", ["click", "42"], {"click": 2}), ("2", ["purchase"], {}), ("3", ["nothing"], {})], "query_id string, keywords array<string>, grades map<string,int>")
    out = quality.keyword_metrics(rows.where("rank <= 5").select("query_id", "rank", "content"), truth, 5)
    return out.select("query_id", "precision", "recall", F.col("mrr").alias("mrr_of_top")).transform(Q._r, "precision", "recall", "mrr_of_top")


@query(_nodes("SELECT id, round((0.15 * confidence + 0.5 * ((node_type = 'fact')::INT + (user_id = '7')::INT) / 2.0::DOUBLE + 0.1 * exp(-0.01 * abs(30 - dayofmonth(ts))) + 0.1 * (node_type = 'fact')::INT + 0.15 * CASE lifecycle_state WHEN 'stable' THEN 1.0 WHEN 'tentative' THEN 0.7 ELSE 0.1 END) * confidence, 6) AS score FROM nodes"))
def tag_scores(spark, sf):
    n = T.nodes(spark, sf).withColumns({"tags": F.array("node_type", "user_id"), "day": F.dayofmonth("created_at")})
    out = research.tag_score(n, F.array(F.lit("fact"), F.lit("7")), F.lit(30), F.lit("fact"), F.col("confidence"))
    return out.select("id", "score").transform(Q._r, "score")


_NOTES = ", notes AS (SELECT id, user_id, dayofmonth(ts) AS day, CASE WHEN no % 40 = 0 THEN 'We switched from view to click' ELSE content END AS content FROM nodes)"


@query(_nodes("SELECT o.id AS old_id, n.id AS new_id FROM notes o JOIN notes n USING (user_id) WHERE n.content LIKE 'We switched%' AND o.day < n.day AND contains(o.content, 'view') AND NOT contains(o.content, 'click')", _NOTES))
def phrase_supersedence(spark, sf):
    n = T.nodes(spark, sf)
    text = F.when(F.col("id").cast("int") % 40 == 0, "We switched from view to click").otherwise(F.col("content"))
    return research.phrase_supersedence(n.select("id", "user_id", F.dayofmonth("created_at").alias("day"), text.alias("content")))


@query("SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: e[i] * e[(i + 60) % 64 + 1])), 6) AS bound, len(list_filter(e, lambda x: x >= 0)) AS ups FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def hypervector_algebra(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    both = research.bind(v, research.permute(v, 3))
    ups = F.size(F.filter(research.quantise(v), lambda x: x > 0)).cast("long")
    return T.read(spark, sf, "embeddings").select("vec_id", F.round(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), 6).alias("bound"), ups.alias("ups"))


@query(_nodes("SELECT CASE WHEN lifecycle_state = 'tentative' AND 25 - dayofmonth(ts) >= 7 THEN 'stable' ELSE lifecycle_state END AS lifecycle_state, count(*) AS n FROM nodes GROUP BY 1"))
def record_states(spark, sf):
    n = T.nodes(spark, sf).select("lifecycle_state", F.dayofmonth("created_at").alias("day"))
    return research.promoted(n, 25).groupBy("lifecycle_state").agg(F.count("*").alias("n"))


_STEMS = ["deployment", "ran", "cats", "kindness", "quickly", "boxes", "organization", "is"]


@query("SELECT * FROM (VALUES ('deployment', 'deploy'), ('ran', 'ran'), ('cats', 'cat'), ('kindness', 'kind'), ('quickly', 'quick'), ('boxes', 'box'), ('organization', 'organ'), ('is', 'is')) v(word, stem)")
def stems(spark, sf):
    return spark.createDataFrame([(w,) for w in _STEMS], "word string").select("word", research.stem(F.col("word")).alias("stem"))
