"""DuckDB twins of the driver queries. `nodes` is the projection of `sources.tables.nodes` in SQL."""

from engram import schema as S

_N = """
ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
n0 AS (SELECT event_id AS no, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, ts, k, value, user_id AS uid,
  CASE event_type WHEN 'click' THEN 'event' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'decision' WHEN 'signup' THEN 'fact' ELSE 'task' END AS node_type,
  event_type || ' ' || k AS content,
  ['observed','asserted','inferred','hypothetical','conditional','deprecated','unverified'][event_id % 7 + 1] AS epistemic_type,
  ['user_stated','user_demonstrated','system_inferred','external_document','tool_output'][event_id % 5 + 1] AS source_type,
  ['personal','project','organisation','agent','system','sandbox'][user_id % 6 + 1] AS scope,
  CASE WHEN event_id % 11 = 0 THEN 'superseded' WHEN event_id % 11 = 1 THEN 'archived' WHEN event_id % 11 = 2 THEN 'contested' WHEN event_id % 11 = 3 THEN 'deprecated' WHEN event_id % 11 <= 6 THEN 'stable' ELSE 'tentative' END AS lifecycle_state
  FROM ev),
nodes AS (SELECT *, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
  CASE epistemic_type WHEN 'observed' THEN 'slow' WHEN 'asserted' THEN 'medium' WHEN 'inferred' THEN 'fast' WHEN 'conditional' THEN 'medium' WHEN 'deprecated' THEN 'permanent' ELSE 'rapid' END AS decay_profile,
  0.3::DOUBLE + (k % 70) / 100.0::DOUBLE AS confidence, 0.3::DOUBLE + (k % 70) / 100.0::DOUBLE AS confidence_base, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS salience, least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS salience_base,
  (k % 6) / 10.0::DOUBLE AS reinforcement_boost, no % 97 = 0 AS pinned, ts AS created_at, ts AS updated_at, ts AS valid_from, CASE WHEN no % 13 = 0 THEN ts + INTERVAL 5 DAY END AS valid_to,
  ts + to_hours(k) AS last_reinforced_at, CASE WHEN k > 50 THEN ts - to_hours(k) END AS event_time,
  CASE node_type WHEN 'event' THEN 365 WHEN 'decision' THEN 180 WHEN 'task' THEN 90 WHEN 'note' THEN 90 END AS ttl_days, CASE WHEN no % 3 = 0 THEN 1 ELSE 0 END AS n_evidence
  FROM n0)
"""
_NOW = "TIMESTAMP '2024-02-01 00:00:00'"
_DECAY = f"""
, lam AS (SELECT *, CASE decay_profile WHEN 'permanent' THEN 0.0 WHEN 'slow' THEN 0.005 WHEN 'medium' THEN 0.020 WHEN 'fast' THEN 0.070 ELSE 0.200 END::DOUBLE AS l,
  greatest(date_diff('microsecond', last_reinforced_at, {_NOW}) / 86400000000.0::DOUBLE, 0.0::DOUBLE) AS t FROM nodes),
dec AS (SELECT *, greatest(least(salience_base * exp(-l * t) + reinforcement_boost * exp(-0.1::DOUBLE * t), 1.0), 0.0) AS s_moved,
  CASE WHEN epistemic_type = 'observed' AND t < 180 THEN greatest(least(confidence_base, 1.0), 0.0) ELSE greatest(least(confidence_base * exp(-l * t / 2), 1.0), 0.0) END AS c_moved,
  pinned OR decay_profile = 'permanent' OR lifecycle_state IN ('archived', 'deprecated') AS still FROM lam),
eff AS (SELECT *, CASE WHEN still THEN salience_base ELSE s_moved END AS eff_s, CASE WHEN still THEN confidence_base ELSE c_moved END AS eff_c FROM dec)
"""
_CAND = f"""
, q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
sem AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS score FROM embeddings, q0 ORDER BY score DESC, id LIMIT 200),
pin AS (SELECT id FROM nodes WHERE lifecycle_state IN ('tentative', 'stable') AND (salience = 1.0 OR node_type = 'task')),
mrg AS (SELECT id, max(score) AS semantic_score, count(*) AS path_count, string_agg(p, ',' ORDER BY p) AS paths FROM (SELECT id, score, 'VECTOR' AS p FROM sem UNION ALL SELECT id, 0.0, 'PINNED' FROM pin) GROUP BY id),
cand AS (SELECT e.*, greatest(m.semantic_score, 0.0) AS sem0, m.semantic_score, m.path_count, m.paths FROM mrg m JOIN eff e USING (id)
  WHERE NOT (lifecycle_state IN ('superseded', 'archived') OR epistemic_type IN ('hypothetical', 'deprecated') OR (epistemic_type = 'unverified' AND confidence <= 0.30)))
"""
_SCORE = f"""
, parts AS (SELECT *, 0.25 * semantic_score + 0.10 * eff_s + 0.15 * eff_c AS rest, exp(-0.02::DOUBLE * greatest(date_diff('microsecond', updated_at, {_NOW}) / 86400000000.0::DOUBLE, 0.0)) AS rec,
  CASE epistemic_type WHEN 'observed' THEN 1.0 WHEN 'asserted' THEN 0.9 WHEN 'inferred' THEN 0.7 ELSE 0.5 END::DOUBLE AS epi, CASE node_type WHEN 'fact' THEN 1.15 WHEN 'decision' THEN 1.10 ELSE 1.0 END::DOUBLE AS boost FROM cand),
comp AS (SELECT *, (rest + 0.10 * rec) * epi * boost AS raw FROM parts),
scored AS (SELECT *, round(CASE WHEN semantic_score < 0.35 THEN least(raw, semantic_score) ELSE raw END, 10) AS composite_score, least(path_count / 3.0::DOUBLE, 1.0) AS path_score FROM comp),
ranked AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, path_score DESC, id) AS rank FROM scored)
"""
_EDGES = """
edges AS (SELECT 'n' || n_nationkey AS source_id, 'r' || n_regionkey AS target_id FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders),
links AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges)
"""
_PAIRS = """
, pairs AS (SELECT id AS old_id, new_id FROM (SELECT no, id, lead(id) OVER (PARTITION BY user_id, node_type ORDER BY created_at, no) AS new_id FROM nodes) WHERE new_id IS NOT NULL AND no % 4 <> 0)
"""
_BM25 = r"""
WITH toks AS (SELECT CAST(doc_id AS VARCHAR) AS node_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS ts FROM documents),
qs(query_id, term) AS (VALUES ('q1','the'),('q1','of'),('q1','and'),('q2','que'),('q2','los'),('q2','del'),('q3','und'),('q3','die')),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM toks),
tf AS (SELECT node_id, term, dl, count(*) AS tf FROM (SELECT node_id, unnest(ts) AS term, len(ts) AS dl FROM toks) WHERE term IN (SELECT term FROM qs) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, node_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched FROM tf JOIN dfs USING (term) JOIN qs USING (term), st GROUP BY query_id, node_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, node_id) AS rn FROM sc QUALIFY rn <= 20)
"""
_GRADED = _BM25 + """, graded AS (SELECT query_id, rn, coalesce(quality, 0) AS g FROM top LEFT JOIN labels ON node_id = CAST(doc_id AS VARCHAR)),
alls AS (SELECT query_id, sum(coalesce(quality, 0))::DOUBLE AS rel FROM sc LEFT JOIN labels ON node_id = CAST(doc_id AS VARCHAR) GROUP BY 1),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, rn) AS ir FROM graded JOIN alls USING (query_id)),
agg AS (SELECT query_id, sum(CASE WHEN rn <= 10 AND g > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS h, max(rel) AS rel, sum(CASE WHEN rn <= 10 THEN (pow(2, g) - 1) / log2(rn + 1) ELSE 0.0 END) AS dcg,
  sum(CASE WHEN ir <= 10 THEN (pow(2, g) - 1) / log2(ir + 1) ELSE 0.0 END) AS idcg, min(CASE WHEN g > 0 THEN rn END) AS first FROM m GROUP BY query_id)
"""
_EVS = "SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp, event_type || ' ' || props AS content, sha256(event_type || ' ' || props) AS content_hash, CAST(user_id AS VARCHAR) AS user_id FROM events"
_AGO = "CASE WHEN d < 0 THEN 'in ' || -d || ' days' WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' WHEN d = 7 THEN '1 week ago' WHEN d < 14 THEN '~1 week ago (' || d || ' days)' WHEN d < 60 THEN '~' || d // 7 || ' weeks ago (' || d || ' days)' WHEN d < 365 THEN '~' || round(d / 30.44::DOUBLE, 1) || ' months ago (' || d || ' days)' ELSE '~' || round(d / 365.25::DOUBLE, 1) || ' years ago (' || d || ' days)' END"
_STATES = "('superseded','archived','contested','deprecated','stable','tentative')"


#: Nodes in id order, one a step; the list of what is taken goes along.
_GREEDY = """
unit AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS v FROM embeddings),
alike AS (SELECT a.id AS a, list(b.id ORDER BY b.id) AS near FROM unit a JOIN unit b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.35 GROUP BY 1),
steps AS (SELECT a, near, row_number() OVER (ORDER BY a) AS n FROM alike),
fold AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS a, CAST(NULL AS VARCHAR[]) AS own, CAST([] AS VARCHAR[]) AS taken
  UNION ALL
  SELECT n, a, own, CASE WHEN own IS NULL THEN taken ELSE list_concat(taken, own) END FROM (
    SELECT s.n, s.a, CASE WHEN list_contains(taken, s.a) OR len(list_filter(s.near, lambda x: NOT list_contains(taken, x))) < 2 THEN NULL ELSE list_prepend(s.a, list_filter(s.near, lambda x: NOT list_contains(taken, x))) END AS own, taken
    FROM fold f JOIN steps s ON s.n = f.n + 1))
"""


def _nodes(select: str, more: str = "") -> str:
    return f"WITH {_N} {more} {select}"


def _transition(ids: str, to: str, allowed: str) -> str:
    return _nodes(f"SELECT CASE WHEN {ids} AND lifecycle_state IN {allowed} THEN '{to}' ELSE lifecycle_state END AS lifecycle_state, count(*) AS n FROM nodes GROUP BY 1")


def _rollup(fmt: str, least: int, level: str = "") -> str:
    text = f", '[{level} summary: ' || period || ']' || chr(10) || string_agg(CASE WHEN rn <= 10 THEN '- ' || left(content, 200) || CASE WHEN length(content) > 200 THEN '...' ELSE '' END END, chr(10) ORDER BY rn) AS content" if level else ""
    return _nodes(f"""SELECT user_id, period, count(*) AS n, round(avg(salience_base), 6) AS salience, round(avg(confidence_base), 6) AS confidence {text} FROM (
      SELECT *, strftime(created_at, '{fmt}') AS period, row_number() OVER (PARTITION BY user_id, strftime(created_at, '{fmt}') ORDER BY salience_base DESC, confidence_base DESC, created_at DESC, id) AS rn
      FROM nodes WHERE lifecycle_state IN ('tentative','stable','contested')) GROUP BY user_id, period HAVING count(*) >= {least}""")


_EXCLUDED = "CASE WHEN lifecycle_state IN ('superseded','archived') THEN 'lifecycle:' || lifecycle_state WHEN epistemic_type IN ('hypothetical','deprecated') THEN 'epistemic:' || epistemic_type WHEN epistemic_type = 'unverified' AND confidence <= 0.30 THEN 'unverified_low_confidence' END"
_NEAR = "SELECT CAST(a.vec_id AS VARCHAR) AS x, CAST(b.vec_id AS VARCHAR) AS y, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON CAST(a.vec_id AS VARCHAR) < CAST(b.vec_id AS VARCHAR)"

_BOTH = ", both_active AS (SELECT a.no AS a FROM nodes a JOIN nodes b ON b.no = a.no + 5 WHERE a.no % 10 = 5 AND a.lifecycle_state IN ('tentative','stable') AND b.lifecycle_state IN ('tentative','stable'))"
_CURRENT = """
, told AS (SELECT *, no % 3 = 0 AS changed, max(coalesce(event_time, updated_at, created_at)) OVER () AS anchor FROM cand),
parts AS (SELECT *, (0.25 - 0.15 * 0.25 / 0.45::DOUBLE) * semantic_score + 0.10 * eff_s + 0.15 * eff_c AS rest, exp(-0.05::DOUBLE * greatest(date_diff('microsecond', updated_at, anchor) / 86400000000.0::DOUBLE, 0.0)) AS rec,
  CASE epistemic_type WHEN 'observed' THEN 1.0 WHEN 'asserted' THEN 0.9 WHEN 'inferred' THEN 0.7 ELSE 0.5 END::DOUBLE AS epi, CASE node_type WHEN 'fact' THEN 1.15 WHEN 'decision' THEN 1.10 ELSE 1.0 END::DOUBLE AS boost FROM told),
scored AS (SELECT *, round(CASE WHEN changed THEN (rest + 0.25 * least(2 * rec, 1.0)) * epi * boost WHEN semantic_score < 0.35 THEN least((rest + 0.25 * rec) * epi * boost, semantic_score) ELSE (rest + 0.25 * rec) * epi * boost END, 10) AS composite_score, least(path_count / 3.0::DOUBLE, 1.0) AS path_score FROM parts),
ranked AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, path_score DESC, id) AS rank FROM scored)
"""
_PACK = """
, levels AS (SELECT *, ceil(length(content) / 4.2::DOUBLE)::BIGINT AS full_cost, ceil(floor(length(content) * 0.8::DOUBLE) / 4.2::DOUBLE)::BIGINT AS prose_cost, ceil(length('type: ' || node_type || ', content: ' || content) / 4.2::DOUBLE)::BIGINT AS structured_cost,
  ceil(length('id: ' || id || ', type: ' || node_type || ', confidence: ' || confidence) / 4.2::DOUBLE)::BIGINT AS key_cost, ceil(length(node_type || ':' || id) / 4.2::DOUBLE)::BIGINT AS ref_cost,
  CASE WHEN salience = 1.0 OR (node_type = 'task' AND lifecycle_state IN ('tentative','stable')) THEN 1 WHEN path_count >= 2 THEN 2 ELSE 3 END AS tier,
  CASE WHEN lifecycle_state = 'contested' THEN 'contested_claims' WHEN node_type IN ('fact','note') THEN 'stable_facts' WHEN node_type = 'decision' THEN 'recent_decisions' WHEN node_type = 'task' THEN 'active_tasks' ELSE 'provenance_refs' END AS section FROM ranked),
packing AS (SELECT *, row_number() OVER (ORDER BY tier, CASE tier WHEN 1 THEN -rank::DOUBLE WHEN 2 THEN composite_score / greatest(full_cost, 1) ELSE composite_score END DESC, CASE WHEN tier = 2 THEN rank END, id) AS no FROM (SELECT * EXCLUDE (no) FROM levels))
"""
_FOLD = """
, fold AS (SELECT 0::BIGINT AS no, NULL::VARCHAR AS id, NULL::VARCHAR AS section, NULL::VARCHAR AS level, 0::BIGINT AS tokens, 300::BIGINT AS budget UNION ALL
  SELECT p.no, p.id, p.section, CASE WHEN full_cost <= budget THEN 'full' WHEN prose_cost <= budget THEN 'prose' WHEN structured_cost <= budget THEN 'structured' WHEN key_cost <= budget THEN 'key_value' WHEN ref_cost <= budget THEN 'reference' END,
    CASE WHEN full_cost <= budget THEN full_cost WHEN prose_cost <= budget THEN prose_cost WHEN structured_cost <= budget THEN structured_cost WHEN key_cost <= budget THEN key_cost WHEN ref_cost <= budget THEN ref_cost ELSE 0 END,
    budget - CASE WHEN full_cost <= budget THEN full_cost WHEN prose_cost <= budget THEN prose_cost WHEN structured_cost <= budget THEN structured_cost WHEN key_cost <= budget THEN key_cost WHEN ref_cost <= budget THEN ref_cost ELSE 0 END
  FROM fold f JOIN packing p ON p.no = f.no + 1)
"""
_COLUMNS = "id, node_type, content, lifecycle_state, epistemic_type, decay_profile, confidence, confidence_base, salience, salience_base, reinforcement_boost, pinned, created_at, updated_at, last_reinforced_at, event_time, valid_from, valid_to"
_RETRIEVE = f"""
, world AS (SELECT {_COLUMNS} FROM nodes UNION ALL SELECT 'e:' || event_type, 'entity', event_type, 'stable', 'observed', 'slow', 0.9, 0.9, 0.5, 0.5, 0.0, false, t, t, t, NULL, t, NULL FROM (SELECT DISTINCT event_type, TIMESTAMP '2024-01-01' AS t FROM events))
{_DECAY.replace("FROM nodes)", "FROM world)")}
, live AS (SELECT * FROM eff WHERE lifecycle_state IN ('tentative','stable','contested')),
vec AS (SELECT id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS score FROM embeddings JOIN live ON id = CAST(vec_id AS VARCHAR) ORDER BY score DESC, id LIMIT 500),
docs AS (SELECT id, string_split_regex(content, '[^a-z0-9]+') AS ts FROM live),
words AS (SELECT id, unnest(ts) AS term, len(ts) AS dl FROM docs),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM docs),
df AS (SELECT term, count(DISTINCT id) AS df FROM words GROUP BY 1),
lex0 AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM words JOIN df USING (term), st WHERE term IN ('when','did','purchase','42','happen','on','2024','01','12') GROUP BY 1 ORDER BY round(score, 8) DESC, id LIMIT 500),
lex AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM lex0),
more0 AS (SELECT id, ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM words JOIN df USING (term), st WHERE term = 'purchase' ORDER BY round(score, 8) DESC, id LIMIT 50),
more1 AS (SELECT id, CASE WHEN max(score) OVER () = min(score) OVER () THEN 1.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score, row_number() OVER (ORDER BY round(score, 8) DESC, id) AS rn FROM more0),
gra AS (SELECT id, 1.0::DOUBLE AS score FROM live WHERE node_type <> 'entity' AND starts_with(content, 'purchase ') AND valid_from <= TIMESTAMP '2024-01-12' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-12') ORDER BY confidence DESC, created_at DESC, id LIMIT 150),
pins AS (SELECT id FROM live WHERE lifecycle_state IN ('tentative','stable') AND (salience = 1.0 OR node_type = 'task')),
seen AS (SELECT id FROM vec UNION SELECT id FROM lex UNION SELECT id FROM gra UNION SELECT id FROM pins),
mrg AS (SELECT id, max(s) AS semantic_score, max(l) AS lexical_score, max(g) AS graph_proximity, count(DISTINCT p) AS path_count, string_agg(DISTINCT p, ',' ORDER BY p) AS paths FROM (SELECT id, score AS s, 0.0::DOUBLE AS l, 0.0::DOUBLE AS g, 'VECTOR' AS p FROM vec UNION ALL SELECT id, 0.0, score, 0.0, 'LEXICAL' FROM lex
  UNION ALL SELECT id, 0.0, score, 0.0, 'LEXICAL' FROM more1 WHERE rn <= 20 AND id NOT IN (SELECT id FROM seen) UNION ALL SELECT id, 0.0, 0.0, score, 'GRAPH' FROM gra UNION ALL SELECT id, 0.0, 0.0, 0.0, 'PINNED' FROM pins) GROUP BY id),
cand AS (SELECT e.*, m.* EXCLUDE (id), coalesce(event_time, created_at) AS t0 FROM mrg m JOIN live e USING (id) WHERE NOT (epistemic_type IN ('hypothetical', 'deprecated') OR (epistemic_type = 'unverified' AND confidence <= 0.30))),
raw AS (SELECT *, 0.25 * semantic_score + 0.20 * lexical_score + 0.20 * graph_proximity + 0.10 * eff_s + 0.15 * eff_c AS rest, exp(-0.02::DOUBLE * greatest(date_diff('microsecond', updated_at, {_NOW}) / 86400000000.0::DOUBLE, 0.0)) AS rec,
  0.7 * exp(-0.02::DOUBLE * greatest(date_diff('microsecond', t0, TIMESTAMP '2024-01-12') / 86400000000.0::DOUBLE, date_diff('microsecond', TIMESTAMP '2024-01-12', t0) / 86400000000.0::DOUBLE, 0.0)) AS aff,
  CASE epistemic_type WHEN 'observed' THEN 1.0 WHEN 'asserted' THEN 0.9 WHEN 'inferred' THEN 0.7 ELSE 0.5 END::DOUBLE AS epi, CASE node_type WHEN 'fact' THEN 1.15 WHEN 'decision' THEN 1.10 ELSE 1.0 END::DOUBLE AS boost FROM cand),
sums AS (SELECT *, ((rest + 0.10 * rec) * epi + 0.15 * aff) * boost AS s0 FROM raw),
total AS (SELECT *, round(CASE WHEN semantic_score + lexical_score < 0.35 THEN least(s0, semantic_score + lexical_score) ELSE s0 END, 10) AS composite_score, least(path_count / 3.0::DOUBLE, 1.0) AS path_score FROM sums),
first AS (SELECT *, row_number() OVER (ORDER BY composite_score DESC, path_score DESC, id) AS rank0 FROM total),
ord AS (SELECT id, node_type, user_id, session_id, row_number() OVER (PARTITION BY user_id, session_id ORDER BY created_at, id) AS pos FROM nodes WHERE lifecycle_state IN ('tentative','stable','contested')),
context AS (SELECT o.id, o.node_type, arg_min(round(r.composite_score * 0.85, 10), r.rank0) AS composite_score FROM first r JOIN ord t ON t.id = r.id JOIN ord o ON o.session_id = t.session_id AND o.user_id = t.user_id AND abs(o.pos - t.pos) <= 3
  WHERE r.rank0 <= 20 AND o.id NOT IN (SELECT id FROM total) GROUP BY 1, 2),
shown AS (SELECT id, node_type, semantic_score, lexical_score, graph_proximity, composite_score, paths FROM total UNION ALL SELECT id, node_type, 0, 0, 0, composite_score, 'SESSION_CONTEXT' FROM context)
"""

ORACLES: dict[str, str] = {
    "events_by_user": f"SELECT id, timestamp, content FROM ({_EVS}) WHERE user_id = '7' ORDER BY timestamp DESC, id LIMIT 50",
    "events_by_hash": f"SELECT id, user_id, content_hash FROM ({_EVS}) SEMI JOIN (SELECT content_hash, user_id FROM ({_EVS}) WHERE CAST(id AS BIGINT) % 50 = 0) USING (content_hash, user_id)",
    "nodes_projection": _nodes("SELECT id, node_type, user_id, session_id, scope, content, lifecycle_state, epistemic_type, source_type, decay_profile, round(confidence_base, 6) AS confidence_base, round(salience_base, 6) AS salience_base, round(reinforcement_boost, 6) AS reinforcement_boost, pinned, ttl_days, created_at, last_reinforced_at, event_time, valid_to FROM nodes"),
    "nodes_filtered_topn": _nodes("SELECT id, created_at, round(confidence, 6) AS confidence FROM nodes WHERE lifecycle_state IN ('tentative','stable','contested') AND node_type = 'decision' AND confidence >= 0.5 ORDER BY created_at DESC, id LIMIT 100"),
    "nodes_valid_asof": _nodes("SELECT node_type, count(*) AS n FROM nodes WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15') GROUP BY 1"),
    "knowledge_asof": _nodes("SELECT scope, count(*) AS n FROM nodes WHERE created_at <= TIMESTAMP '2024-01-10 12:00:00' GROUP BY 1"),
    "event_time_range": _nodes("SELECT id FROM nodes WHERE coalesce(event_time, created_at) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'"),
    "stats_by_node_type": _nodes("SELECT node_type, count(*) AS n FROM nodes GROUP BY 1"),
    "stats_by_lifecycle_state": _nodes("SELECT lifecycle_state, count(*) AS n FROM nodes GROUP BY 1"),
    "stats_by_scope": _nodes("SELECT scope, count(*) AS n FROM nodes GROUP BY 1"),
    "info_scan": "SELECT 'nodes' AS table_name, count(*) AS n, max(ts) AS newest FROM events UNION ALL SELECT 'events', count(*), max(ts) FROM events",
    "encrypt_round_trip": _nodes("SELECT id, content FROM nodes"),
    "migrated_rows": _nodes("SELECT id, CASE WHEN no % 2 = 0 THEN scope ELSE 'personal' END AS scope, 'asserted' AS epistemic_type, 'user_stated' AS source_type, 'medium' AS decay_profile, false AS pinned FROM nodes"),
    "transition_promote": _transition("no % 4 = 0", "stable", "('tentative','contested')"),
    "archive_rows": _transition("no % 3 = 0", "archived", "('tentative','stable','contested','superseded','deprecated')"),
    "transition_rejected": _nodes("SELECT id, lifecycle_state FROM nodes WHERE no % 50 = 0 AND lifecycle_state <> 'contested'"),
    "supersede_rows": _nodes("SELECT id, new_id AS superseded_by, 'superseded' AS lifecycle_state FROM nodes JOIN pairs ON id = old_id WHERE lifecycle_state IN ('tentative','stable')", _PAIRS),
    "contradiction_edges": _nodes("SELECT b.id AS source_id, a.id AS target_id, 'contradicts' AS edge_type, a.user_id FROM nodes a JOIN nodes b ON b.no = a.no + 5 WHERE a.no % 10 = 5 AND a.lifecycle_state IN ('tentative','stable') AND b.lifecycle_state IN ('tentative','stable')"),
    "reinforce_update": _nodes("SELECT id, round(CASE WHEN h > 0 THEN greatest(reinforcement_boost, least(reinforcement_boost + h * 0.15::DOUBLE, 0.5)) ELSE reinforcement_boost END, 6) AS reinforcement_boost, round(CASE WHEN h > 0 THEN greatest(confidence_base, least(confidence_base + h * 0.05::DOUBLE, 0.95)) ELSE confidence_base END, 6) AS confidence_base, CAST(n_evidence + h AS INT) AS n_evidence FROM (SELECT *, CASE WHEN no % 14 = 0 THEN 2 WHEN no % 7 = 0 THEN 1 ELSE 0 END AS h FROM nodes)"),
    "node_updates": _nodes(f"SELECT id, user_id, CASE WHEN no % 9 = 0 THEN upper(content) ELSE content END AS content, CASE WHEN no % 9 = 0 THEN {_NOW} ELSE updated_at END AS updated_at FROM nodes"),
    "epistemic_backfill": _nodes("SELECT node_type, CASE WHEN no % 2 = 0 THEN epistemic_type WHEN node_type = 'event' THEN 'observed' ELSE 'asserted' END AS epistemic_type, count(*) AS n FROM nodes GROUP BY 1, 2"),
    "neighborhood_k": f"WITH RECURSIVE {_EDGES}, walk AS (SELECT s AS seed, s AS node_id, 0 AS hop FROM (SELECT 'c' || c_custkey AS s FROM customer WHERE c_custkey % 50 = 0) UNION SELECT seed, b, hop + 1 FROM walk JOIN links ON node_id = a WHERE hop < 2) SELECT seed, node_id, min(hop) AS hop FROM walk WHERE node_id <> seed GROUP BY 1, 2",
    "supersedence_chain": f"WITH RECURSIVE {_N} {_PAIRS}, walk AS (SELECT id AS seed, 0 AS step, id AS node_id FROM nodes UNION ALL SELECT seed, step + 1, new_id FROM walk JOIN pairs ON node_id = old_id WHERE step < 100) SELECT seed, CAST(step AS BIGINT) AS step, node_id FROM walk",
    "entity_snapshot": "SELECT 'c' || c_custkey AS entity_id, count(CASE WHEN o_orderstatus <> 'O' THEN 1 END) AS n_facts, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_tasks, count(o_orderkey) AS n_in, CAST(1 AS BIGINT) AS n_out FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "vector_topk": "SELECT CAST(vec_id AS VARCHAR) AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, node_id LIMIT 20",
    "vector_topk_scoped": "SELECT CAST(vec_id AS VARCHAR) AS node_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, node_id LIMIT 10",
    "vector_topk_batch": "SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS node_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, CAST(b.vec_id AS VARCHAR)) AS INT) AS rn FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 50 = 0 QUALIFY rn <= 5",
    "novelty_score": "WITH s AS (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS top FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND b.vec_id % 25 <> 0 WHERE a.vec_id % 25 = 0 GROUP BY 1), v AS (SELECT query_id, least(greatest(1 - coalesce(top, 0), 0.0), 1.0) AS novelty FROM s) SELECT query_id, round(novelty, 6) AS novelty, CASE WHEN novelty >= 0.7 THEN 0.15 WHEN novelty <= 0.3 THEN -0.10 ELSE 0.0 END::DOUBLE AS salience_change, novelty > 0.5 AS is_novel FROM v",
    "bm25_topk": _BM25 + "SELECT query_id, node_id, round(score, 6) AS score FROM top",
    "bm25_minmax": _BM25 + "SELECT query_id, node_id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 5) AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM top)",
    "lexical_match_all": _BM25 + "SELECT query_id, count(*) AS n FROM sc JOIN (SELECT query_id, count(*) AS need FROM qs GROUP BY 1) USING (query_id) WHERE matched = need GROUP BY 1",
    "epistemic_filter": _nodes(f"SELECT id FROM nodes WHERE ({_EXCLUDED}) IS NULL"),
    "excluded_reasons": _nodes(f"SELECT {_EXCLUDED} AS reason, count(*) AS n FROM nodes WHERE ({_EXCLUDED}) IS NOT NULL GROUP BY 1"),
    "effective_decay": _nodes("SELECT id, round(eff_s, 6) AS salience, round(eff_c, 6) AS confidence FROM eff", _DECAY),
    "candidate_merge": _nodes("SELECT id, round(semantic_score, 6) AS semantic_score, CAST(path_count AS INT) AS path_count, paths FROM cand", _DECAY + _CAND),
    "composite_rank": _nodes("SELECT id, round(composite_score, 6) AS composite_score, rank FROM ranked WHERE rank <= 20", _DECAY + _CAND + _SCORE),
    "cross_scope_hints": _nodes("SELECT id, scope, round(composite_score, 6) AS composite_score FROM scored WHERE scope NOT IN ('personal','project') ORDER BY scored.composite_score DESC, path_score DESC, id LIMIT 5", _DECAY + _CAND + _SCORE),
    "session_expand": _nodes("""SELECT id, trigger_id, composite_score FROM (SELECT o.id, r.id AS trigger_id, round(round(r.composite_score * 0.85, 10), 6) AS composite_score, row_number() OVER (PARTITION BY o.id ORDER BY r.rank) AS f
      FROM ranked r JOIN ord t ON t.id = r.id JOIN ord o ON o.session_id = t.session_id AND o.user_id = t.user_id AND abs(o.pos - t.pos) <= 3 WHERE r.rank <= 20 AND o.id NOT IN (SELECT id FROM ranked)) WHERE f = 1""", _DECAY + _CAND + _SCORE + ", ord AS (SELECT id, user_id, session_id, row_number() OVER (PARTITION BY user_id, session_id ORDER BY created_at, id) AS pos FROM nodes WHERE lifecycle_state IN ('tentative','stable','contested'))"),
    "pack_sections": _nodes("""SELECT CASE WHEN lifecycle_state = 'contested' THEN 'contested_claims' WHEN node_type IN ('fact','note') THEN 'stable_facts' WHEN node_type = 'decision' THEN 'recent_decisions' WHEN node_type = 'task' THEN 'active_tasks' ELSE 'provenance_refs' END AS section,
      CASE WHEN salience = 1.0 OR (node_type = 'task' AND lifecycle_state IN ('tentative','stable')) THEN 1 WHEN path_count >= 2 THEN 2 ELSE 3 END AS tier, count(*) AS n, CAST(sum(ceil(length(content) / 4.2::DOUBLE)) AS BIGINT) AS tokens FROM ranked GROUP BY 1, 2""", _DECAY + _CAND + _SCORE),
    "temporal_affinity": _nodes("SELECT id, round(0.3 * CASE WHEN no % 2 = 0 THEN 1.0 ELSE 0.0 END + 0.7 * exp(-0.02::DOUBLE * greatest(date_diff('microsecond', coalesce(event_time, created_at), TIMESTAMP '2024-01-10') / 86400000000.0::DOUBLE, date_diff('microsecond', TIMESTAMP '2024-01-12', coalesce(event_time, created_at)) / 86400000000.0::DOUBLE, 0.0)), 6) AS affinity FROM nodes"),
    "format_days_ago": _nodes(f"SELECT id, {_AGO} AS label FROM (SELECT id, date_diff('day', CAST(created_at AS DATE), CAST({_NOW} AS DATE)) AS d FROM nodes)"),
    "agg_dedup_lines": "SELECT doc_id AS id FROM documents QUALIFY row_number() OVER (PARTITION BY left(lower(trim(text, ' ')), 100) ORDER BY doc_id) = 1",
    "qa_pairs": "SELECT conv_id, turn, p || chr(10) || text AS content FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS p FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE r <> role AND length(p) + length(text) < 1000",
    "fact_conflicts": _nodes("SELECT old_id, new_id, CASE WHEN CAST(new_id AS BIGINT) % 3 = 0 THEN 'contradict' ELSE 'supersede' END AS action FROM (SELECT a.id AS old_id, arg_min(b.id, (b.created_at, b.id)) AS new_id FROM nodes a JOIN nodes b ON a.user_id = b.user_id AND a.node_type = b.node_type AND a.lifecycle_state <> b.lifecycle_state AND (b.created_at, b.id) > (a.created_at, a.id) GROUP BY 1)"),
    "greedy_clusters": f"WITH RECURSIVE {_GREEDY} SELECT CAST(a AS VARCHAR) AS leader, unnest(own) AS node_id FROM fold WHERE own IS NOT NULL",
    "cluster_summaries": f"""WITH RECURSIVE {_GREEDY}, {_N}, members AS (SELECT a AS leader, unnest(own) AS id FROM fold WHERE own IS NOT NULL),
      texts AS (SELECT leader, content, max(confidence) AS c, sum(confidence) AS s, count(*) AS n, max(salience) AS sal FROM members JOIN nodes USING (id) GROUP BY 1, 2),
      shown AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY c DESC, content) AS rn FROM texts)
      SELECT leader, string_agg(CASE WHEN rn <= 3 THEN content END, ' | ' ORDER BY rn) AS content, round(sum(s) / sum(n), 6) AS confidence, round(max(sal), 6) AS salience, CAST(sum(n) AS BIGINT) AS members FROM shown GROUP BY leader""",
    "promote_candidates": _nodes(f"SELECT id FROM nodes WHERE lifecycle_state = 'tentative' AND date_diff('microsecond', created_at, {_NOW}) / 86400000000.0 >= 7 AND n_evidence >= 1"),
    "decay_sweep_actions": _nodes("""SELECT id, action FROM (SELECT id, CASE WHEN s_moved < 0.05 THEN 'archive' WHEN c_moved < 0.15 THEN CASE WHEN lifecycle_state = 'contested' THEN 'deprecate' ELSE 'archive' END WHEN s_moved < 0.10 AND c_moved < 0.40 THEN 'archive' END AS action
      FROM dec WHERE lifecycle_state IN ('tentative','stable','contested') AND NOT pinned AND (node_type NOT IN ('entity','fact') OR ttl_days IS NOT NULL)) WHERE action IS NOT NULL""", _DECAY),
    "ttl_sweep": _nodes("SELECT id, created_at + to_days(ttl_days) AS expired_at FROM nodes WHERE ttl_days IS NOT NULL AND NOT pinned AND lifecycle_state <> 'archived' AND created_at + to_days(ttl_days) < TIMESTAMP '2024-04-20'"),
    "exact_dups": "SELECT canonical_id, id FROM (SELECT CAST(doc_id AS VARCHAR) AS id, min(CAST(doc_id AS VARCHAR)) OVER (PARTITION BY lower(trim(text, ' '))) AS canonical_id FROM documents) WHERE id <> canonical_id",
    "near_dups": f"SELECT x AS a_id, y AS b_id, round(s, 6) AS similarity FROM ({_NEAR}) WHERE s >= 0.40",
    "daily_rollup": _rollup("%Y-%m-%d", 2, "daily"),
    "weekly_rollup": _rollup("%G-W%V", 3),
    "monthly_rollup": _rollup("%Y-%m", 2),
    "calendar_daily": _rollup("%Y-%m-%d", 5),
    "quality_metrics": f"SELECT count(*) AS n, round(avg((event_id % 4 = 0)::INT), 6) AS used_rate, round(avg((event_id % 4 = 1)::INT), 6) AS ignored_rate, round(avg((event_id % 4 = 2)::INT), 6) AS corrected_rate, round(avg((event_id % 4 = 3)::INT), 6) AS contradicted_rate, round(avg((event_id % 4 = 0)::INT) + 0.3 * avg((event_id % 4 = 1)::INT), 6) AS quality_score FROM events WHERE date_diff('microsecond', ts, {_NOW}) / 86400000000.0 <= 20",
    "precision_recall_at_k": _GRADED + "SELECT query_id, round(h / 10, 6) AS precision_at_k, round(CASE WHEN rel > 0 THEN h / rel ELSE 0 END, 6) AS recall_at_k, round(CASE WHEN h > 0 THEN 2 * (h / 10) * (h / rel) / (h / 10 + h / rel) ELSE 0 END, 6) AS f1 FROM agg",
    "ndcg_mrr": _GRADED + "SELECT query_id, round(CASE WHEN idcg > 0 THEN least(dcg / idcg, 1.0) ELSE 0 END, 6) AS ndcg_at_k, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr FROM agg",
    "topic_narratives": _nodes("SELECT user_id || '/' || node_type AS topic, arg_max(content, (ts, no)) AS current_state, count(*) - 1 AS older FROM nodes GROUP BY 1"),
    "stream_daily_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "export_nodes": _nodes(
        "SELECT 'node' AS kind, id, content, user_id, NULL AS source_id, NULL AS target_id FROM nodes UNION ALL SELECT 'edge', NULL, NULL, NULL, new_id, old_id FROM pairs UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), event_type || ' ' || props, CAST(user_id AS VARCHAR), NULL, NULL FROM events", _PAIRS
    ),
    "doctor_checks": "SELECT * FROM (VALUES ('table events', 'ok', 0::BIGINT), ('table nodes', 'ok', 0), ('table edges', 'ok', 0), ('table operations', 'ok', 0), ('table vectors', 'ok', 0), ('table documents', 'warn', 0), ('known lifecycle states', 'ok', 0), ('known node types', 'ok', 0), ('edges start at nodes', 'ok', 0)) v(check_name, status, violations)",
    "contradiction_resolved": _nodes("SELECT CASE WHEN no IN (SELECT a FROM both_active) THEN 'deprecated' WHEN no IN (SELECT a + 5 FROM both_active) THEN 'stable' ELSE lifecycle_state END AS lifecycle_state, count(*) AS n FROM nodes GROUP BY 1", _BOTH),
    "contradiction_pairs": _nodes("SELECT CAST(a AS VARCHAR) AS id, CAST(a + 5 AS VARCHAR) AS counterpart_id FROM both_active UNION ALL SELECT CAST(a + 5 AS VARCHAR), CAST(a AS VARCHAR) FROM both_active", _BOTH),
    "shortest_path_len": f"WITH RECURSIVE {_EDGES}, pairs(source, target) AS (VALUES ('c1', 'c2'), ('s1', 'c7'), ('r0', 'c3'), ('s2', 'n3')), walk AS (SELECT source AS s, source AS node, 0 AS d FROM pairs UNION SELECT s, b, d + 1 FROM walk JOIN links ON node = a WHERE d < 10) SELECT source, target, min(d) AS hops FROM pairs JOIN walk ON s = source AND node = target GROUP BY 1, 2",
    "graph_candidate_scores": _nodes("SELECT 'q' AS query_id, id, 1.0::DOUBLE AS graph_proximity FROM nodes WHERE lifecycle_state IN ('tentative','stable','contested') AND (id IN (SELECT old_id FROM pairs) OR id IN (SELECT new_id FROM pairs)) ORDER BY confidence DESC, created_at DESC, id LIMIT 150", _PAIRS),
    "remention_hits": "SELECT DISTINCT query_id, node_id FROM (SELECT CAST(a.vec_id AS VARCHAR) AS query_id, CAST(b.vec_id AS VARCHAR) AS node_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, CAST(b.vec_id AS VARCHAR)) AS rn FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 25 = 0 AND b.vec_id % 25 <> 0) WHERE rn <= 5 AND s >= 0.2",
    "confidence_prior": _nodes("SELECT DISTINCT n.epistemic_type, n.source_type, coalesce(p, 0.5)::DOUBLE AS prior FROM nodes n LEFT JOIN (VALUES " + ", ".join(f"('{e}', '{t}', {p})" for (e, t), p in S.CONFIDENCE_PRIOR.items()) + ") v(e, t, p) ON e = epistemic_type AND t = source_type"),
    "current_state_rank": _nodes("SELECT id, round(composite_score, 6) AS composite_score, rank FROM ranked WHERE rank <= 20", _DECAY + _CAND + _CURRENT),
    "multi_query_fusion": """WITH hits AS (SELECT a.vec_id::INT AS query_no, CAST(b.vec_id AS VARCHAR) AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS composite_score, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, CAST(b.vec_id AS VARCHAR)) AS rn FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0),
      first AS (SELECT id, query_no, composite_score FROM hits WHERE rn <= 40 QUALIFY row_number() OVER (PARTITION BY id ORDER BY query_no) = 1) SELECT * FROM first ORDER BY composite_score DESC, id LIMIT 150""",
    "abstention_levels": _nodes("SELECT user_id, CASE WHEN b < 0.55 THEN 1.0 WHEN b < 0.65 THEN 0.5 ELSE 0.0 END::DOUBLE AS abstain FROM (SELECT user_id, round(max(confidence), 6) - 0.4::DOUBLE AS b FROM nodes GROUP BY 1)"),
    "pack_budget_prefix": _nodes("SELECT id, no, used FROM (SELECT id, no, CAST(sum(full_cost) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM packing) WHERE used <= 300", _DECAY + _CAND + _SCORE + _PACK),
    "greedy_pack": "WITH RECURSIVE " + _nodes("SELECT id, no, section, level, tokens FROM fold WHERE level IS NOT NULL", _DECAY + _CAND + _SCORE + _PACK + _FOLD)[len("WITH ") :],
    "intent_classify": """SELECT * FROM (VALUES ('who is Ada', 'entity_lookup', 'default', 'Ada'), ('tell me about Grace Hopper', 'entity_lookup', 'default', 'Grace Hopper'), ('when did it start', 'temporal', 'temporal', ''), ('what is linked to billing', 'entity_lookup', 'default', ''),
      ('how does it work', 'factual', 'default', ''), ('plain words', 'semantic', 'default', ''), ('notes of 2024-01-02', 'temporal', 'temporal', ''), ('how many tests', 'factual', 'aggregation', '')) v(query, intent, kind, entities)""",
    "change_terms": _nodes("SELECT id, CASE WHEN no % 5 = 0 THEN 'task 7,task,7' ELSE '' END AS terms FROM nodes WHERE no % 5 IN (0, 1)"),
    "stored_nodes": "SELECT 'note' AS node_type, 'asserted' AS epistemic_type, CASE WHEN role = 'user' THEN 'user_stated' ELSE 'system_inferred' END AS source_type, CASE WHEN role = 'user' THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence, 'medium' AS decay_profile, 90 AS ttl_days, count(*) AS n FROM conversations GROUP BY ALL",
    "grounded_facts": """SELECT * FROM (VALUES ('u1', 'entity', 'Ada Lovelace'), ('u1', 'entity', 'Engines'), ('u1', 'entity', 'Bob'), ('u1', 'entity', 'Paris'), ('u2', 'entity', 'Carol'), ('u2', 'entity', 'Spark'), ('u2', 'entity', 'Bob'),
      ('u1', 'fact', 'Ada Lovelace works_at Engines'), ('u1', 'fact', 'Bob lives_in Paris'), ('u2', 'fact', 'Carol uses Spark'), ('u2', 'fact', 'Bob is tall')) v(user_id, node_type, content)""",
    "knowledge_profiles": _nodes("SELECT user_id, upper(left(kind, 1)) || substr(kind, 2) AS name, count(DISTINCT k) AS notes FROM (SELECT *, split_part(content, ' ', 1) AS kind FROM nodes WHERE lifecycle_state IN ('tentative','stable')) GROUP BY user_id, kind HAVING count(*) >= 3"),
    "canonical_pick": f"WITH RECURSIVE {_N}, near AS ({_NEAR}), links AS (SELECT x AS a, y AS b FROM near WHERE s >= 0.40 UNION SELECT y, x FROM near WHERE s >= 0.40), reach AS (SELECT a AS id, a AS other FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a), groups AS (SELECT id, min(other) AS g FROM reach GROUP BY 1), best AS (SELECT g, arg_min(n.id, (-confidence_base, -n_evidence, created_at, n.id)) AS canonical_id FROM groups JOIN nodes n USING (id) GROUP BY 1) SELECT id AS duplicate_id, canonical_id FROM groups JOIN best USING (g) WHERE id <> canonical_id",
    "alias_pairs": "SELECT * FROM (VALUES ('e0', 'e1', 'abbreviation', 0.95::DOUBLE), ('e0', 'e2', 'abbreviation', 0.95), ('e3', 'e4', 'abbreviation', 0.95), ('e3', 'e5', 'abbreviation', 0.95), ('e6', 'e7', 'case_variation', 0.9)) v(a_id, b_id, reason, similarity)",
    "oscillation_jaccard": f"WITH RECURSIVE {_N} {_PAIRS}, walk AS (SELECT id AS seed, 0 AS step, id AS node_id FROM nodes UNION ALL SELECT seed, step + 1, old_id FROM walk JOIN pairs ON node_id = new_id WHERE step < 10), hits AS (SELECT seed, list_distinct(string_split(h.content, ' ')) AS hw, list_distinct(string_split(o.content, ' ')) AS ow FROM walk JOIN nodes h ON h.id = seed JOIN nodes o ON o.id = node_id WHERE step > 0 AND step % 2 = 0) SELECT seed, count(*) AS cycles, round(least(count(*) * 0.1::DOUBLE, 0.3), 10) AS penalty FROM hits WHERE len(list_intersect(hw, ow)) / len(list_distinct(list_concat(hw, ow)))::DOUBLE >= 0.3 GROUP BY 1",
    "retrieve": _nodes("SELECT id, node_type, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score, round(graph_proximity, 6) AS graph_proximity, round(composite_score, 6) AS composite_score, paths, rank FROM (SELECT *, row_number() OVER (ORDER BY composite_score DESC, id) AS rank FROM shown) WHERE rank <= 50", _RETRIEVE),
}
