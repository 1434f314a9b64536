"""Candidates to ranked results: merge, filters, composite score, session context, fusion, abstention."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept, small
from engram.operators import graph, search

SCORES = ["semantic_score", "lexical_score", "graph_proximity"]


def merge(paths: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """{path: (rows of (query_id, id, score), which score)} -> a row per (query, id): greatest scores, distinct paths.

    The full outer merge is a union and one aggregate, so every source is shuffled once.
    """
    rows = _tagged(paths)
    return rows.groupBy("query_id", "id").agg(*[F.max(s).alias(s) for s in SCORES], F.array_sort(F.collect_set("path")).alias("paths")).withColumn("path_count", F.size("paths"))


def _tagged(paths: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.select("query_id", "id", *[(F.col("score") if s == score else F.lit(0.0)).cast("double").alias(s) for s in SCORES], F.lit(p).alias("path")) for p, (df, score) in paths.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _merged(rows: DataFrame, further: DataFrame) -> DataFrame:
    """`merge` of tagged rows, with further lexical hits of nodes that no row has: (query_id, id, scores, paths, further)."""
    both = rows.withColumn("further", F.lit(False)).unionByName(further.withColumn("further", F.lit(True)))
    first = lambda c: F.when(~F.col("further"), F.col(c))
    scores = [F.coalesce(F.max(first(s)), F.max(s)).alias(s) for s in SCORES]
    out = both.groupBy("query_id", "id").agg(*scores, F.array_sort(F.collect_set(first("path"))).alias("paths"), F.min("further").alias("further"))
    return out.withColumn("paths", F.when(F.col("further"), F.array(F.lit("LEXICAL"))).otherwise(F.col("paths")))


def is_pinned() -> Column:
    return F.coalesce(F.col("lifecycle_state").isin(S.ACTIVE) & F.expr("salience = 1.0 OR node_type = 'task'"), F.lit(False))


def pinned(nodes: DataFrame) -> DataFrame:
    return nodes.where(is_pinned())


def exclusion_reason(mode: str = "default", unverified: float = 0.30) -> Column:
    if mode == "explicit":
        return F.lit(None).cast("string")
    return (
        F.when(F.col("lifecycle_state").isin("superseded", "archived"), F.concat(F.lit("lifecycle:"), F.col("lifecycle_state")))
        .when(F.col("epistemic_type").isin("hypothetical", "deprecated"), F.concat(F.lit("epistemic:"), F.col("epistemic_type")))
        .when((F.col("epistemic_type") == "unverified") & (F.col("confidence") <= unverified), "unverified_low_confidence")
    )


def epistemic_filter(df: DataFrame, mode: str = "default", unverified: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Kept rows, and excluded ids with the first reason that holds."""
    tagged = df.withColumn("reason", exclusion_reason(mode, unverified))
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL").select("id", "reason")


def temporal_affinity(first: Column, last: Column) -> Column:
    """0.3 for a date in the text plus 0.7 by distance from the window; half of the date term without a window."""
    t = F.coalesce("event_time", "created_at")
    dated = F.when(F.col("content").rlike(X.DATE), 1.0).otherwise(0.0)
    outside = F.greatest(F.when(first.isNotNull(), X.days_between(t, first)).otherwise(F.lit(0.0)), F.when(last.isNotNull(), X.days_between(last, t)).otherwise(F.lit(0.0)), F.lit(0.0))
    return F.when(first.isNull() & last.isNull(), 0.5 * dated).otherwise(0.3 * dated + 0.7 * F.exp(-0.02 * outside))


def composite(df: DataFrame, now, weights: S.Weights = S.Weights(), intent: str = "semantic", current_state: bool = False, episodic: bool = False, window=(None, None)) -> DataFrame:
    """Adds `recency`, effective terms, `composite_score` and `path_score` for one kind of question."""
    lo, hi = (X.at(x) if x is not None else F.lit(None).cast("timestamp_ntz") for x in window)
    asked = {"intent": F.lit(intent), "is_current_state": F.lit(current_state), "is_episodic": F.lit(episodic), "time_from": lo, "time_to": hi}
    return score(df.withColumns(asked), now, weights, anchored=current_state).drop(*asked)


def score(df: DataFrame, now, weights: S.Weights = S.Weights(), anchored: bool = True) -> DataFrame:
    """The same for rows that carry their question's intent, flags and window: one projection of generated code.

    Current-state questions anchor recency at the query's newest candidate (an aggregate that is joined back, one row a
    query) and double it for texts that tell of a change. `anchored`: such questions may occur.
    """
    if anchored:
        df = kept(df)
        newest = df.where("is_current_state").groupBy("query_id").agg(F.max(F.coalesce("event_time", "updated_at", "created_at")).alias("newest"))
        df = df.join(newest, "query_id", "left").withColumn("anchor", F.coalesce("newest", X.at(now))).drop("newest")
    else:
        df = df.withColumn("anchor", X.at(now))
    current, episodic = F.col("is_current_state"), F.col("is_episodic")
    kinds = [(current, weights.with_recency(0.25, 0.05)), (episodic, weights.with_recency(0.20)), (None, weights)]

    def pick(of) -> Column:
        """A value that depends on the weights, which depend on the kind of question."""
        out = None
        for when, w in kinds:
            out = F.when(when, of(w)) if out is None else out.when(when, of(w)) if when is not None else out.otherwise(of(w))
        return out

    age = F.greatest(X.days_between(F.coalesce("updated_at", "created_at"), F.col("anchor")), F.lit(0.0))
    df = df.withColumns({"recency": pick(lambda w: F.exp(-w.recency_lambda * age)), "eff_salience": X.effective_salience(now), "eff_confidence": X.effective_confidence(now)})
    rest = pick(lambda w: w.semantic * F.col("semantic_score") + w.lexical * F.col("lexical_score") + w.graph * F.col("graph_proximity") + w.salience * F.col("eff_salience") + w.confidence * F.col("eff_confidence"))
    share = pick(lambda w: F.lit(w.recency))
    epi = X.lookup(S.EPISTEMIC_WEIGHTS, F.col("epistemic_type"), S.EPISTEMIC_FALLBACK)
    boost = X.lookup(weights.node_type_boost, F.col("node_type"), 1.0)
    timely = F.when(F.col("intent") == "temporal", weights.temporal_boost * temporal_affinity(F.col("time_from"), F.col("time_to"))).otherwise(F.lit(0.0))
    total = ((rest + share * F.col("recency")) * epi + timely) * boost
    relevance = F.col("semantic_score") + F.col("lexical_score")
    total = F.when(relevance < weights.relevance_floor, F.least(total, relevance)).otherwise(total)
    told = (rest + share * F.least(2 * F.col("recency"), F.lit(1.0))) * epi * boost
    total = F.when(current & F.col("content").rlike(X.UPDATE_LANGUAGE), told).otherwise(total)
    return df.withColumns({"composite_score": F.round(total, 10), "path_score": F.least(F.col("path_count") / F.lit(3.0), F.lit(1.0))}).drop("anchor")


def ranked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A total order per query: composite, paths, id."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("composite_score"), F.desc("path_score"), "id"))
    out = df.withColumn("rank", rank)
    return out.where(F.col("rank") <= limit) if limit else out


def rerank(df: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], top: int = 100, prior: float = 0.3) -> DataFrame:
    """The first `top` by 0.7 sigmoid(model) + 0.3 composite, the rest after them in order. `scorer` gets query and content."""

    @F.pandas_udf("double")
    def model(q: pd.Series, c: pd.Series) -> pd.Series:
        return scorer(q, c)

    head = F.col("rank") <= top
    mixed = (1 - prior) / (1 + F.exp(-model("query", "content"))) + prior * F.col("composite_score")
    out = df.withColumns({"head": head, "reranked": F.when(head, mixed).otherwise(F.col("composite_score"))})
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("head"), F.desc("reranked"), "id"))
    return out.withColumn("rank", order).drop("head")


def session_expand(scored: DataFrame, nodes: DataFrame, window: int = 3, top: int = 20, decay: float = 0.85, every: DataFrame | None = None) -> DataFrame:
    """Neighbours within ±window positions of the session of the top candidates, at 0.85 of the trigger's score. No candidate is a
    neighbour; `every`: all candidates, where `scored` has but the top ones.

    Only sessions of triggers are numbered: the few sessions are found first and sent to the nodes' scan, which is filtered by
    them; in the same way only candidates that are neighbours are looked up.
    """
    live = nodes.where(F.col("lifecycle_state").isin(S.LIVE) & F.col("session_id").isNotNull()).select("id", "user_id", "session_id", "created_at")
    trigger = kept(scored.where(F.col("rank") <= top).select("query_id", F.col("id").alias("trigger_id"), "rank", "composite_score", "user_id", "session_id"))
    order = live.join(small(trigger.select("user_id", "session_id").distinct()), ["user_id", "session_id"], "left_semi")
    order = order.withColumn("pos", F.row_number().over(Window.partitionBy("user_id", "session_id").orderBy("created_at", "id"))).select("id", "user_id", "session_id", "pos")
    trigger = trigger.join(order.select(F.col("id").alias("trigger_id"), F.col("pos").alias("trigger_pos")), "trigger_id")
    near = kept(trigger.join(order, ["user_id", "session_id"]).where(F.abs(F.col("pos") - F.col("trigger_pos")) <= window))
    among = (scored if every is None else every).select("query_id", "id").join(small(near.select("query_id", "id").distinct()), ["query_id", "id"], "left_semi")
    near = near.join(among, ["query_id", "id"], "left_anti")
    first = near.groupBy("query_id", "id").agg(F.min(F.struct("rank", "trigger_id", "composite_score")).alias("m"))
    return first.select("query_id", "id", F.col("m.trigger_id").alias("trigger_id"), F.round(F.col("m.composite_score") * decay, 10).alias("composite_score"), F.lit("SESSION_CONTEXT").alias("path"))


def cross_scope(scored: DataFrame, scopes: list[str], top: int = 5) -> DataFrame:
    """The best rows outside the scopes asked for."""
    return ranked(scored.where(~F.col("scope").isin(scopes)), top)


def fuse(results: DataFrame, cap: int = 150) -> DataFrame:
    """(query_no, id, composite_score): the first query that found an id keeps it; then by score."""
    first = results.groupBy("id").agg(F.min(F.struct("query_no", (-F.col("composite_score")).alias("neg"))).alias("m"))
    return first.select("id", F.col("m.query_no").alias("query_no"), (-F.col("m.neg")).alias("composite_score")).orderBy(F.desc("composite_score"), "id").limit(cap)


def fan_out_terms(queries: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, no, query): keyword and bigram queries of a counting query, from its first words of three letters or more
    that aren't stop words."""
    words = F.slice(F.filter(F.regexp_extract_all(F.lower("query"), F.lit(r"\b[a-z]{3,}\b"), F.lit(0)), lambda w: ~w.isin(S.FAN_OUT_STOP_WORDS)), 1, most)
    q = queries.select("query_id", words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    every = F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))
    return q.select("query_id", F.posexplode(every).alias("no", "query"))


def fan_out(docs: DataFrame, requests: DataFrame, terms: int = 50, names: int = 20) -> DataFrame:
    """Further lexical hits (query_id, id, score), scores within 0 to 1 per term: of counting questions for each of
    their keywords and bigrams, of any question for each of its first three names."""
    every = _further(requests, terms, names)
    return _further_hits(search.bm25(docs, every.select(F.col("term_id").alias("query_id"), "query", "user_id"), max(terms, names)), every)


def _further(requests: DataFrame, terms: int = 50, names: int = 20) -> DataFrame:
    """(term_id, query_id, user_id, query, k): what a question fans out to, and how many hits of each count."""
    asked = requests.select("query_id", "user_id")
    words = fan_out_terms(requests.where("is_aggregation")).select("query_id", F.concat(F.lit("w"), "no").alias("no"), "query", F.lit(terms).alias("k"))
    named = requests.select("query_id", F.posexplode(F.slice("entities", 1, 3)).alias("no", "query")).select("query_id", F.concat(F.lit("n"), "no").alias("no"), "query", F.lit(names).alias("k"))
    return words.unionByName(named).join(asked, "query_id").withColumn("term_id", F.concat_ws("|", "query_id", "no"))


def _further_hits(hits: DataFrame, every: DataFrame) -> DataFrame:
    of = every.select("term_id", F.col("query_id").alias("asked_id"), "k")
    hits = search.minmax(hits)
    found = hits.join(of, hits.query_id == of.term_id).where("rn <= k").groupBy("asked_id", "node_id").agg(F.max("score").alias("score"))
    return found.select(F.col("asked_id").alias("query_id"), F.col("node_id").alias("id"), "score")


def generate(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, docs: DataFrame | None, requests: DataFrame, config: S.Packing = S.Packing(), scopes: list[str] | None = None, few: bool = False) -> DataFrame:
    """Candidates of all four paths, merged and joined to their nodes: (query_id, id, scores, paths, node columns).

    docs: the nodes' texts, None for their own content. Ids of nodes are distinct.
    requests: `analysis.analyze` rows with embedding and user_id (null: every user). Contested nodes are candidates too.
    Counting questions look three times as deep, up to 2,000. `few`: the caller has counted the requests, and what comes of them
    is small enough to be sent to the tables; otherwise sides are counted here.
    """
    sent = F.broadcast if few else small
    live = nodes.where(F.col("lifecycle_state").isin(S.LIVE))
    live = live.where(F.col("scope").isin(scopes)) if scopes else live
    asked = sent(requests.select("query_id", F.col("user_id").alias("asker"), "is_aggregation"))
    deep = lambda k: F.when(F.col("is_aggregation"), min(k * config.aggregation_factor, config.aggregation_most)).otherwise(k)
    most = lambda k: min(k * config.aggregation_factor, config.aggregation_most)
    own = F.col("asker").isNull() | (F.col("user_id") == F.col("asker"))
    known = live.select("id", "user_id")

    # few of the nodes may have vectors
    owned = known.join(small(vectors.select(F.col("node_id").alias("id")), otherwise="shuffle_hash"), "id", "left_semi")
    v = vectors.select("node_id", "embedding").join(owned, F.col("node_id") == F.col("id")).select("node_id", "user_id", "embedding")
    near = search.vector_topk_batch(v, requests.select("query_id", "user_id", "embedding"), most(config.vector_k))
    vector = near.join(asked, "query_id").where(F.col("rn") <= deep(config.vector_k)).select("query_id", F.col("node_id").alias("id"), "score")

    d = live.select(F.col("id").alias("node_id"), "content", "user_id") if docs is None else docs.join(known.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    # the questions and what they fan out to in one pass over the texts
    further = _further(requests)
    said = requests.select(F.concat(F.lit("q|"), "query_id").alias("query_id"), "query", "user_id").unionByName(further.select(F.concat(F.lit("t|"), "term_id").alias("query_id"), "query", "user_id"))
    every = search.bm25(d, said, most(config.lexical_k), hint=sent, distinct=docs is None)
    of = lambda mark: every.where(F.col("query_id").startswith(mark)).withColumn("query_id", F.expr("substring(query_id, 3)"))
    hits = of("q|").join(asked, "query_id").where(F.col("rn") <= deep(config.lexical_k))
    lexical = search.minmax(hits.select("query_id", "node_id", "score")).select("query_id", F.col("node_id").alias("id"), "score")
    more = _further_hits(of("t|"), further)

    terms = requests.select("query_id", F.explode("entities").alias("term"))
    named = small(kept(graph.entity_seeds(live, terms).join(asked, "query_id")))
    seeds = kept(known.withColumnRenamed("id", "seed").join(named, "seed").where(own).select("query_id", "seed"))
    reach = graph.graph_candidates(live, edges, seeds, config.hops, most(config.graph_cap), requests.select("query_id", "time_from", "time_to"), ("user_id", "confidence", "created_at"))
    rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("created_at"), "id"))
    capped = reach.join(asked, "query_id").where(own).withColumn("rn", rn)
    by_graph = capped.where(F.col("rn") <= deep(config.graph_cap)).select("query_id", "id", F.col("graph_proximity").alias("score"))

    # what is searched for is computed once, a few thousand rows a query, and sent to the nodes
    first = _tagged({"GRAPH": (by_graph, "graph_proximity"), "VECTOR": (vector, "semantic_score"), "LEXICAL": (lexical, "lexical_score")})
    found = small(kept(_merged(first, _tagged({"LEXICAL": (more, "lexical_score")}))))
    # pinned nodes, which may be a share of all, are known where they lie; a request without user has every one as a candidate
    pin, only = is_pinned() & own, F.array(F.lit("PINNED"))
    # the semi-join goes below the nodes' projection, so columns are made of candidates only
    met = live.join(found.select("id"), "id", "left_semi").join(found, "id").join(asked, "query_id").withColumn("pin", pin)
    late = F.col("pin") & F.col("further")  # a pinned node is a candidate before further hits are
    paths = F.when(late, only).when(F.col("pin"), F.array_sort(F.array_union("paths", only))).otherwise(F.col("paths"))
    met = met.withColumns({"lexical_score": F.when(late, 0.0).otherwise(F.col("lexical_score")), "paths": paths})

    of_user, of_all = asked.where("asker IS NOT NULL").select("query_id", F.col("asker").alias("user_id")), asked.where("asker IS NULL").select("query_id")
    pins = pinned(live)
    pins = pins.join(sent(of_user), "user_id").unionByName(pins.join(sent(of_all))).join(found.select("query_id", "id"), ["query_id", "id"], "left_anti")
    pins = pins.withColumns({**{s: F.lit(0.0) for s in SCORES}, "paths": only})
    shown = ["id", "query_id", *SCORES, "paths", F.size("paths").alias("path_count"), *[c for c in live.columns if c != "id"]]
    return met.select(*shown).unionByName(pins.select(*shown))


FEW_REQUESTS = 10_000


def retrieve(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, docs: DataFrame | None, requests: DataFrame, now, weights: S.Weights = S.Weights(), config: S.Packing = S.Packing(), scopes: list[str] | None = None, mode: str = "default", knowledge_at=None, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """From analysed requests to ranked candidates: generation, bi-temporal and epistemic filters, scores, ranks, a model's opinion
    if there is one (`scorer`, see `rerank`), and what stands beside the best in their sessions (`with_context`)."""
    requests = kept(requests)  # questions are analysed once
    n, current = requests.agg(F.count("*"), F.coalesce(F.max("is_current_state"), F.lit(False))).first()
    found = generate(nodes, edges, vectors, docs, requests, config, scopes, n <= FEW_REQUESTS)
    found = found.where(F.col("created_at") <= X.at(knowledge_at)) if knowledge_at is not None else found
    rows, _ = epistemic_filter(found, mode)
    asked = requests.select("query_id", "query", "intent", "is_current_state", "is_episodic", "time_from", "time_to")
    out = score(rows.join(F.broadcast(asked) if n <= FEW_REQUESTS else asked, "query_id"), now, weights, current)
    if scorer is not None:
        out = rerank(ranked(out), scorer)
    return with_context(out, nodes, config) if config.window > 0 else out if scorer is not None else ranked(out)


def with_context(scored: DataFrame, nodes: DataFrame, config: S.Packing = S.Packing()) -> DataFrame:
    """Scored rows and their `session_expand`, ranked by score and id. Context has no scores but that one. Rows without ranks are
    ranked for the best of them only, as all are ranked once, with their context."""
    scored = kept(scored)
    best = scored if "rank" in scored.columns else ranked(scored, config.window_top)
    context = session_expand(best, nodes, config.window, config.window_top, config.window_decay, scored).withColumn("paths", F.array("path")).drop("path", "trigger_id")
    rows = nodes.join(small(kept(context)), "id").withColumns({**{s: F.lit(0.0) for s in SCORES}, "path_count": F.lit(1), "path_score": F.lit(1 / 3.0)})
    both = scored.drop("rank").unionByName(rows, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("composite_score"), "id"))
    return both.withColumn("rank", rank).select(*dict.fromkeys((*scored.columns, "rank")))


def hints(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, docs: DataFrame | None, requests: DataFrame, now, scopes: list[str], weights: S.Weights = S.Weights(), config: S.Packing = S.Packing(), mode: str = "default") -> DataFrame:
    """The best candidates outside the scopes asked for, of a generation of their own that knows no scope and looks less deep."""
    shallow = replace(config, vector_k=2 * config.cross_scope, lexical_k=2 * config.cross_scope, window=0)
    return cross_scope(retrieve(nodes, edges, vectors, docs, requests, now, weights, shallow, None, mode), scopes, config.cross_scope)


def abstention(best: Column) -> Column:
    """1: abstain, 0.5: unsure, 0: answer, by the best score."""
    return F.when(best.isNull() | (best < 0.55), 1.0).when(best < 0.65, 0.5).otherwise(0.0)


def retrieval_log(results: DataFrame, now, **told: str | None) -> DataFrame:
    """An operation row per query with its counts, and what else is told of the request (weights, filters)."""
    n = results.groupBy("query_id").agg(F.count("*").alias("n"), F.max("composite_score").alias("best"))
    more = [F.lit(v).cast("string").alias(k) for k, v in told.items()]
    return n.select(F.sha2(F.concat_ws("|", "query_id", F.lit(str(now))), 256).alias("id"), F.lit("RETRIEVAL_REQUEST").alias("op_type"), F.col("query_id").alias("target_id"), F.to_json(F.struct("n", "best", *more)).alias("payload"), X.at(now).alias("created_at"))
