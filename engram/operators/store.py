"""Node and edge reads, updates, and lifecycle transitions as table-to-table functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X

UPDATABLE = ["content", "metadata", "confidence", "salience", "lifecycle_state", "valid_to", "superseded_by", "evidence_refs", "epistemic_type", "decay_profile", "last_reinforced_at", "reinforcement_boost", "salience_base", "confidence_base", "pinned"]


def valid_at(df: DataFrame, when) -> DataFrame:
    t = X.at(when)
    return df.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def known_at(df: DataFrame, when) -> DataFrame:
    return df.where(F.col("created_at") <= X.at(when))


def happened_between(df: DataFrame, first=None, last=None) -> DataFrame:
    t = F.coalesce("event_time", "created_at")
    df = df.where(t >= X.at(first)) if first is not None else df
    return df.where(t <= X.at(last)) if last is not None else df


def get_node(nodes: DataFrame, node_id: str, any_state: bool = False) -> DataFrame:
    out = nodes.where(F.col("id") == node_id)
    return out if any_state else out.where(F.col("lifecycle_state").isin(S.ACTIVE))


def query_nodes(nodes: DataFrame, node_type=None, user_id=None, scope=None, states=None, valid=None, min_confidence=None, limit: int = 100) -> DataFrame:
    out = nodes.where(F.col("lifecycle_state").isin(states or S.LIVE))
    for column, value in (("node_type", node_type), ("user_id", user_id), ("scope", scope)):
        out = out.where(F.col(column) == value) if value is not None else out
    out = valid_at(out, valid) if valid is not None else out
    out = out.where(F.col("confidence") >= min_confidence) if min_confidence is not None else out
    return out.orderBy(F.desc("created_at"), "id").limit(limit)


def query_edges(edges: DataFrame, source_id=None, target_id=None, edge_type=None, valid=None, min_confidence=None) -> DataFrame:
    out = edges
    for column, value in (("source_id", source_id), ("target_id", target_id), ("edge_type", edge_type)):
        out = out.where(F.col(column) == value) if value is not None else out
    out = valid_at(out, valid) if valid is not None else out
    return out.where(F.col("confidence") >= min_confidence) if min_confidence is not None else out


def update_nodes(nodes: DataFrame, updates: DataFrame, now) -> DataFrame:
    """updates: id and new values; a null keeps the old value. Columns outside the whitelist are ignored."""
    fields = [c for c in updates.columns if c in UPDATABLE]
    if not fields:
        raise ValueError("no field that may be updated")
    new = updates.select(F.col("id"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = nodes.join(new, "id", "left")
    out = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields} | {"updated_at": F.when(F.col("_hit"), X.at(now)).otherwise(F.col("updated_at"))}
    return joined.withColumns(out).select(*nodes.columns)


def delete(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id"), "id", "left_anti").select(*df.columns)


def transition_allowed(state, to: str):
    return state.isin([a for a, bs in S.TRANSITIONS.items() if to in bs])


@dataclass
class Moved:
    """A transition's outcome: the new table, requests that the state machine refused, new edges and operations."""

    nodes: DataFrame
    rejected: DataFrame
    edges: DataFrame | None = None
    operations: DataFrame | None = None


def transition(nodes: DataFrame, ids: DataFrame, to: str, now) -> Moved:
    """Moves the listed ids to a state; promote, archive and deprecate are this with their target."""
    asked = nodes.join(ids.select("id").distinct().withColumn("_asked", F.lit(True)), "id", "left")
    ok = F.coalesce(F.col("_asked"), F.lit(False)) & transition_allowed(F.col("lifecycle_state"), to)
    moved = asked.withColumns({"lifecycle_state": F.when(ok, to).otherwise(F.col("lifecycle_state")), "updated_at": F.when(ok, X.at(now)).otherwise(F.col("updated_at"))}).select(*nodes.columns)
    refused = ids.select("id").distinct().join(nodes.select("id", "lifecycle_state"), "id", "left").where(F.col("lifecycle_state").isNull() | ~transition_allowed(F.col("lifecycle_state"), to))
    return Moved(moved, refused)


def transition_where(nodes: DataFrame, to, now) -> DataFrame:
    """Moves each row to the state that the column `to` gives it (null: none), where that is allowed; a projection, without a join."""
    ok = F.lit(False)
    for state in S.TRANSITIONS:
        ok = ok | ((F.col("_to") == state) & transition_allowed(F.col("lifecycle_state"), state))
    ok = F.coalesce(ok, F.lit(False))
    rows = nodes.withColumn("_to", to)
    return rows.withColumns({"lifecycle_state": F.when(ok, F.col("_to")).otherwise(F.col("lifecycle_state")), "updated_at": F.when(ok, X.at(now)).otherwise(F.col("updated_at"))}).select(*nodes.columns)


def promote(nodes, ids, now):
    return transition(nodes, ids, "stable", now)


def archive(nodes, ids, now):
    return transition(nodes, ids, "archived", now)


def deprecate(nodes, ids, now):
    return transition(nodes, ids, "deprecated", now)


def _edge_rows(pairs: DataFrame, source: str, target: str, kind, now, user: str = "user_id") -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    key = F.concat_ws("|", source, target, kind)
    return pairs.select(
        F.sha2(key, 256).alias("id"), F.col(source).alias("source_id"), F.col(target).alias("target_id"), kind.alias("edge_type"), F.col(user).alias("user_id"), F.lit(1.0).alias("confidence"),
        X.at(now).alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("string").alias("provenance_event_id"), F.lit(None).cast("string").alias("metadata"), X.at(now).alias("created_at"),
    )


def _operation_rows(rows: DataFrame, kind: str, target: str, payload, now) -> DataFrame:
    return rows.select(F.sha2(F.concat_ws("|", F.lit(kind), F.col(target), F.lit(str(now))), 256).alias("id"), F.lit(kind).alias("op_type"), F.col(target).alias("target_id"), payload.alias("payload"), F.lit(None).cast("string").alias("actor_id"), F.lit(None).cast("string").alias("namespace_id"), X.at(now).alias("created_at"))


def superseding(nodes: DataFrame, pairs: DataFrame, now) -> DataFrame:
    """The nodes after `supersede`, and `_new`: what took a node's place just now. Nodes are joined with the pairs once."""
    one = pairs.groupBy(F.col("old_id").alias("id")).agg(F.min("new_id").alias("_new"))
    joined = nodes.join(one, "id", "left").withColumn("_new", F.when(F.col("lifecycle_state").isin(S.ACTIVE), F.col("_new")))
    hit = F.col("_new").isNotNull()
    return joined.withColumns({"lifecycle_state": F.when(hit, "superseded").otherwise(F.col("lifecycle_state")), "superseded_by": F.coalesce("_new", "superseded_by"), "updated_at": F.when(hit, X.at(now)).otherwise(F.col("updated_at"))}).select(*nodes.columns, "_new")


def superseded_edges(moved: DataFrame, now) -> DataFrame:
    """An edge from new to old for what `superseding` moved."""
    return _edge_rows(moved.where("_new IS NOT NULL"), "_new", "id", "supersedes", now)


def supersede(nodes: DataFrame, pairs: DataFrame, now) -> Moved:
    """pairs: (old_id, new_id). Old nodes in an active state become superseded and point at the new; one edge new to old."""
    moved = superseding(nodes, pairs, now)
    refused = pairs.select(F.col("old_id").alias("id")).distinct().join(moved.where("_new IS NOT NULL").select("id"), "id", "left_anti")
    return Moved(moved.drop("_new"), refused, edges=superseded_edges(moved, now))


def contradict(nodes: DataFrame, pairs: DataFrame, now) -> Moved:
    """pairs: (a_id older, b_id newer). Both active: both become contested, an edge b to a, one operation."""
    active = nodes.where(F.col("lifecycle_state").isin(S.ACTIVE)).select("id", "user_id")
    ok = pairs.distinct().join(active.withColumnRenamed("id", "a_id"), "a_id").join(active.select(F.col("id").alias("b_id")), "b_id")
    ids = ok.select(F.col("a_id").alias("id")).unionByName(ok.select(F.col("b_id").alias("id")))
    moved = transition(nodes, ids, "contested", now)
    refused = pairs.join(ok.select("a_id", "b_id"), ["a_id", "b_id"], "left_anti").select(F.col("b_id").alias("id"))
    payload = F.to_json(F.struct("a_id", "b_id"))
    return Moved(moved.nodes, refused, _edge_rows(ok, "b_id", "a_id", "contradicts", now), _operation_rows(ok, "CONTRADICTION_NOTED", "b_id", payload, now))


def resolve(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now) -> Moved:
    """pairs: (winner_id, loser_id), both contested and linked either way: winner stable, loser deprecated."""
    contested = nodes.where("lifecycle_state = 'contested'").select("id")
    linked = edges.where("edge_type = 'contradicts'").select(F.least("source_id", "target_id").alias("lo"), F.greatest("source_id", "target_id").alias("hi")).distinct()
    ok = pairs.distinct().withColumns({"lo": F.least("winner_id", "loser_id"), "hi": F.greatest("winner_id", "loser_id")}).join(linked, ["lo", "hi"], "left_semi")
    ok = ok.join(contested.select(F.col("id").alias("winner_id")), "winner_id", "left_semi").join(contested.select(F.col("id").alias("loser_id")), "loser_id", "left_semi").select("winner_id", "loser_id")
    won = transition(nodes, ok.select(F.col("winner_id").alias("id")), "stable", now)
    lost = transition(won.nodes, ok.select(F.col("loser_id").alias("id")), "deprecated", now)
    payload = F.to_json(F.struct("winner_id", "loser_id"))
    ops = _operation_rows(ok, "CONTRADICTION_RESOLVED", "winner_id", payload, now)
    ops = ops.unionByName(_operation_rows(ok, "EPISTEMIC_TRANSITION", "winner_id", payload, now)).unionByName(_operation_rows(ok, "EPISTEMIC_TRANSITION", "loser_id", payload, now))
    refused = pairs.join(ok, ["winner_id", "loser_id"], "left_anti").select(F.col("loser_id").alias("id"))
    return Moved(lost.nodes, refused, operations=ops)


def reinforce(nodes: DataFrame, hits: DataFrame, now) -> DataFrame:
    """hits: (id, evidence_id), a row per mention. Boost +.15 each up to .5, confidence +.05 each up to .95."""
    agg = hits.groupBy("id").agg(F.count("*").alias("_n"), F.array_sort(F.collect_set("evidence_id")).alias("_e"))
    joined, n = nodes.join(agg, "id", "left"), F.coalesce(F.col("_n"), F.lit(0))
    hit = n > 0
    return joined.withColumns(
        {
            "reinforcement_boost": F.when(hit, F.greatest(F.col("reinforcement_boost"), F.least(F.col("reinforcement_boost") + n * F.lit(0.15), F.lit(0.5)))).otherwise(F.col("reinforcement_boost")),
            "confidence_base": F.when(hit, F.greatest(F.col("confidence_base"), F.least(F.col("confidence_base") + n * F.lit(0.05), F.lit(0.95)))).otherwise(F.col("confidence_base")),
            "last_reinforced_at": F.when(hit, X.at(now)).otherwise(F.col("last_reinforced_at")),
            "evidence_refs": F.array_distinct(F.concat("evidence_refs", F.coalesce("_e", F.array().cast("array<string>")))),
        }
    ).select(*nodes.columns)


def backfill_epistemic(nodes: DataFrame) -> DataFrame:
    """Only nodes without a type: summary is inferred, event and instruction observed, the rest asserted."""
    by_type = F.when(F.col("node_type") == "summary", "inferred").when(F.col("node_type").isin("event", "instruction"), "observed").otherwise("asserted")
    return nodes.withColumn("epistemic_type", F.coalesce("epistemic_type", by_type))
