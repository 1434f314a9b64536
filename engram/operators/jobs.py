"""Maintenance jobs by name: each takes the memory and gives the memory after it."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept
from engram.operators import graph, organizer, quality, store
from engram.sources import tables as T


@dataclass(frozen=True)
class Organizer:
    """Thresholds of the jobs."""

    promote_days: float = 7.0
    promote_evidence: int = 1
    archive_salience: float = 0.05
    duplicate_similarity: float = 0.92
    alias_similarity: float = 0.85
    cluster_similarity: float = 0.80
    cluster_size: int = 3
    feedback_days: int = 30
    cooldown_seconds: float = 3600.0


@dataclass
class Result:
    """A job's outcome: what the memory is now, the ids it changed with what it did, and further output."""

    job: str
    status: str
    tables: T.MemoryTables
    changed: DataFrame | None = None
    output: object = None


# What a job does to a row depends on that row alone, so each is a projection, and several in a row are one pass.


def _acted(t, action, now):
    """`action`: promote, archive, deprecate or null, of each node."""
    state = F.when(action == "promote", "stable").when(action == "archive", "archived").when(action == "deprecate", "deprecated")
    changed = t.nodes.select("id", action.alias("action")).where("action IS NOT NULL")
    return replace(t, nodes=store.transition_where(t.nodes, state, now)), changed, None


def _promote(t, now, c):
    return _acted(t, F.when(organizer.promotes(now, c.promote_days, c.promote_evidence), "promote"), now)


def _decay_sweep(t, now, c):
    return _acted(t, organizer.sweep_action(now), now)


def _archive(t, now, c):
    return _acted(t, F.when(organizer.faded(now, c.archive_salience), "archive"), now)


def _tombstone_sweep(t, now, c):
    ops = store._operation_rows(organizer.expired(t.nodes, now), "TOMBSTONE_SWEEP", "id", F.to_json(F.struct("expired_at")), now)
    after, changed, _ = _acted(t, F.when(organizer.has_expired(now), "archive"), now)
    return replace(after, operations=t.operations.unionByName(ops)), changed, None


def _deduplicate(t, now, c):
    pairs = organizer.exact_duplicates(t.nodes).select(F.col("canonical_id").alias("a_id"), F.col("id").alias("b_id"))
    if t.vectors is not None:
        active = t.nodes.where(F.col("lifecycle_state").isin(S.ACTIVE)).select(F.col("id").alias("node_id"))
        pairs = pairs.unionByName(organizer.near_links(t.vectors.join(active, "node_id", "left_semi"), c.duplicate_similarity))
    nodes, edges = organizer.merge_duplicates(t.nodes, t.edges, pairs, now)
    return replace(t, nodes=nodes, edges=edges), _superseded(t.nodes, nodes), None


def _superseded(before, after):
    return after.where("lifecycle_state = 'superseded'").join(before.where("lifecycle_state <> 'superseded'").select("id"), "id", "left_semi").select("id", F.lit("supersede").alias("action"))


def _alias_resolve(t, now, c):
    known = organizer.alias_pairs(t.nodes)
    aliases = known.unionByName(organizer.semantic_aliases(t.nodes, t.vectors, known, c.alias_similarity)) if t.vectors is not None else known
    nodes, edges = organizer.resolve_aliases(t.nodes, t.edges, aliases, now)
    return replace(t, nodes=nodes, edges=edges), _superseded(t.nodes, nodes), None


def _summarize(t, now, c):
    new = organizer.new_periods(organizer.calendar(t.nodes), organizer.existing_periods(t.nodes))
    nodes, edges = organizer.summary_nodes(new, now)
    # weekly and monthly summaries show periods of the level below, whose nodes have ids of their own
    edges = edges.join(t.nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi").select(*t.edges.columns)
    return replace(t, nodes=t.nodes.unionByName(nodes), edges=t.edges.unionByName(edges)), nodes.select("id", F.lit("create").alias("action")), None


def _consolidate(t, now, c):
    live = t.nodes.where(F.col("lifecycle_state").isin(S.ACTIVE) & F.col("node_type").isin("fact", "event", "note")).select(F.col("id").alias("node_id"))
    clusters = kept(organizer.greedy_clusters(t.vectors.join(live, "node_id", "left_semi"), c.cluster_similarity, c.cluster_size))
    told = organizer.cluster_summaries(clusters, t.nodes).join(clusters.select("leader", "user_id").distinct(), "leader")
    members = clusters.groupBy("leader").agg(F.array_sort(F.collect_list("node_id")).alias("sources"))  # a cluster is one text's sources
    rows = told.join(members, "leader").select("user_id", F.lit("cluster").alias("level"), F.col("leader").alias("period"), "content", "confidence", "salience", "sources")
    nodes, edges = organizer.summary_nodes(rows, now)
    old = organizer.forgettable(clusters, t.nodes, now).join(nodes.select(F.col("id").alias("new_id"), F.get_json_object("metadata", "$.period").alias("leader")), "leader").select("old_id", "new_id")
    moved = store.supersede(t.nodes, old, now)
    return replace(t, nodes=moved.nodes.unionByName(nodes), edges=t.edges.unionByName(edges).unionByName(moved.edges)), nodes.select("id", F.lit("create").alias("action")), None


def _feedback_apply(t, now, c):
    """The tuner folds over the window's signals in order of time; a fold's state is eight numbers, so it runs on the driver, row by row."""
    if t.feedback is None:
        return t, None, S.Weights()
    rows = quality.recent(t.feedback, now, c.feedback_days).orderBy("timestamp", "query", "signal_type").select("signal_type").toLocalIterator()
    return replace(t, feedback=t.feedback.limit(0)), None, quality.tune(S.Weights(), ((r.signal_type, None) for r in rows))


def _snapshot_generation(t, now, c):
    return t, None, graph.snapshots(t.nodes, t.edges)


JOBS: dict[str, Callable] = {
    "promote": _promote, "decay_sweep": _decay_sweep, "archive": _archive, "deduplicate": _deduplicate, "alias_resolve": _alias_resolve, "summarize": _summarize,
    "feedback_apply": _feedback_apply, "tombstone_sweep": _tombstone_sweep, "snapshot_generation": _snapshot_generation, "consolidate": _consolidate,
}


def run_job(name: str, tables: T.MemoryTables, now, config: Organizer = Organizer()) -> Result:
    """Runs a job of `schema.JOBS`; centrality_boost has no rule yet, and an unknown name is skipped."""
    if name not in JOBS:
        return Result(name, "stub" if name in S.JOBS else "skipped", tables)
    after, changed, output = JOBS[name](tables, now, config)
    return Result(name, "done", after, changed, output)


def organize(tables: T.MemoryTables, now, jobs: list[str] | None = None, config: Organizer = Organizer(), budget_seconds: float | None = None) -> list[Result]:
    """Jobs in their fixed order, each on the memory that the one before left. The budget is looked at between jobs."""
    begun, out = time.monotonic(), []
    wanted = S.JOBS if jobs is None else [j for j in S.JOBS if j in jobs] + [j for j in jobs if j not in S.JOBS]
    for name in wanted:
        if budget_seconds is not None and time.monotonic() - begun >= budget_seconds:
            out.append(Result(name, "out of time", tables))
            continue
        out.append(run_job(name, tables, now, config))
        tables = out[-1].tables
    return out


def end_session(tables: T.MemoryTables, now, config: Organizer = Organizer()) -> list[Result]:
    return organize(tables, now, ["promote", "feedback_apply"], config, 1.0)


@dataclass
class Maintenance:
    """Promotion and the decay sweep at most once in a cooldown."""

    config: Organizer = field(default_factory=Organizer)
    last: float | None = None

    def maybe_run(self, tables: T.MemoryTables, now, clock: Callable[[], float] = time.monotonic) -> list[Result] | None:
        if self.last is not None and clock() - self.last < self.config.cooldown_seconds:
            return None
        self.last = clock()
        return organize(tables, now, ["promote", "decay_sweep"], self.config)
