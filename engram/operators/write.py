"""The write path: a batch of messages against the memory as it stood before the batch, in one set-based pass."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept
from engram.operators import graph, ingest, organizer, search, store
from engram.sources import tables as T


class IngestionError(Exception):
    """Rows that the write path can't take."""


@dataclass(frozen=True)
class StoreConfig:
    """What a batch triggers. `remention`: cosine from which neighbours are reinforced (None: never)."""

    surprise: bool = True
    remention: float | None = None
    instruction: float = 0.5
    supersedence: bool = True
    qa_pairs: bool = True


def neighbours(tables: T.MemoryTables, messages: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, id, score, rn, node_type, content): the k nearest live nodes of a message's user."""
    live = tables.nodes.where(F.col("lifecycle_state").isin(S.LIVE)).select("id", "node_type", "content", "lifecycle_state", "user_id")
    v = tables.vectors.select("node_id", "embedding").join(live.select(F.col("id").alias("node_id"), "user_id"), "node_id")
    near = search.vector_topk_batch(v, messages.select(F.col("id").alias("query_id"), "user_id", "embedding"), k)
    return kept(near.join(live.drop("user_id"), F.col("node_id") == F.col("id")).select("query_id", "id", "score", "rn", "node_type", "content", "lifecycle_state"))


def novel(near: DataFrame, new: DataFrame, k: int = 5) -> DataFrame:
    """New nodes with the salience that their novelty gives: .5, raised for what is like nothing known, lowered for the known."""
    top = near.where(F.col("rn") <= k).groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("top"))
    out = new.join(top, "id", "left").withColumn("novelty", X.clamp(F.lit(1.0) - F.coalesce("top", F.lit(0.0))))
    change = F.when(F.col("novelty") >= 0.7, 0.15).when(F.col("novelty") <= 0.3, -0.10).otherwise(0.0)
    worth = X.clamp(F.lit(0.5) + change)
    told = F.to_json(F.struct(F.round("novelty", 4).alias("novelty_score"), F.round(F.coalesce("top", F.lit(0.0)), 4).alias("max_similarity")))
    return out.withColumns({"salience": worth, "salience_base": worth, "metadata": told}).select(*new.columns)


def reinforced(near: DataFrame, config: StoreConfig, k: int = 5) -> DataFrame:
    """(id, evidence_id): active neighbours that a message mentions again, and instructions that it bears out."""
    close = near.where((F.col("rn") <= k) & F.col("lifecycle_state").isin(S.ACTIVE))
    hits = close.where((F.col("node_type") == "instruction") & (F.col("score") >= config.instruction)).select("id", F.col("query_id").alias("evidence_id"))
    if config.remention is not None:
        hits = hits.unionByName(close.where(F.col("score") >= config.remention).select("id", F.col("query_id").alias("evidence_id")))
    return hits


def paired(events: DataFrame, new_events: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of two turns: a message and the one before it in its session, of another role and together under 1000 letters.

    The turn before the batch's first is the last known one of the session.
    """
    before = events.join(new_events.where("session_id IS NOT NULL").select("user_id", "session_id").distinct(), ["user_id", "session_id"], "left_semi")
    last = before.groupBy("user_id", "session_id").agg(F.max(F.struct("timestamp", "id", "role", "content")).alias("x")).select("user_id", "session_id", "x.*", F.lit(False).alias("fresh"))
    turns = new_events.where("session_id IS NOT NULL").select("user_id", "session_id", "timestamp", "id", "role", "content", F.lit(True).alias("fresh"))
    w = Window.partitionBy("user_id", "session_id").orderBy("timestamp", "id")
    rows = last.unionByName(turns).withColumns({"prev_role": F.lag("role").over(w), "prev": F.lag("content").over(w)})
    rows = rows.where(F.col("fresh") & (F.col("prev_role") != F.col("role")) & (F.length("prev") + F.length("content") < 1000))
    merged = rows.select(F.col("id").alias("of"), F.concat_ws("\n", "prev", "content").alias("both"))
    out = new.join(merged, F.col("id") == F.col("of"))
    return out.withColumns({"id": F.concat(F.col("id"), F.lit("+")), "content": F.col("both"), "metadata": F.lit('{"qa_pair":true}'), "ttl_days": F.lit(None).cast("int")}).select(*new.columns)


def store_batch(tables: T.MemoryTables, messages: DataFrame, now, config: StoreConfig = StoreConfig()) -> T.MemoryTables:
    """messages: (id, content, user_id, session_id, role, ...) and maybe timestamp and embedding -> the memory with them.

    Events are appended; nodes get inferred types, prior confidence and a salience by novelty; neighbours are reinforced
    or superseded; chains that flip back cost confidence; turns are paired; both indexes grow. The result is one
    set of tables, so a batch counts whole or not at all.
    """
    m = kept(messages if "embedding" in messages.columns else search.embed(messages))
    if not m.where("id IS NULL OR content IS NULL OR user_id IS NULL").isEmpty():
        raise IngestionError("messages need id, content and user_id")
    m = m.join(tables.events.select("id"), "id", "left_anti")  # a message that is known already changes nothing
    events, new = T.new_events(m.drop("embedding"), now), ingest.store(m.drop("embedding"), now)
    near = neighbours(tables, m)
    new = novel(near, new) if config.surprise else new
    nodes = store.reinforce(tables.nodes, reinforced(near, config), now)
    edges, pairs = tables.edges, None
    if config.supersedence:
        close = near.where(F.col("lifecycle_state").isin(S.ACTIVE)).select("query_id", F.col("id").alias("node_id"), "content")
        pairs = kept(ingest.store_supersedence(new.select("id", "content"), close))
        moved = store.supersede(nodes, pairs, now)
        nodes, edges = moved.nodes, edges.unionByName(moved.edges)
        whole = nodes.unionByName(new)
        chains = graph.supersedence_chain(edges, pairs.select(F.col("new_id").alias("seed")).distinct(), "backward", 10)
        flips = organizer.oscillations(chains, whole).select(F.col("seed").alias("id"), "penalty")
        new = new.join(flips, "id", "left").withColumn("confidence_base", F.greatest(F.col("confidence_base") - F.coalesce("penalty", F.lit(0.0)), F.lit(0.0))).select(*new.columns)
    if config.qa_pairs:
        twos = kept(paired(tables.events, events, new))
        vectors = search.embed(twos.select(F.col("id").alias("node_id"), "user_id", "content"))
        new = new.unionByName(twos)
    else:
        vectors = None
    known = T.migrate(m.select(F.col("id").alias("node_id"), "user_id", "embedding"), S.VECTORS)
    known = known.unionByName(T.migrate(vectors.drop("content"), S.VECTORS)) if vectors is not None else known
    docs = new.select(F.col("id").alias("node_id"), "content", "user_id", "node_type", "scope")
    return replace(
        tables,
        events=tables.events.unionByName(events),
        nodes=nodes.unionByName(new),
        edges=edges,
        vectors=tables.vectors.unionByName(known),
        documents=tables.documents.unionByName(docs) if tables.documents is not None else docs,
    )


def ingest_batch(tables: T.MemoryTables, messages: DataFrame, now, embedder=search.hash_embed) -> tuple[T.MemoryTables, DataFrame]:
    """Messages through extraction, grounding and materialisation: the memory with their events, entities, facts, edges and
    vectors, and a dead-letter table (id, reason) of rows that could not be read; a later batch may take those again.

    A fact that differs from an active one of the same subject and predicate takes its place, or contests it if it is an
    assertion. What the memory knows already counts once: a message, node or edge of a known id changes nothing, so
    a batch may be given again. Of messages with one id in a batch the first by time and text counts.
    """
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("user_id").isNull(), "no user").when(F.trim(F.coalesce("content", F.lit(""))) == "", "no text")
    told = messages.withColumn("reason", reason)
    # the first of an id has none before it; asked so, ids are not sorted before they are shuffled as well
    before = F.lag(F.lit(True)).over(Window.partitionBy("id").orderBy(*[c for c in ("timestamp", "content") if c in messages.columns]))
    good = told.where("reason IS NULL").drop("reason").join(tables.events.select("id"), "id", "left_anti").withColumn("_before", before).where("_before IS NULL").drop("_before")
    extracted = kept(ingest.grounded(ingest.extract(good)))
    good = extracted.select(*good.columns)
    nodes, links = ingest.materialise(extracted, tables.nodes, now)
    new = kept(nodes.join(tables.nodes.select("id"), "id", "left_anti").select(*nodes.columns))
    whole, operations = tables.nodes.unionByName(new), tables.operations
    found = kept(ingest.new_conflicts(tables.nodes, new))
    against = found.where("action = 'contradict'")
    if not against.isEmpty():
        contested = store.contradict(whole, against.select(F.col("old_id").alias("a_id"), F.col("new_id").alias("b_id")), now)
        whole, links, operations = contested.nodes, links.unionByName(contested.edges), operations.unionByName(contested.operations)
    moved = kept(store.superseding(whole, found.where("action = 'supersede'"), now))
    # an id is made of an edge's ends and kind, and each part of `links` has an edge once
    links = links.unionByName(store.superseded_edges(moved, now)).join(tables.edges.select("id"), "id", "left_anti").select(*tables.edges.columns)
    vectors = T.migrate(search.embed(new.select(F.col("id").alias("node_id"), "user_id", "content"), embedder=embedder), S.VECTORS)
    docs = new.select(F.col("id").alias("node_id"), "content", "user_id", "node_type", "scope")
    out = replace(
        tables,
        events=tables.events.unionByName(T.new_events(good, now).select(*tables.events.columns)),
        nodes=moved.drop("_new"),
        edges=kept(tables.edges.unionByName(links)),
        operations=operations,
        vectors=tables.vectors.unionByName(vectors),
        documents=tables.documents.unionByName(docs) if tables.documents is not None else docs,
    )
    return out, told.where("reason IS NOT NULL").select("id", "reason")


def rollback(tables: T.MemoryTables, written: T.MemoryTables) -> T.MemoryTables:
    """The memory without the nodes and edges that `written` added, and their index rows."""
    ids = written.nodes.select("id").join(tables.nodes.select("id"), "id", "left_semi")
    gone = ids.withColumnRenamed("id", "node_id")
    docs = search.delete_indexed(tables.documents, gone) if tables.documents is not None else None
    return replace(tables, nodes=store.delete(tables.nodes, ids), edges=store.delete(tables.edges, written.edges), vectors=search.delete_indexed(tables.vectors, gone), documents=docs)
