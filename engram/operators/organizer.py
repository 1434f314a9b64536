"""Maintenance jobs: each takes tables and gives rows to change; no scan is capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept, small
from engram.operators.search import similar_pairs

STATE_ROWS = 1_000_000  # nodes whose state is sent to all links; of more, it is joined as Spark sees fit

def promotes(now, min_days: float = 7.0, min_evidence: int = 1) -> Column:
    old = X.days_between(F.col("created_at"), X.at(now)) >= min_days
    return (F.col("lifecycle_state") == "tentative") & old & (F.size("evidence_refs") >= min_evidence)


def promotable(nodes: DataFrame, now, min_days: float = 7.0, min_evidence: int = 1) -> DataFrame:
    return nodes.where(promotes(now, min_days, min_evidence)).select("id")


def _swept() -> Column:
    """Whether sweeps look at a node at all: live, not pinned; entities and facts only with a TTL."""
    return F.col("lifecycle_state").isin(S.LIVE) & ~F.col("pinned") & (~F.col("node_type").isin("entity", "fact") | F.col("ttl_days").isNotNull())


def sweep_action(now) -> Column:
    """archive or deprecate by decayed salience and confidence; null for neither."""
    salience, confidence = X.effective_salience(now, pinned_adds_boost=True), X.effective_confidence(now, observed_inclusive=True)
    low = F.when(salience < 0.05, "archive").when(confidence < 0.15, F.when(F.col("lifecycle_state") == "contested", "deprecate").otherwise("archive"))
    return F.when(_swept(), low.when((salience < 0.10) & (confidence < 0.40), "archive"))


def faded(now, below: float) -> Column:
    """Whether the archive job takes a node: swept, and of a salience below its bound."""
    return sweep_action(now).isNotNull() & (X.effective_salience(now, pinned_adds_boost=True) < below)


def sweep_actions(nodes: DataFrame, now) -> DataFrame:
    """(id, action, salience, confidence) of what a sweep changes."""
    rows = nodes.where(_swept()).withColumn("action", sweep_action(now)).where("action IS NOT NULL")
    return rows.select("id", "action", F.round(X.effective_salience(now, pinned_adds_boost=True), 8).alias("salience"), F.round(X.effective_confidence(now, observed_inclusive=True), 8).alias("confidence"))


def expiry() -> Column:
    return F.col("created_at") + F.make_dt_interval(F.col("ttl_days"))


def has_expired(now) -> Column:
    return F.coalesce(F.col("ttl_days").isNotNull() & ~F.col("pinned") & (F.col("lifecycle_state") != "archived") & (expiry() < X.at(now)), F.lit(False))


def expired(nodes: DataFrame, now) -> DataFrame:
    """Unpinned nodes whose creation and TTL lie before now."""
    return nodes.where(has_expired(now)).select("id", expiry().alias("expired_at"))


def exact_duplicates(nodes: DataFrame) -> DataFrame:
    """(user_id, key, canonical_id, id) for texts equal once trimmed and lower-cased; linear in the group."""
    key = F.sha2(F.lower(F.trim("content")), 256)
    rows = nodes.where(F.col("lifecycle_state").isin(S.ACTIVE)).select("user_id", key.alias("key"), "id")
    first = rows.groupBy("user_id", "key").agg(F.min("id").alias("canonical_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(first, ["user_id", "key"]).where("id <> canonical_id")


def near_duplicates(vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    return similar_pairs(vectors, threshold)


def near_links(vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """(a_id, b_id): pairs that connect what `near_duplicates` connects. Equal vectors of a user are linked to the one of least id
    and only that one is compared, so n copies give n - 1 pairs."""
    rows = vectors.select("node_id", "user_id", "embedding")
    first = kept(rows.groupBy("user_id", "embedding").agg(F.min("node_id").alias("rep"), F.count("*").alias("n")))
    copies = rows.join(first.where("n > 1"), ["user_id", "embedding"]).where("node_id <> rep").select(F.col("rep").alias("a_id"), F.col("node_id").alias("b_id"))
    return similar_pairs(first.select(F.col("rep").alias("node_id"), "user_id", "embedding"), threshold).select("a_id", "b_id").unionByName(copies)


def canonical(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """groups: (group_id, id) -> the canonical node of each: surest, most evidence, oldest, least id."""
    rows = groups.join(nodes.select("id", "confidence_base", "evidence_refs", "created_at"), "id")
    rn = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("confidence_base"), F.desc(F.size("evidence_refs")), "created_at", "id"))
    keep = rows.withColumn("rn", rn).where("rn = 1").select("group_id", F.col("id").alias("canonical_id"))
    return groups.join(keep, "group_id").where("id <> canonical_id").select("group_id", F.col("id").alias("duplicate_id"), "canonical_id")


def group_pairs(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(a_id, b_id) -> (group_id, id): least id that pairs reach, by label propagation with pointer jumps until nothing
    changes. Raises if `rounds` don't suffice."""
    links = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(pairs.select(F.col("b_id").alias("a"), F.col("a_id").alias("b"))).distinct()
    links = kept(links)
    label = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("group_id"))
    for _ in range(rounds):
        step = links.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("group_id").alias("m"))
        new = label.join(step, "id").select("id", F.least("group_id", "m").alias("group_id"))
        jump = new.select(F.col("id").alias("group_id"), F.col("group_id").alias("root"))
        new = kept(new.join(jump, "group_id").select("id", F.col("root").alias("group_id")))
        if new.join(label.withColumnRenamed("group_id", "old"), "id").where("group_id <> old").isEmpty():
            return new
        label = new
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def merge_evidence(nodes: DataFrame, merged: DataFrame) -> DataFrame:
    """Canonical nodes get the evidence of their duplicates."""
    more = merged.join(nodes.select(F.col("id").alias("duplicate_id"), "evidence_refs"), "duplicate_id").groupBy(F.col("canonical_id").alias("id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_refs")))).alias("_more"))
    return nodes.join(more, "id", "left").withColumn("evidence_refs", F.array_distinct(F.concat("evidence_refs", F.coalesce("_more", F.array().cast("array<string>"))))).select(*nodes.columns)


def alias_pairs(nodes: DataFrame) -> DataFrame:
    """(a_id, b_id, reason, similarity): entities of a user that are known abbreviations of one another, or differ in case."""
    spark = nodes.sparkSession
    known = spark.createDataFrame([(a, c) for c, names in S.ALIASES.items() for a in [c, *names]], "name string, canonical string")
    e = nodes.where("node_type = 'entity'").where(F.col("lifecycle_state").isin(S.LIVE)).select("id", "user_id", F.trim("content").alias("content"), F.lower(F.trim("content")).alias("name"))
    named = e.join(F.broadcast(known), "name", "left").withColumn("key", F.coalesce("canonical", "name"))
    first = named.groupBy("user_id", "key").agg(F.min(F.struct("id", "name", "content")).alias("f"), F.count("*").alias("n")).where("n > 1")
    rows = named.join(first, ["user_id", "key"]).where(F.col("id") != F.col("f.id"))
    same = F.col("name") == F.col("f.name")
    return rows.where(~same | (F.col("content") != F.col("f.content"))).select(F.col("f.id").alias("a_id"), F.col("id").alias("b_id"), F.when(same, "case_variation").otherwise("abbreviation").alias("reason"), F.when(same, 0.90).otherwise(0.95).alias("similarity"))


def semantic_aliases(nodes: DataFrame, vectors: DataFrame, known: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs of a user's active entities with similar vectors that `known` (a_id, b_id) doesn't hold: (a_id, b_id, reason, similarity)."""
    e = nodes.where("node_type = 'entity'").where(F.col("lifecycle_state").isin(S.ACTIVE)).select(F.col("id").alias("node_id"))
    near = similar_pairs(vectors.join(e, "node_id", "left_semi"), threshold)
    told = known.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"))
    return near.join(told, ["a_id", "b_id"], "left_anti").select("a_id", "b_id", F.lit("semantic").alias("reason"), "similarity")


def resolve_aliases(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, now, least: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """aliases: (a_id, b_id, reason, similarity). Sure ones merge: of a group the longest name stays (then the surest, with
    most evidence, oldest, of least id), takes evidence and edges, and supersedes the others. Others are linked by a
    relates_to edge."""
    from engram.operators import store
    from engram.operators.graph import transfer_edges

    active = nodes.where(F.col("lifecycle_state").isin(S.ACTIVE))
    ids = active.select("id")
    both = aliases.join(ids.select(F.col("id").alias("a_id")), "a_id", "left_semi").join(ids.select(F.col("id").alias("b_id")), "b_id", "left_semi")
    groups = group_pairs(both.where(F.col("similarity") >= least).select("a_id", "b_id"))
    rows = groups.join(active.select("id", F.length(F.trim("content")).alias("name"), "confidence_base", F.size("evidence_refs").alias("refs"), "created_at"), "id")
    best = rows.groupBy("group_id").agg(F.min(F.struct((-F.col("name")).alias("a"), (-F.col("confidence_base")).alias("b"), (-F.col("refs")).alias("c"), "created_at", "id")).alias("x")).select("group_id", F.col("x.id").alias("canonical_id"))
    merged = kept(groups.join(best, "group_id").where("id <> canonical_id").select(F.col("id").alias("duplicate_id"), "canonical_id"))
    moved = store.supersede(merge_evidence(nodes, merged), merged.select(F.col("duplicate_id").alias("old_id"), F.col("canonical_id").alias("new_id")), now)
    gone = merged.select(F.col("duplicate_id").alias("id"))
    loose = both.where(F.col("similarity") < least).join(gone.withColumnRenamed("id", "a_id"), "a_id", "left_anti").join(gone.withColumnRenamed("id", "b_id"), "b_id", "left_anti")
    linked = store._edge_rows(loose.join(nodes.select(F.col("id").alias("a_id"), "user_id"), "a_id"), "a_id", "b_id", "relates_to", now)
    return moved.nodes, transfer_edges(edges, merged).unionByName(moved.edges).unionByName(linked)


def merge_duplicates(nodes: DataFrame, edges: DataFrame, pairs: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """pairs: (a_id, b_id) of duplicates. Of each group one stays, takes evidence and edges, and supersedes the rest."""
    from engram.operators import store
    from engram.operators.graph import transfer_edges

    merged = kept(canonical(group_pairs(pairs), nodes).select("duplicate_id", "canonical_id"))
    moved = store.supersede(merge_evidence(nodes, merged), merged.select(F.col("duplicate_id").alias("old_id"), F.col("canonical_id").alias("new_id")), now)
    return moved.nodes, transfer_edges(edges, merged).unionByName(moved.edges)


PERIODS = {"daily": ("yyyy-MM-dd", 5), "weekly": (None, 3), "monthly": ("yyyy-MM", 2)}


def period_key(level: str, t):
    if level == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), t).cast("string"), 2, "0"))
    return F.date_format(t, PERIODS[level][0])


def roll_up(rows: DataFrame, level: str, least: int | None = None, top: int = 10) -> DataFrame:
    """rows: (user_id, t, id, content, salience_base, confidence_base, created_at) -> summaries per user and period: the
    `top` most salient texts, and means over all of them."""
    least = PERIODS[level][1] if least is None else least
    keyed = rows.withColumn("period", period_key(level, F.col("t")))
    rn = F.row_number().over(Window.partitionBy("user_id", "period").orderBy(F.desc("salience_base"), F.desc("confidence_base"), F.desc("created_at"), "id"))
    keyed = keyed.withColumn("rn", rn)
    short = F.concat(F.substring("content", 1, 200), F.when(F.length("content") > 200, "...").otherwise(""))
    best = F.array_sort(F.collect_list(F.when(F.col("rn") <= top, F.struct("rn", short.alias("c"), "id"))))
    out = keyed.groupBy("user_id", "period").agg(F.count("*").alias("n"), F.avg("salience_base").alias("salience"), F.avg("confidence_base").alias("confidence"), F.min("t").alias("t"), best.alias("b"))
    bullets = F.array_join(F.concat(F.array(F.concat(F.lit(f"[{level} summary: "), "period", F.lit("]"))), F.transform("b", lambda x: F.concat(F.lit("- "), x["c"]))), "\n")
    return out.where(F.col("n") >= least).select("user_id", F.lit(level).alias("level"), "period", "n", X.clamp(F.col("salience")).alias("salience"), X.clamp(F.col("confidence")).alias("confidence"), "t", bullets.alias("content"), F.transform("b", lambda x: x["id"]).alias("sources"))


def summary_nodes(summaries: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Summaries as stable nodes of the system's scope, and a derived_from edge to every text they show."""
    from engram.operators.store import _edge_rows
    from engram.sources.tables import migrate

    told = summaries.withColumn("id", F.sha2(F.concat_ws("|", F.lit("summary"), "user_id", "level", "period"), 256))
    rows = told.select(
        "id", "user_id", "content", F.lit("summary").alias("node_type"), F.lit("system").alias("scope"), F.to_json(F.struct("level", "period")).alias("metadata"), F.lit("stable").alias("lifecycle_state"), F.col("confidence"), F.col("salience"),
        F.col("confidence").alias("confidence_base"), F.col("salience").alias("salience_base"), F.lit("inferred").alias("epistemic_type"), F.lit("system_inferred").alias("source_type"), F.lit("slow").alias("decay_profile"),
        F.col("sources").alias("evidence_refs"), F.lit(S.TTL_DAYS["summary"]).alias("ttl_days"), *[X.at(now).alias(c) for c in ("valid_from", "created_at", "updated_at", "last_reinforced_at")],
    )
    edges = _edge_rows(told.select("id", "user_id", F.explode("sources").alias("source")), "id", "source", "derived_from", now)
    return migrate(rows, S.NODES), edges


def existing_periods(nodes: DataFrame) -> DataFrame:
    """(user_id, level, period) of active summaries."""
    told = nodes.where("node_type = 'summary'").where(F.col("lifecycle_state").isin(S.ACTIVE))
    return told.select("user_id", F.get_json_object("metadata", "$.level").alias("level"), F.get_json_object("metadata", "$.period").alias("period")).where("period IS NOT NULL").distinct()


def calendar(nodes: DataFrame) -> DataFrame:
    """Daily, then weekly over daily, then monthly over weekly summaries; by period, not by the time of the run."""
    base = nodes.where(F.col("lifecycle_state").isin(S.LIVE) & (F.col("node_type") != "summary"))
    daily = roll_up(base.select("user_id", F.col("created_at").alias("t"), "id", "content", "salience_base", "confidence_base", "created_at"), "daily")
    again = lambda s: s.select("user_id", "t", F.col("period").alias("id"), "content", F.col("salience").alias("salience_base"), F.col("confidence").alias("confidence_base"), F.col("t").alias("created_at"))
    weekly = roll_up(again(daily), "weekly")
    monthly = roll_up(again(weekly), "monthly")
    return daily.unionByName(weekly).unionByName(monthly)


def new_periods(summaries: DataFrame, existing: DataFrame) -> DataFrame:
    return summaries.join(existing.select("user_id", "level", "period").distinct(), ["user_id", "level", "period"], "left_anti")


def greedy_clusters(vectors: DataFrame, threshold: float = 0.80, least: int = 3) -> DataFrame:
    """(node_id, user_id, embedding) -> (user_id, leader, node_id). In id order, a free node takes all free ones that are
    similar to it, if they are `least` with it."""
    owner = vectors.select(F.col("node_id").alias("leader"), "user_id")
    return greedy_groups(similar_pairs(vectors, threshold), least).join(owner, "leader").select("user_id", "leader", "node_id")


def greedy_groups(pairs: DataFrame, least: int = 3) -> DataFrame:
    """(a_id, b_id) -> (leader, node_id): what going through the nodes in id order gives, where a free node with `least` - 1 free
    neighbours or more takes them all.

    In rounds that narrow down what may still happen: a node is taken by the least leader beside it, so one with a leader before it
    leads nothing. A node leads once no undecided one before it is beside it, and enough neighbours have neither a leader nor an
    undecided node before it beside them; it doesn't once too few may be free. The least undecided node always decides. `least` is 2 or more.
    A round is two aggregates over the links, to which the nodes' state is sent; rounds are about as many as the logarithm of
    the nodes when ids are in no order of likeness (and as many as the longest run of rising ids when they are).
    """
    both = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).unionByName(pairs.select(F.col("b_id").alias("a"), F.col("a_id").alias("b")))
    every = links = kept(both.where("a <> b").distinct().repartition("a"))
    # t: the least leader beside a node that is known so far
    state = kept(links.select(F.col("a").alias("id")).distinct().select("id", F.lit(None).cast("string").alias("t"), F.lit(True).alias("open"), F.lit(False).alias("leads")))
    before = waiting = state.count()
    while waiting:
        told = small(state.select(F.col("id").alias("b"), "open", "leads"), STATE_ROWS)
        near = links.join(told, "b").groupBy(F.col("a").alias("id")).agg(F.min(F.when(F.col("open"), F.col("b"))).alias("u"), F.min(F.when(F.col("leads"), F.col("b"))).alias("m"))
        near = kept(state.join(near, "id", "left").select("id", "open", "leads", F.least("t", "m").alias("t"), "u"))
        mine = small(near.where("open").select(F.col("id").alias("a")), STATE_ROWS)
        yours = small(near.select(F.col("id").alias("b"), "t", "u"), STATE_ROWS)
        free, sure = F.coalesce(F.col("t") >= F.col("a"), F.lit(True)), F.coalesce(F.col("u") >= F.col("a"), F.lit(True))
        many = links.join(mine, "a", "left_semi").join(yours, "b").groupBy(F.col("a").alias("id")).agg(F.count_if(free & sure).alias("lo"), F.count_if(free).alias("hi"))
        taken, first = F.coalesce(F.col("t") < F.col("id"), F.lit(False)), F.coalesce(F.col("u") > F.col("id"), F.lit(True))
        leads, never = F.col("open") & ~taken & first & (F.col("lo") >= least - 1), taken | (F.col("hi") < least - 1)
        state = kept(near.join(many, "id", "left").select("id", "t", (F.col("open") & ~leads & ~never).alias("open"), (F.col("leads") | leads).alias("leads")))
        waiting = state.where("open").count()
        if 0 < 2 * waiting < before:  # links without an end that was open before this round tell nothing more
            live = small(near.where("open").select("id"), STATE_ROWS).withColumn("yes", F.lit(True))
            links = links.join(live.select(F.col("id").alias("a"), F.col("yes").alias("x")), "a", "left").join(live.select(F.col("id").alias("b"), F.col("yes").alias("y")), "b", "left")
            links, before = kept(links.where("x or y").select("a", "b").repartition("a")), waiting
    leader = state.where("leads").select("id")
    taken = every.join(small(leader.withColumnRenamed("id", "b"), STATE_ROWS), "b", "left_semi").groupBy(F.col("a").alias("node_id")).agg(F.min("b").alias("leader"))
    return taken.select("leader", "node_id").unionByName(leader.select(F.col("id").alias("leader"), F.col("id").alias("node_id")))


def cluster_summaries(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """A text of the three surest distinct contents, mean confidence and greatest salience per cluster."""
    rows = clusters.join(nodes.select(F.col("id").alias("node_id"), "content", "confidence", "salience"), "node_id")
    one = rows.groupBy("leader", "content").agg(F.max("confidence").alias("c"), F.sum("confidence").alias("s"), F.count("*").alias("n"), F.max("salience").alias("sal"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "content"))), 1, 3)
    return one.groupBy("leader").agg(F.array_join(F.transform(top, lambda x: x["content"]), " | ").alias("content"), (F.sum("s") / F.sum("n")).alias("confidence"), F.max("sal").alias("salience"), F.sum("n").alias("members"))


def forgettable(clusters: DataFrame, nodes: DataFrame, now, recent_days: int = 7, keep_confidence: float = 0.8) -> DataFrame:
    """(old_id, leader): members that are neither recent nor sure."""
    rows = clusters.join(nodes.select(F.col("id").alias("node_id"), "confidence", "created_at"), "node_id")
    return rows.where((F.col("confidence") < keep_confidence) & (X.days_between(F.col("created_at"), X.at(now)) > recent_days)).select(F.col("node_id").alias("old_id"), "leader")


def keywords(text):
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(S.STOP_WORDS)))


def oscillations(chains: DataFrame, nodes: DataFrame, least: float = 0.3) -> DataFrame:
    """chains: (seed, step, node_id) backward. Even steps like the head in keywords are flips; the penalty is .1 each, .3 at most."""
    words = nodes.select(F.col("id").alias("node_id"), keywords(F.col("content")).alias("w"))
    rows = chains.join(words, "node_id")
    head = rows.where("step = 0").select("seed", F.col("w").alias("h"))
    both = rows.where("step > 0 AND step % 2 = 0").join(head, "seed")
    jac = F.when((F.size("w") > 0) & (F.size("h") > 0), F.size(F.array_intersect("w", "h")) / F.size(F.array_union("w", "h"))).otherwise(0.0)
    hits = both.where(jac >= least)
    return hits.groupBy("seed").agg(F.count("*").alias("cycles"), F.array_sort(F.collect_list("node_id")).alias("node_ids"), F.array_join(F.slice(F.array_sort(F.first(F.array_intersect("w", "h"))), 1, 5), " ").alias("topic")).withColumn("penalty", F.round(F.least(F.col("cycles") * 0.1, F.lit(0.3)), 10))

