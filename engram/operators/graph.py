"""Traversals over an edge table (source_id, target_id, edge_type): frontier joins, cut by checkpoints, batched over seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X
from engram.functions.frames import kept, small
from engram.operators import match


#: From so many seeds on, and for so many edges, the edges go to the frontiers.
MANY_SEEDS, SENT_EDGES = 100, 2_000_000
SENT_ROWS = 1_000_000  # of what is sent to results that grow with the square of the tables


def both_ways(edges: DataFrame, edge_types: list[str] | None = None, once: bool = True) -> DataFrame:
    """(a, b) for every edge from either end; `once`: each but once."""
    e = edges.where(F.col("edge_type").isin(edge_types)) if edge_types else edges
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    out = e.select(F.inline(F.array(way("source_id", "target_id"), way("target_id", "source_id"))))  # edges are read once
    return out.distinct() if once else out


def k_hop(edges: DataFrame, seeds: DataFrame, max_hops: int = 2, edge_types: list[str] | None = None) -> DataFrame:
    """seeds: (seed) -> (seed, node_id, hop): the least number of edges to every node within reach, seeds left out.

    Every frontier is computed once; the walk ends when one is empty. Edges are met where they lie (a small frontier is sent to
    them, a large one is looked up in parts by node), so nothing is made of edges that no frontier touches and edges are never
    sorted. With many seeds, whose last step may reach most nodes from each,
    it is the other way: frontiers lie by seed, and the edges they touch, once each, are sent to them, so what is reached is told
    apart where it is made and never shuffled. Nodes beside a single node of all frontiers, which no seed has met before, are
    reached once by each seed, so nothing is told apart of them: they are given out as they are made.
    """
    links = both_ways(edges, edge_types, False)
    seen = seeds.select("seed", F.col("seed").alias("node_id"), F.lit(0).alias("hop"))
    many = seen.select("seed").limit(MANY_SEEDS + 1).count() > MANY_SEEDS
    front, out = seen, None
    for hop in range(1, max_hops + 1):
        met, once = links, None
        if not many:  # of few seeds a node is in a frontier a few times at most
            front, seen = (F.broadcast(front), F.broadcast(seen)) if hop == 1 else (small(front, otherwise="shuffle_hash"), seen)
        if many and hop == max_hops:
            met = kept(links.join(small(front.select(F.col("node_id").alias("a")).distinct(), SENT_EDGES), "a", "left_semi").select("a", "b").distinct())
            if met.count() <= SENT_EDGES:
                parts = int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few rows, of which many are made
                each = (front.select("seed", "node_id").distinct() if hop == 1 else front).repartition(parts, "seed")
                lone = met.groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("a")).where("n = 1").select("a", "b")
                lone = kept(lone.join(seen.select(F.col("node_id").alias("b")).distinct(), "b", "left_anti"))
                once = each.join(F.broadcast(lone), each.node_id == lone.a).select("seed", F.col("b").alias("node_id"), F.lit(hop).alias("hop"))
                front, met, seen = front.repartition("seed"), F.broadcast(met.join(lone.select("b"), "b", "left_anti")), small(seen, SENT_ROWS)
        step = front.join(met, front.node_id == met.a).select("seed", F.col("b").alias("node_id")).distinct()
        front = step.join(seen.select("seed", "node_id"), ["seed", "node_id"], "left_anti").withColumn("hop", F.lit(hop))
        front = kept(front) if hop < max_hops else front if once is None else front.unionByName(once)
        out = front if out is None else out.unionByName(front)
        if hop < max_hops and front.isEmpty():
            break
        seen = seen.unionByName(front)
    return out if out is not None else seen.where("false")


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int = 2, edge_types=None, states=None, min_confidence: float | None = None, valid=None) -> DataFrame:
    """k-hop nodes of the seed's own user in the given states; the traversal itself passes through any node."""
    reach = k_hop(edges, seeds, max_hops, edge_types)
    owner = nodes.select(F.col("id").alias("seed"), F.col("user_id").alias("seed_user"))
    out = reach.join(owner, "seed").join(nodes, F.col("node_id") == F.col("id")).where(F.col("user_id") == F.col("seed_user")).where(F.col("lifecycle_state").isin(states or S.ACTIVE))
    out = out.where((F.col("valid_from") <= X.at(valid)) & (F.col("valid_to").isNull() | (F.col("valid_to") > X.at(valid)))) if valid is not None else out
    return out.where(F.col("confidence") >= min_confidence) if min_confidence is not None else out


_PAIR = ["source", "target"]


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 10, edge_types=None) -> DataFrame:
    """pairs: (source, target) -> (source, target, path, hops): the least among the shortest paths, as an array; unreachable pairs
    are absent.

    Nodes of one neighbour lie inside no path, so they leave the graph (`_without_ends`); a source or target that has one neighbour
    left stands for that one, so many pairs become few, each of which is searched for once. The result is made by joins with the
    pairs, once a row.
    """
    todo = pairs.select(*_PAIR)
    ends = kept(todo.select(F.col("source").alias("id")).distinct().unionByName(todo.select(F.col("target").alias("id")).distinct()).distinct())
    links = _without_ends(both_ways(edges, edge_types, False), ends)
    # an end that is in the graph, and what it stands for: its only neighbour, or itself
    one = kept(links.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).select(F.col("a").alias("id"), F.when(F.col("m") == F.col("x"), F.col("m")).otherwise(F.col("a")).alias("core")))
    apart = todo.where("source <> target")
    far = apart.join(small(one.select(F.col("id").alias("source"), F.col("core").alias("s"))), "source").join(small(one.select(F.col("id").alias("target"), F.col("core").alias("t"))), "target")
    beside = (F.col("s") == F.col("target")) | (F.col("t") == F.col("source"))
    cores = kept(far.where(~beside).select(F.col("s").alias("source"), F.col("t").alias("target")).distinct())
    marks = cores.select(F.col("source").alias("id")).unionByName(cores.select(F.col("target").alias("id"))).distinct()
    told = kept(_paths_between(kept(_without_ends(links, marks).distinct()), cores, max_hops).select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("path").alias("core")))
    met = far.where(~beside).join(small(told.select("s", "t")), ["s", "t"], "left_semi").select(*_PAIR, "s", "t").distinct()
    # a core may be its end itself
    end = lambda c, x: F.when(F.col(c) != F.col(x), F.array(x)).otherwise(F.array().cast("array<string>"))
    out = met.join(small(told), ["s", "t"]).select(*_PAIR, F.concat(end("s", "source"), "core", end("t", "target")).alias("path"))
    out = out.unionByName(far.where(beside).select(*_PAIR).distinct().withColumn("path", F.array(*_PAIR))).unionByName(todo.where("source = target").select(*_PAIR).distinct().withColumn("path", F.array("source")))
    return out.where(F.size("path") <= max_hops + 1).select(*_PAIR, "path", (F.size("path") - 1).alias("hops"))


def shortest_paths_across(edges: DataFrame, sources: DataFrame, targets: DataFrame, on: str, max_hops: int = 10, edge_types=None) -> DataFrame:
    """sources: (source, on), targets: (target, on) -> what `shortest_paths` gives for the pairs that agree in `on`, of which
    an end has one value.

    The pairs are never made: what stands for the ends is paired, and ends join what is found between those, so only pairs
    with a path take a row, and none has to be told apart from others.
    """
    sources, targets = (kept(x.select(end, on).distinct()) for x, end in ((sources, "source"), (targets, "target")))
    ends = kept(sources.select(F.col("source").alias("id")).unionByName(targets.select(F.col("target").alias("id"))).distinct())
    links = _without_ends(both_ways(edges, edge_types, False), ends)
    one = kept(links.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).select(F.col("a").alias("id"), F.when(F.col("m") == F.col("x"), F.col("m")).otherwise(F.col("a")).alias("core")))
    stand = lambda x, end, core: kept(x.join(small(one.select(F.col("id").alias(end), F.col("core").alias(core)), SENT_ROWS), end))
    ahead, back = stand(sources, "source", "s"), stand(targets, "target", "t")
    cores = kept(ahead.select(on, "s").distinct().join(back.select(on, "t").distinct(), on).select(F.col("s").alias("source"), F.col("t").alias("target")).distinct())
    marks = cores.select(F.col("source").alias("id")).unionByName(cores.select(F.col("target").alias("id"))).distinct()
    told = kept(_paths_between(kept(_without_ends(links, marks).distinct()), cores, max_hops).select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("path").alias("core")))
    # an end beside the other: found by the links' own keys, and apart from the paths between what they stand for
    near = ahead.join(targets.withColumnRenamed("target", "s"), [on, "s"]).select("source", F.col("s").alias("target"))
    near = near.unionByName(back.join(sources.withColumnRenamed("source", "t"), [on, "t"]).select(F.col("t").alias("source"), "target")).where("source <> target")
    same = sources.join(targets, (sources[on] == targets[on]) & (F.col("source") == F.col("target"))).select("source", "target")
    beside = (F.col("s") == F.col("target")) | (F.col("t") == F.col("source"))
    single = lambda c, x: F.when(F.col(c) != F.col(x), F.array(x)).otherwise(F.array().cast("array<string>"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few rows, of which many are made
    met = ahead.repartition(parts, "source").join(small(told, SENT_ROWS), "s").join(small(back, SENT_ROWS), [on, "t"]).where((F.col("source") != F.col("target")) & ~beside)
    out = met.select(*_PAIR, F.concat(single("s", "source"), "core", single("t", "target")).alias("path"))
    out = out.unionByName(near.distinct().withColumn("path", F.array(*_PAIR))).unionByName(same.withColumn("path", F.array("source")))
    return out.where(F.size("path") <= max_hops + 1).select(*_PAIR, "path", (F.size("path") - 1).alias("hops"))


def _without_ends(links: DataFrame, stay: DataFrame, rounds: int = 4) -> DataFrame:
    """links (a, b) both ways, without nodes of a single link that are not among `stay` (id), and so on in rounds while many go."""
    stay, before = small(stay.withColumnRenamed("id", "a")), None
    for _ in range(rounds):
        many = links.groupBy("a").agg(F.count("*").alias("n"))
        inner = small(kept(many.where("n > 1").select("a").unionByName(many.where("n = 1").select("a").join(stay, "a", "left_semi"))))
        links = kept(links.join(inner, "a", "left_semi").join(inner.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
        now = links.count()
        if before is not None and now > 0.9 * before:
            break
        before = now
    return links


def _paths_between(links: DataFrame, pairs: DataFrame, max_hops: int) -> DataFrame:
    """Distinct pairs -> (source, target, path), over links without repeats.

    From both ends: in each step the side with fewer rows goes one level on, and rows carry nodes, not paths. A pair whose sides
    meet leaves both; one that has come to an end on a side is given up. Paths are made once a pair is met, from its levels.
    """
    todo = pairs
    found = todo.where("source = target").select(*_PAIR, F.array("source").alias("path"))
    ahead, back = ([kept(todo.where("source <> target").select(*_PAIR, F.col(end).alias("node_id")))] for end in _PAIR)
    for _ in range(max_hops):
        n, m = ahead[-1].count(), back[-1].count()
        if not n or not m:
            break
        side, other = (ahead, back) if n <= m else (back, ahead)
        step = side[-1].join(links, F.col("node_id") == F.col("a")).select(*_PAIR, F.col("b").alias("node_id")).distinct()
        for level in side[-2:]:  # links go both ways, so a step leads one level on, nowhere, or one back
            step = step.join(level, [*_PAIR, "node_id"], "left_anti")
        step = kept(step)
        met = kept(step.join(other[-1], [*_PAIR, "node_id"], "left_semi"))
        side.append(step)
        if not met.isEmpty():
            found = found.unionByName(kept(_least_paths(met, ahead, back, links)))
        goes_on = step.select(*_PAIR).distinct().join(met.select(*_PAIR).distinct(), _PAIR, "left_anti").join(other[-1].select(*_PAIR).distinct(), _PAIR, "left_semi")
        side[-1], other[-1] = (kept(x.join(goes_on, _PAIR, "left_semi")) for x in (step, other[-1]))
    return found.select(*_PAIR, "path")


def _least_paths(met: DataFrame, ahead: list[DataFrame], back: list[DataFrame], links: DataFrame) -> DataFrame:
    """Of pairs whose last levels share the nodes `met`: what lies on a shortest path, level by level, then the least walk there."""
    i, hops = len(ahead) - 1, len(ahead) + len(back) - 2
    beside = lambda x: x.join(links, F.col("node_id") == F.col("a")).select(*_PAIR, F.col("b").alias("node_id")).distinct()
    on = {i: met}
    for n in range(i, 0, -1):
        on[n - 1] = kept(beside(on[n]).join(ahead[n - 1], [*_PAIR, "node_id"], "left_semi"))
    for n in range(i, hops):
        on[n + 1] = kept(beside(on[n]).join(back[hops - n - 1], [*_PAIR, "node_id"], "left_semi"))
    walk = met.select(*_PAIR).distinct().withColumns({"at": F.col("source"), "path": F.array("source")})
    for n in range(1, hops + 1):
        there = on[n].withColumnRenamed("node_id", "b")
        walk = walk.join(links, F.col("at") == F.col("a")).join(there, [*_PAIR, "b"]).groupBy(*_PAIR, "path").agg(F.min("b").alias("at"))
        walk = walk.select(*_PAIR, "at", F.concat("path", F.array("at")).alias("path"))
    return walk.select(*_PAIR, "path")


def supersedence_chain(edges: DataFrame, seeds: DataFrame, direction: str = "forward", max_steps: int = 100) -> DataFrame:
    """seeds: (seed) -> (seed, step, node_id). Forward goes to what superseded, backward to what was superseded; the
    least neighbour is taken where there are several, and a chain ends at a node it has met before.

    Pointer doubling: each round doubles how far every node looks ahead, so 100 steps take seven rounds. With seeds as many as
    edges, nodes carry the way ahead of them (`_ways`); with few, only the seeds' ways are made, a row a step.
    """
    e = edges.where("edge_type = 'supersedes'")
    here, there = ("target_id", "source_id") if direction == "forward" else ("source_id", "target_id")
    jump = kept(e.groupBy(F.col(here).alias("at")).agg(F.min(there).alias("to")))  # 2^k steps on, after k rounds
    if seeds.count() * FEW_SEEDS > jump.count():
        ahead = seeds.select("seed").join(_ways(jump, max_steps).withColumnRenamed("at", "seed"), "seed", "left")
        # a way in a circle repeats itself from the first node that it has met, the seed among them
        met = F.array_distinct(F.concat(F.array("seed"), F.coalesce(F.slice("way", 1, max_steps), F.array().cast("array<string>"))))
        return ahead.select("seed", F.posexplode(met).alias("step", "node_id"))
    out, reach = seeds.select("seed", F.lit(0).alias("step"), F.col("seed").alias("node_id")), 1
    while reach <= max_steps:
        far = out.join(jump, F.col("node_id") == F.col("at")).select("seed", (F.col("step") + reach).alias("step"), F.col("to").alias("node_id"))
        out = kept(out.unionByName(far.where(F.col("step") <= max_steps)))
        ahead = jump.select(F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump, reach = kept(jump.join(ahead, "to").select("at", F.col("beyond").alias("to"))), 2 * reach
        if jump.isEmpty():
            return out  # no chain is longer, so none comes back to where it was
    # chains that go on may run in a circle: they end before the first node they have met
    endless = jump.select(F.col("at").alias("seed"))
    ended = out.join(endless, "seed", "left_anti")
    return ended.unionByName(out.join(endless, "seed", "left_semi").groupBy("seed", "node_id").agg(F.min("step").alias("step")).select("seed", "step", "node_id"))


#: Seeds are few if the edges are more than so many times as many.
FEW_SEEDS = 16


def _ways(jump: DataFrame, most: int) -> DataFrame:
    """jump: (at, to), one each -> (at, way): the nodes ahead in order, at least `most` of them or all there are.

    A round appends to a way the way of its last node. Ways that have come to an end leave the rounds and are only appended to
    others, so what a round takes on shrinks with the chains that are so long.
    """
    open_, done, length = jump.select("at", F.array("to").alias("way")), None, 1
    while length < most:
        last = open_.select("at", "way", F.element_at("way", -1).alias("last"))
        every = open_ if done is None else open_.unionByName(done)
        step = last.join(every.select(F.col("at").alias("last"), F.col("way").alias("more")), "last", "left")
        step = kept(step.select("at", F.when(F.col("more").isNull(), F.col("way")).otherwise(F.concat("way", "more")).alias("way")))
        length *= 2
        ended = step.where(F.size("way") < length)
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where(F.size("way") >= length)
        if open_.isEmpty():
            return done
    return open_ if done is None else open_.unionByName(done)


def chain_report(nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, step, node_id, lifecycle_state, content): what superseded a node (steps above 0) and what it superseded (below)."""
    edges = kept(edges.where("edge_type = 'supersedes'").select("source_id", "target_id", "edge_type"))  # both ways are made of them
    ahead = supersedence_chain(edges, seeds, "forward")
    behind = supersedence_chain(edges, seeds, "backward").where("step > 0").withColumn("step", -F.col("step"))
    return ahead.unionByName(behind).join(nodes.select(F.col("id").alias("node_id"), "lifecycle_state", "content"), "node_id", "left")


def graph_candidates(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 3, cap: int = 150, windows: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """seeds: (query_id, seed) -> (query_id, id, graph_proximity): 1.0, 0.7, 0.4 by hop, the best over seeds, capped per query.
    `more`: columns of the nodes that come along.

    windows: (query_id, time_from, time_to): nodes whose validity doesn't overlap a query's window are left out, but entities
    and preferences never are.
    """
    reach = k_hop(edges, seeds.select("seed").distinct(), hops)
    near = F.element_at(F.array(F.lit(1.0), F.lit(0.7), F.lit(0.4)), F.least(F.col("hop"), F.lit(3)))
    best = reach.join(small(seeds), "seed").groupBy("query_id", "node_id").agg(F.max(near).alias("graph_proximity"))
    live = nodes.where(F.col("lifecycle_state").isin(S.LIVE)).select(*dict.fromkeys(("id", "node_type", "confidence", "created_at", "valid_from", "valid_to", *more)))
    found = best.join(live, F.col("node_id") == F.col("id"))
    if windows is not None:
        lasts = F.col("node_type").isin("entity", "preference")
        over = (F.col("valid_to") <= F.col("time_from")) | (F.col("valid_from") > F.col("time_to"))
        found = found.join(windows, "query_id").where(lasts | ~F.coalesce(over, F.lit(False)))
    ranked = found.withColumn("rn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc("created_at"), "id")))
    return ranked.where(F.col("rn") <= cap).select("query_id", "id", "graph_proximity", *more)


def entity_seeds(nodes: DataFrame, terms: DataFrame) -> DataFrame:
    """terms: (query_id, term). Entities whose content holds a term, whatever its case; one pass over the entities.
    A term asked for twice by one query counts once, so what is joined follows the entities, not entities times repeated terms."""
    named = nodes.where("node_type = 'entity'").where(F.col("lifecycle_state").isin(S.LIVE)).select("id", F.lower("content").alias("text"))
    words = kept(terms.select("query_id", F.lower("term").alias("pattern")).distinct())
    return match.holding(named, words).join(small(words), "pattern").select("query_id", F.col("id").alias("seed")).distinct()


#: Kinds of neighbours in a snapshot's summary and listing, with their headings there.
SNAPSHOT_KINDS = [("fact", "Known facts", "Facts"), ("preference", "Preferences", "Preferences"), ("task", "Active tasks", "Tasks"), ("decision", "Recent decisions", "Decisions")]


def snapshots(nodes: DataFrame, edges: DataFrame, valid=None) -> DataFrame:
    """Every active entity with its active 1-hop neighbours by type (newest first), its edges in and out, and a summary.

    An entity's neighbours end as one row, as a snapshot is one text; counts come from aggregates of their own.
    """
    active = nodes.where(F.col("lifecycle_state").isin(S.ACTIVE))
    ent = active.where("node_type = 'entity'").select(F.col("id").alias("entity_id"), F.col("content").alias("entity"))
    others = active if valid is None else active.where((F.col("valid_from") <= valid) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid)))
    others = others.where(F.col("node_type").isin([k for k, _, _ in SNAPSHOT_KINDS])).select("id", "node_type", "content", *(["created_at"] if "created_at" in nodes.columns else [F.lit(None).cast("timestamp_ntz").alias("created_at")]))
    near = ent.join(both_ways(edges), F.col("entity_id") == F.col("a")).join(others, F.col("b") == F.col("id"))
    newest = F.struct((-F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0))).alias("t"), "id", "content")
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("node_type") == k, newest))), lambda x: x["content"]).alias(f"{k}s") for k, _, _ in SNAPSHOT_KINDS]
    grouped = near.groupBy("entity_id").agg(*lists)
    parts = [F.when(F.size(f"{k}s") > 0, F.concat(F.lit(f"{title}: "), F.array_join(f"{k}s", ", "))) for k, title, _ in SNAPSHOT_KINDS]
    outs = edges.groupBy(F.col("source_id").alias("entity_id")).agg(F.count("*").alias("n_out"))
    ins = edges.groupBy(F.col("target_id").alias("entity_id")).agg(F.count("*").alias("n_in"))
    full = ent.join(grouped, "entity_id", "left").join(outs, "entity_id", "left").join(ins, "entity_id", "left")
    return full.withColumn("summary", F.concat(F.concat_ws(". ", F.concat(F.lit("Entity: "), "entity"), *parts), F.lit("."))).na.fill(0, ["n_in", "n_out"])


def render_snapshots(snapshots: DataFrame, now) -> DataFrame:
    """A listing of every snapshot as text."""
    listing = []
    for kind, _, title in [SNAPSHOT_KINDS[i] for i in (0, 1, 3, 2)]:
        listing.append(F.when(F.size(f"{kind}s") > 0, F.concat(F.lit(f"  {title}:\n"), F.array_join(F.transform(f"{kind}s", lambda c: F.concat(F.lit("    - "), c)), "\n"))))
    n = F.col("n_in") + F.col("n_out")
    relations = F.when(n > 0, F.concat(F.lit("  Relationships: "), n.cast("string"), F.lit(" edges")))
    head = F.concat(F.lit("[Entity Snapshot: "), "entity", F.lit("]\n  ID: "), "entity_id", F.lit("\n  Generated: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"))
    return snapshots.select("entity_id", F.concat_ws("\n", head, *listing, relations).alias("text"))


def counterparts(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Contested candidates with the other side of a contradiction; an outgoing edge comes first, then the least id."""
    c = edges.where("edge_type = 'contradicts'")
    sides = c.select(F.col("source_id").alias("id"), F.lit(0).alias("side"), F.col("target_id").alias("other")).unionByName(c.select(F.col("target_id").alias("id"), F.lit(1).alias("side"), F.col("source_id").alias("other")))
    first = sides.groupBy("id").agg(F.min(F.struct("side", "other")).alias("m")).select("id", F.col("m.other").alias("counterpart_id"))
    joined = candidates.join(first, "id", "left")
    flag = (F.col("lifecycle_state") == "contested") & F.col("counterpart_id").isNotNull()
    return joined.withColumns({"conflict_flag": flag, "counterpart_id": F.when(flag, F.col("counterpart_id"))})


def transfer_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """merged: (duplicate_id, canonical_id). Edges of duplicates move to their canonical node; supersedes edges stay, loops go."""
    to = lambda side: merged.select(F.col("duplicate_id").alias(side), F.col("canonical_id").alias(f"_{side}"))
    moved = edges.where("edge_type <> 'supersedes'").join(to("source_id"), "source_id", "left").join(to("target_id"), "target_id", "left")
    moved = moved.withColumns({"source_id": F.coalesce("_source_id", "source_id"), "target_id": F.coalesce("_target_id", "target_id")}).where("source_id <> target_id").select(*edges.columns)
    return edges.where("edge_type = 'supersedes'").unionByName(moved)
