"""Set-based algorithms against the step-by-step versions they stand for."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import graph, match, organizer, write
from engram.sources import tables as T
from engram.sources.commits import CommitConflict, VersionedMemory


def edges_of(spark, pairs, kind="relates_to"):
    return spark.createDataFrame([(a, b, kind) for a, b in pairs], "source_id string, target_id string, edge_type string")


def walk_in_order(pairs, least):
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    taken, out = set(), set()
    for a in sorted(near):
        own = [a, *sorted(near[a] - taken - {a})]
        if a not in taken and len(own) >= least:
            taken.update(own)
            out |= {(a, x) for x in own}
    return out


@pytest.mark.parametrize(("n", "m", "least"), [(40, 50, 3), (60, 200, 3), (30, 15, 2), (50, 90, 6)])
def test_greedy_groups_equal_a_walk_in_order(spark, n, m, least):
    rng = np.random.default_rng(n)
    pairs = sorted({tuple(sorted(f"{i:02d}" for i in rng.choice(n, 2, replace=False))) for _ in range(m)} | {("00", f"{i:02d}") for i in range(0, n, 5) if i})
    got = [tuple(r) for r in organizer.greedy_groups(spark.createDataFrame(pairs, "a_id string, b_id string"), least).collect()]
    assert len(got) == len(set(got)) and set(got) == walk_in_order(pairs, least)


def test_greedy_groups_of_a_clique_a_path_and_nothing(spark):
    clique = [(f"a{i}", f"a{j}") for i in range(12) for j in range(i)]
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(14)]
    got = {tuple(r) for r in organizer.greedy_groups(spark.createDataFrame(clique + path, "a_id string, b_id string")).collect()}
    assert got == walk_in_order(clique + path, 3)
    assert organizer.greedy_groups(spark.createDataFrame([], "a_id string, b_id string")).collect() == []


def test_copies_are_linked_to_one(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(30, 5))
    rows = [(f"n{i:03d}", "u" if i % 2 else "w", (m[0] if i < 60 else m[i % 30]).astype(float).tolist()) for i in range(120)]
    v = spark.createDataFrame(rows, "node_id string, user_id string, embedding array<float>")
    links = organizer.near_links(v, 0.9)
    assert links.count() < 400 < organizer.near_duplicates(v, 0.9).count()
    groups = lambda pairs: {(r.group_id, r.id) for r in organizer.group_pairs(pairs).collect()}
    assert groups(links) == groups(organizer.near_duplicates(v, 0.9).select("a_id", "b_id"))


def least_path(links, a, b, most):
    level, paths = {a: (a,)}, {a: (a,)}
    for _ in range(most):
        if b in paths:
            break
        step = {}
        for x, p in level.items():
            for y in links[x]:
                if y not in paths and (y not in step or p + (y,) < step[y]):
                    step[y] = p + (y,)
        paths |= step
        level = step
    return paths.get(b)


@pytest.mark.parametrize("seed", range(4))
def test_paths_are_the_least_of_the_shortest(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 30, (38, 2)) if a != b] + [("w1", "w2")]
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)
    ends = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 30, (40, 2))] + [("v0", "w1"), ("w1", "w2"), ("w2", "w2"), ("v0", "nowhere")]
    for most in (10, 3):
        got = {(r.source, r.target): (tuple(r.path), r.hops) for r in graph.shortest_paths(edges_of(spark, pairs), spark.createDataFrame(ends, "source string, target string"), most).collect()}
        want = {(a, b): least_path(links, a, b, most) for a, b in ends}
        assert got == {k: (p, len(p) - 1) for k, p in want.items() if p}


def test_chains_with_circles_and_forks(spark):
    pairs = [(f"a{i + 1}", f"a{i}") for i in range(9)] + [("b1", "b0"), ("b2", "b1"), ("b0", "b2"), ("t", "s"), ("b1", "t"), ("x1", "x0"), ("x2", "x0"), ("m", "m")] + [(f"l{i + 1:03d}", f"l{i:03d}") for i in range(130)]
    seeds = ["a0", "a4", "b0", "s", "x0", "m", "l000", "l100", "none"]
    for most in (100, 10, 1):
        rows = graph.supersedence_chain(edges_of(spark, pairs, "supersedes"), spark.createDataFrame([(s,) for s in seeds], "seed string"), "forward", most).collect()
        to = {}
        for new, old in pairs:
            to[old] = min(to.get(old, new), new)
        want = set()
        for s in seeds:
            path = [s]
            while path[-1] in to and to[path[-1]] not in path and len(path) <= most:
                path.append(to[path[-1]])
            want |= {(s, i, x) for i, x in enumerate(path)}
        got = [(r.seed, r.step, r.node_id) for r in rows]
        assert len(got) == len(want) and set(got) == want


def test_patterns_in_one_pass_and_in_several(spark):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abc"), n))
    texts = [(str(i), word(rng.integers(0, 30))) for i in range(300)] + [("999", None)]
    patterns = sorted({word(rng.integers(1, 6)) for _ in range(200)}) + [""]
    want = {(i, p) for i, t in texts for p in patterns if p and p in (t or "")}
    df, ps = spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    for letters in (1 << 20, 100):
        got = [tuple(r) for r in match.holding(df, ps, letters).collect()]
        assert len(got) == len(want) and set(got) == want
    assert match.holding(df, ps.limit(0)).collect() == []
    owned = df.withColumn("owner", F.when(F.col("id").cast("int") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id").cast("int") % 5)))
    mine = spark.createDataFrame([("hot" if i % 2 else f"o{i % 5}", p) for i, p in enumerate(patterns)], "owner string, pattern string")
    own = {(r.owner, r.id): r.text for r in owned.collect()}
    want = {(o, i, r.pattern) for (o, i), t in own.items() for r in mine.collect() if r.owner == o and r.pattern and r.pattern in (t or "")}
    for rows in (10_000, 7):
        got = [tuple(r) for r in match.holding_own(owned.select("owner", "id", "text"), mine, rows).collect()]
        assert len(got) == len(want) and set(got) == want


SAID = [("e1", "u", "Ada lives in Paris.", "2024-01-01"), ("e2", "u", "Ada lives in London.", "2024-01-02"), ("e3", "u", "Bob uses Spark.", "2024-01-01"), ("e4", None, "Ada is here", "2024-01-01"), ("e5", "u", " ", "2024-01-01"), ("e1", "u", "Ada lives in Rome.", "2024-01-09"), (None, "u", "Ada is Ada.", "2024-01-01")]


def messages(spark, rows):
    return spark.createDataFrame(rows, "id string, user_id string, content string, day string").select("id", "user_id", "content", F.to_timestamp_ntz("day").alias("timestamp"), F.lit("personal").alias("scope"))


def told(t):
    return {(r.content, r.lifecycle_state) for r in t.nodes.where("node_type = 'fact'").collect()}


def test_ingestion_counts_once_and_resolves_conflicts(spark):
    t, dead = write.ingest_batch(T.empty_tables(spark), messages(spark, SAID), "2024-02-01 00:00:00")
    assert {tuple(r) for r in dead.collect()} == {("e4", "no user"), ("e5", "no text"), (None, "no id")}
    assert told(t) == {("Ada lives_in Paris", "superseded"), ("Ada lives_in London", "tentative"), ("Bob uses Spark", "tentative")}
    counts = lambda x: [df.count() for df in (x.events, x.nodes, x.edges, x.vectors, x.documents, x.operations)]
    once = counts(t)
    assert once[0] == 3 and once[1] == once[3] == once[4] == 3 + 5 and t.nodes.select("id").distinct().count() == once[1] and t.edges.select("id").distinct().count() == once[2]
    again, _ = write.ingest_batch(t, messages(spark, SAID), "2024-02-02 00:00:00")
    assert counts(again) == once and told(again) == told(t)
    more, _ = write.ingest_batch(again, messages(spark, [("e9", "u", "ada resides in London. Ada located in Rome.", "2023-01-01"), ("e8", "v", "Ada lives in Oslo.", "2024-01-01")]), "2024-02-03 00:00:00")
    states = Counter(s for _, s in told(more))
    assert ("Ada lives_in London", "superseded") in told(more) and ("Ada lives_in Oslo", "tentative") in told(more) and states["superseded"] >= 2


def test_an_assertion_contests(spark, monkeypatch):
    from engram.operators import ingest

    plain = ingest.extract

    def extract(events):
        out = plain(events)
        return out.withColumn("facts", F.transform("facts", lambda f: f.withField("temporal_intent", F.when(F.contains(F.col("content"), F.lit("!")), "assertion").otherwise("update"))))

    monkeypatch.setattr(ingest, "extract", extract)
    t, _ = write.ingest_batch(T.empty_tables(spark), messages(spark, [("a", "u", "Ada lives in Paris.", "2024-01-01")]), "2024-02-01 00:00:00")
    t, _ = write.ingest_batch(t, messages(spark, [("b", "u", "Ada lives in Rome!", "2024-01-02")]), "2024-02-02 00:00:00")
    assert told(t) == {("Ada lives_in Paris", "contested"), ("Ada lives_in Rome", "contested")}
    assert [r.op_type for r in t.operations.collect()] == ["CONTRADICTION_NOTED"] and t.edges.where("edge_type = 'contradicts'").count() == 1


def test_conflicts_are_one_shuffle_and_one_sort(spark):
    from engram.operators import ingest

    rows = [("a", "u", "Ada", "joined", "X", 1), ("b", "u", "ada ", "works_at", "x", 2), ("c", "u", "Ada", "employed_by", "Y", 3)]
    facts = spark.createDataFrame(rows, "id string, user_id string, subject string, predicate string, object string, created_at int").withColumns({"temporal_intent": F.lit(None).cast("string"), "fresh": F.col("id") != "a"})
    found = ingest.fact_conflicts(facts)
    assert {tuple(r) for r in found.collect()} == {("a", "c", "supersede"), ("b", "c", "supersede")}
    assert ingest.fact_conflicts(facts.withColumn("fresh", F.col("id") == "a")).isEmpty()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_a_text_may_say_the_same_twice(spark):
    said = messages(spark, [("a", "u", "Ada lives in Paris. Ada lives in Paris. Ada knows Bob, Ada knows Bob.", "2024-01-01"), ("b", "u", "Ada knows Bob.", "2024-01-02")])
    t, _ = write.ingest_batch(T.empty_tables(spark), said, "2024-02-01 00:00:00")
    assert sorted((r.node_type, r.content) for r in t.nodes.collect()) == [("entity", "Ada"), ("entity", "Bob"), ("entity", "Paris"), ("fact", "Ada lives_in Paris")]
    assert sorted(r.edge_type for r in t.edges.collect()) == ["has_fact", "relates_to"]


# --- versions


def sizes(t):
    return [getattr(t, n).count() for n in ("events", "nodes", "edges", "vectors", "documents")]


def test_a_batch_counts_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    memory = VersionedMemory(spark, f"file://{tmp_path}/memory")
    batch = lambda n: messages(spark, [(f"e{n}", "u", f"Ada lives in Town{n}.", f"2024-01-{n + 1:02d}")])
    ingested = lambda n: lambda t: write.ingest_batch(t, batch(n), f"2024-02-{n + 1:02d} 00:00:00")[0]
    one = memory.apply(ingested(0))
    assert memory.versions() == [1] and sizes(one) == [1, 3, 1, 3, 3]

    # a batch that dies between two tables changes nothing that readers see
    grown = VersionedMemory._grown
    monkeypatch.setattr(VersionedMemory, "_grown", lambda self, name, *a: 1 / 0 if name == "edges" else grown(self, name, *a))
    with pytest.raises(ZeroDivisionError):
        memory.apply(ingested(1))
    monkeypatch.undo()
    assert memory.versions() == [1] and sizes(memory.read()) == [1, 3, 1, 3, 3] and len(memory._names("data")) == 2

    # of two writers from one version one succeeds, and the other may go on from there
    late = ingested(2)(memory.read(1))
    two = memory.commit(ingested(1)(memory.read(1)), 1)
    with pytest.raises(CommitConflict):
        memory.commit(late, 1)
    with pytest.raises(CommitConflict):
        memory._publish(2, {})
    assert sizes(two) == [2, 5, 3, 5, 5] and sizes(memory.read(1)) == [1, 3, 1, 3, 3] and sizes(one) == [1, 3, 1, 3, 3]

    # plans start from files, whatever came before
    depth = lambda t: len(t.nodes._jdf.queryExecution().logical().toString())
    depths = [depth(two)]
    for n in range(2, 5):
        depths.append(depth(memory.apply(ingested(n))))
    assert max(depths) <= min(depths) + 10
    states = Counter(r.lifecycle_state for r in memory.read().nodes.where("node_type = 'fact'").collect())
    assert states == {"superseded": 4, "tentative": 1}
    before = sizes(memory.read())
    assert len(memory._manifest(memory.latest())["tables"]["events"]["folders"]) == 5
    assert sizes(memory.compact()) == before and len(memory._manifest(memory.latest())["tables"]["events"]["folders"]) == 1
    assert memory.vacuum(1) and memory.versions() == [6] and sizes(memory.read()) == before


def test_paths_between_many_ends_are_searched_for_once_a_core(spark, monkeypatch):
    asked, search = [], graph._paths_between
    monkeypatch.setattr(graph, "_paths_between", lambda links, pairs, most: asked.append((links.count(), pairs.count())) or search(links, pairs, most))
    pairs = [(f"{h}{i}", h) for h in "xy" for i in range(30)] + [(f"z{h}{i}{j}", f"{h}{i}") for h in "xy" for i in range(30) for j in range(3)] + [("x", "m"), ("m", "y"), ("x", "k"), ("k", "y")]
    ends = [(f"x{i}", f"y{j}") for i in range(20) for j in range(20)] + [("x0", "x"), ("x0", "x1"), ("x", "y"), ("zx00", "x0")]
    got = {(r.source, r.target): ">".join(r.path) for r in graph.shortest_paths(edges_of(spark, pairs), spark.createDataFrame(ends, "source string, target string")).collect()}
    assert got == {(a, b): f"{a}>x>k>y>{b}" for a, b in ends[:400]} | {("x0", "x"): "x0>x", ("x0", "x1"): "x0>x>x1", ("x", "y"): "x>k>y", ("zx00", "x0"): "zx00>x0"}
    assert asked == [(10, 3)]  # of 403 pairs: x to y, and x0, which has a leaf that is asked for, to both


def test_hops_of_many_seeds_equal_those_of_few(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 60, (90, 2))]
    seeds = spark.createDataFrame([(f"v{i}",) for i in range(60)], "seed string")
    few = sorted(map(tuple, graph.k_hop(edges_of(spark, pairs), seeds, 3).collect()))
    monkeypatch.setattr(graph, "MANY_SEEDS", 3)
    many = graph.k_hop(edges_of(spark, pairs), seeds, 3)
    assert sorted(map(tuple, many.collect())) == few
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan  # by seed
    assert not re.search(r"hashpartitioning\(seed#\d+, node_id#\d+", plan)  # and what is reached is not shuffled


def test_groups_of_a_dense_graph_take_few_rounds(spark, monkeypatch):
    rng, rounds = np.random.default_rng(2), []
    n = 240
    pairs = sorted({(f"v{min(a, b):03d}", f"v{max(a, b):03d}") for a, b in rng.integers(0, n, (1500, 2)) if a != b})
    kept = organizer.kept
    monkeypatch.setattr(organizer, "kept", lambda df: rounds.append(1) or kept(df))
    got = {(r.leader, r.node_id) for r in organizer.greedy_groups(spark.createDataFrame(pairs, "a_id string, b_id string"), 3).collect()}
    assert got == walk_in_order(pairs, 3)
    assert len(rounds) <= 30


def test_pairs_by_slices_of_blocks_are_all_pairs(spark):
    from engram.operators.search import similar_pairs

    m = np.random.default_rng(3).normal(size=(60, 6))
    v = spark.createDataFrame([(f"n{i:02d}", "u", x.tolist()) for i, x in enumerate(m)], "node_id string, user_id string, embedding array<float>")
    unit = m.astype("float32").astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {(f"n{i:02d}", f"n{j:02d}") for i in range(60) for j in range(i + 1, 60) if unit[i] @ unit[j] >= 0.5}
    rows = similar_pairs(v, 0.5, block=4, slice_blocks=3).collect()
    assert {(r.a_id, r.b_id) for r in rows} == want and len(rows) == len(want)


def test_nodes_beside_one_hub_are_given_out_once(spark, monkeypatch):
    told, kept = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df: told.append((df.columns, df.count())) or kept(df))
    pairs = [(f"x{i}", "hub") for i in range(150)] + [(f"y{i}", "hub") for i in range(40)] + [("x0", "side"), ("y0", "side")]
    seeds = spark.createDataFrame([(f"x{i}",) for i in range(150)], "seed string")
    got = [tuple(r) for r in graph.k_hop(edges_of(spark, pairs), seeds, 2).collect()]
    links = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    near = {a: {b for x, b in links if x == a} for a, _ in links}
    want = [(s, n, 1) for s in (f"x{i}" for i in range(150)) for n in near[s]]
    want += [(s, n, 2) for s in (f"x{i}" for i in range(150)) for n in {b for m in near[s] for b in near[m]} - near[s] - {s}]
    assert sorted(got) == sorted(want)
    assert (["b", "a"], 39) in told  # y1 to y39; y0 has two ways to it


@pytest.mark.parametrize("seed", range(2))
def test_paths_across_equal_those_of_the_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    edges = edges_of(spark, [(f"v{a}", f"v{b}") for a, b in rng.integers(0, 30, (34, 2)) if a != b] + [("w1", "w2")])
    some = lambda *more: [(f"v{a}", int(a) % 3) for a in rng.integers(0, 30, 25)] + [("v0", 0), *more]
    sources = spark.createDataFrame(some(("w1", 0)), "source string, m int")
    targets = spark.createDataFrame(some(("w2", 0), ("no", 1)), "target string, m int")
    rows = lambda df: sorted((r.source, r.target, tuple(r.path), r.hops) for r in df.collect())
    want = rows(graph.shortest_paths(edges, sources.join(targets, "m").select("source", "target"), 6))
    assert rows(graph.shortest_paths_across(edges, sources, targets, "m", 6)) == want
