"""Each operator against a brute-force version, on given tables and on a small awkward one."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from engram.llm import bpe, common, decontaminate, jaccard, licences, quality, sharding, textscan, token_counts, toxicity, url_filter, warc
from engram.llm.components import connected_components

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, n long, score double, label string"


def rows_of(name):
    return [tuple(r.values()) for r in pq.read_table(f"{SF}/{name}.parquet").to_pylist()]


@pytest.fixture(scope="module")
def texts():
    """Awkward texts by id, among them nulls, ties, repeats and a very long one."""
    base = "The quick brown fox jumps over the lazy dog while nine wizards box with seven quiet jars of liquid oxygen near the old harbour wall today"
    more = [None, "", "   \n\t ", "one", "two words", "É Ünï çödé 中文 \U0001f600 \x00\x7f\x85", base, base, base.replace("quiet", "loud"), base.upper(), "a " * 300, "x" * 20000, (base + " ") * 50, "don't  'll   <|endoftext|> MIT  license, the mit license\nCC BY cc by CC BY", "GNU Generl Public License v3, under the Apache Licence", "line\nline\n\nline\n other | # *"]
    return list(enumerate(more))


@pytest.fixture(scope="module")
def awkward(spark, texts):
    extra = [(i, t, None, None, None, 7, 7, 0.5, "x") for i, t in texts]
    return spark.createDataFrame([*extra, extra[6], (None, "no id", None, None, None, 1, 1, 1.0, "y")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_scan_equals_regex_with_small_pieces(monkeypatch):
    monkeypatch.setattr(textscan, "PIECE", 7)
    sample = ["Ab cd", "", "é" * 20, "word " * 5, "x" * 40 + " y", "no", "way"]
    raw = [s.encode() for s in sample]
    b = textscan.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.cumsum([0, *map(len, raw)])
    w = textscan.scan(b, offsets, textscan.ALNUM)
    got = [(int(d), b[s:e].tobytes().decode()) for d, s, e in zip(w.docs, w.starts, w.ends)]
    assert got == [(i, x) for i, s in enumerate(sample) for x in WORD.findall(s.translate(UPPER))]
    by = {}
    for (_, word), h in zip(got, w.hashes.tolist()):
        assert by.setdefault(word, h) == h
    assert len(set(by.values())) == len(by)


def test_components_on_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(50)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.vertex: r.root for r in connected_components(df, common.Scratch(spark, "t"), "c").collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert connected_components(df.limit(0), common.Scratch(spark, "t"), "c").count() == 0


# --- 1 sharding


def check_shards(rows, shards=8):
    sizes = Counter(r.shard for r in rows)
    assert not rows or max(sizes.values()) - min(sizes.get(i, 0) for i in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding_balances_and_keeps_groups(spark, sf, awkward, empty):
    docs = common.table(spark, sf, "documents")
    rows = sharding.shard_documents(docs).collect()
    check_shards(rows)
    text = {r.doc_id: r.text for r in docs.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(text[r.doc_id], set()).add(r.shard)
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "rows")
    assert all(len(s) == 1 for s in groups.values())
    got = sharding.shard_documents(awkward).collect()
    assert len(got) == awkward.count()
    check_shards(got)
    assert sharding.shard_documents(empty).collect() == []


def test_sharding_splits_a_hot_group_over_few_shards(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") / 2).cast("int"))).alias("text"))
    rows = sharding.shard_documents(df).collect()
    check_shards(rows)
    assert len({r.shard for r in rows if r.doc_id % 3 == 0}) == 3  # 134 rows, 50 to a shard
    again = sharding.shard_documents(df.repartition(7)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


# --- 2 url filter


def judged(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(UPPER)
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def test_url_filter(spark):
    urls = [u for _, u, _ in rows_of("pages")] + [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?q#f", "http://com/en/", "x://net/de/", "http://a..net/de/8#/", "http://b.example.net/de/8", "http://xcom/en/", "ftp://u@p.org/es/é", "http://a.com?/en/", "http://a.com/en/"]
    pages = spark.createDataFrame([(i, u, "h", "h2") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    want = {i: judged(u, url_filter.RULES) for i, u in enumerate(urls)}
    for most in (8 << 20, 2):  # in one pass and in several
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, most_bytes=most).collect()}
        assert got == want
    assert url_filter.judge_urls(pages.limit(0), rules).collect() == []
    none = url_filter.judge_urls(pages, rules.limit(0)).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


def test_url_filter_with_rules_of_many_shapes(spark):
    rng = np.random.default_rng(2)
    name = lambda n: ".".join(rng.choice(["a", "b", "cc"], n))
    path = lambda n: "/" + "".join(rng.choice(["x", "y", "/"], n))
    rules = {name(rng.integers(1, 4)) + path(rng.integers(0, 60)): None for _ in range(900)}
    rules = [("allow" if i % 3 else "block", *re.match("([^/]*)(.*)", k).groups()) for i, k in enumerate(rules)]
    urls = [f"http://{name(2)}.{h}{p}{path(2)}" for _, h, p in rules] + [f"http://{name(3)}{path(4)}" for _ in range(300)] + ["http://" + "a." * 40 + "cc/" + "x" * 3000]
    assert len({(h.count("."), len(p)) for _, h, p in rules}) > 100
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(0, 6000, 3).select(F.col("id").cast("string").alias("key"))
    universe = spark.range(6000).select(F.col("id").cast("string").alias("key"))
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    assert universe.where(cascade.member(F.col("key")) != (F.col("key").cast("int") % 3 == 0)).count() == 0


def test_cascade_follows_the_list_not_the_universe(spark):
    listed = spark.range(0, 100_000, 100).select(F.col("id").cast("string").alias("key"))
    size = {}
    for n in (200_000, 2_000_000):
        universe = spark.range(n).select(F.col("id").cast("string").alias("key"))
        cascade = url_filter.build_cascade(listed, universe)
        wrong = universe.where(cascade.member(F.col("key")) != ((F.col("key").cast("int") % 100 == 0) & (F.col("key").cast("int") < 100_000))).count()
        assert wrong == 0 and len(cascade.levels) > 1 and len(cascade.levels[1][0]) < len(cascade.levels[0][0])
        assert cascade.bytes <= 1.1 * 1000 * url_filter.bits_per_key(1000, n) / 8
        size[n] = cascade.bytes
    assert size[2_000_000] < 1.4 * size[200_000]  # 3.3 doublings at 1.44 bits


# --- 3 and 8 tokenizers


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.production_vocabulary()


def test_perfect_hash_is_minimal(vocabulary):
    slots = {vocabulary.hash.slot(t) for t in vocabulary.ranks}
    assert slots == set(range(len(vocabulary.ranks)))
    assert vocabulary.whole(b"\xff\xfe never a token") is None


def test_bpe_equals_library_and_round_trips(spark, vocabulary, awkward, empty):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=vocabulary.ranks, special_tokens={})
    docs = awkward.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    text = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for d, t in text:
        ids = library.encode_ordinary(t)
        want[(d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in bpe.round_trip(docs, vocabulary).collect()) == want
    assert bpe.round_trip(empty, vocabulary).collect() == []
    back = bpe.decode_ids(bpe.encode_texts(awkward, vocabulary), vocabulary).collect()
    assert Counter((r.doc_id, bytes(r.content).decode()) for r in back) == Counter((r.doc_id, r.text or "") for r in awkward.collect())


def test_token_counts_equal_library(spark, awkward, empty):
    from tokenizers import Tokenizer

    config = token_counts.production_config()
    library = Tokenizer.from_str(config)
    docs = awkward.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    want = Counter()
    for r in docs.collect():
        n = len(library.encode(r.text or "", add_special_tokens=False))
        want[(r.doc_id, len((r.text or "").encode()), n, n > 1024)] += 1
    assert Counter(tuple(r) for r in token_counts.token_counts(docs, config).collect()) == want
    assert token_counts.token_counts(empty, config).collect() == []


# --- 4 toxicity


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").where(toxicity.fold() == 0).select("score", "toxic").collect()
    p, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    assert ((p >= 0.5) == y).mean() > 0.97 and p[y == 1].mean() - p[y == 0].mean() > 0.7


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    texts, labels = [], []
    for i in range(600):
        toxic = i % 2
        group = "muslim" if (toxic and i % 5) or (not toxic and i % 5 == 0) else "friend"
        texts.append((i, f"the {group} person w{i % 7} " + ("vileword" if toxic and i % 3 else "plainword" if not toxic else "nastyish") + " here"))
        labels.append((i, toxic))
    texts, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.fit(texts, labels, fairness=f, least=2) for f in (0.0, 50.0))
    neutral = "a Muslim person w1 here"
    assert fair.score(neutral) < plain.score(neutral)
    assert fair.score("the vileword muslim person w1 here") > 0.5
    swap = lambda m: abs(m.score("a muslim w1") - m.score("a christian w1"))
    assert swap(fair) < swap(plain)


def test_counterfactuals_are_of_every_mention():
    text = ". ".join(f"some old w{i} person" for i in range(50)) + ". Nobody here."
    pairs = toxicity.counterfactuals(text, {"en": ["old", "young"]})
    assert len(pairs) == 100  # 50 sentences, for `young` and for none
    old, young = (set(toxicity.text_features(x).tolist()) for x in ("old", "young"))
    assert {(frozenset(g.tolist()), frozenset(c.tolist())) for g, c in pairs} == {(frozenset(old), frozenset(young)), (frozenset(old), frozenset())}


def test_learned_fairness_on_given_tables(spark):
    """On held-out rows the penalty lowers the change of score that swapping an identity term makes, at equal accuracy."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where(toxicity.fold() == 0).select("text", "toxic").collect()
    plain, fair = (toxicity.fit(docs, labels, fairness=f) for f in (0.0, 1.0))
    right = lambda m: np.mean([(m.score(r.text) >= 0.5) == r.toxic for r in rows])
    assert right(fair) >= right(plain) - 0.01
    change = lambda m: max(abs(m.weights.get(toxicity.feature(w), 0.0)) for terms in toxicity.IDENTITY.values() for w in terms)
    assert change(fair) <= change(plain) + 1e-9


def test_toxicity_awkward_rows(spark, awkward, empty):
    model = toxicity.Model(-1.0, {toxicity.feature("fox"): 5.0})
    got = toxicity.toxicity_scores(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(empty, model).collect() == []
    nothing = toxicity.fit(awkward, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r.score < 0.5 for r in toxicity.toxicity_scores(awkward, nothing).collect()} == {True}
    beside = toxicity.toxicity_scores_beside(awkward, model, name="mine")
    assert beside.columns == [*awkward.columns, "mine"] and beside.count() == awkward.count()
    with pytest.raises(ValueError):
        toxicity.toxicity_scores_beside(awkward, model, name="Score")


# --- 5 warc


def test_zip_reader_reads_zip64_and_python_archives(tmp_path):
    import io
    import zipfile

    for always in (False, True):
        sink = io.BytesIO()
        z = warc.ZipWriter(sink, always)
        z.add("archive/a", b"hello world")
        z.add("indexes/é", b"")
        z.close()
        data = sink.getvalue()
        assert zipfile.ZipFile(io.BytesIO(data)).read("archive/a") == b"hello world"
        r = warc.ZipReader(lambda o, n, data=data: data[o : o + n], len(data))
        assert set(r.members) == {"archive/a", "indexes/é"} and r.range("archive/a", 6, 5) == b"world"
        with pytest.raises(ValueError):
            r.range("archive/a", 6, 6)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("s", b"123")
        z.writestr("d", b"123" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"note"
    data = path.read_bytes()
    r = warc.ZipReader(lambda o, n: data[o : o + n], len(data))
    assert r.range("s", 0, 3) == b"123"
    with pytest.raises(ValueError):
        r.range("d", 0, 3)


def test_archives_give_pages_back(spark):
    big, bigger = "<p>" + "x" * 1200, "é" * 499 + "a"
    html = [(1, "u\r\n1", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", bigger), (8, "u", bigger), (9, "u", big), (9, "u", big), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in html], "page_id long, url string, html string, payload string")
    for always in (False, True):
        got = warc.archive_round_trip(pages, payloads=True, always_64=always).collect()
        assert len(got) == len(html)
        by = {}
        for r in got:
            by.setdefault(r.page_id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to))
        sha = lambda s: hashlib.sha1((s or "").encode()).hexdigest()
        assert by[1] == by[2] == by[None] == [(1203, sha(big), "revisit", 9)] and by[9] == [(1203, sha(big), "response", None)] * 2
        assert by[3] == by[4] == [(5, sha("small"), "response", None)] and by[5] == by[6] == [(0, sha(""), "response", None)]
        assert by[7] == by[8] == [(999, sha(bigger), "response", None)]
        assert {r.payload for r in got if r.page_id == 3} == {b"small"}
    assert warc.archive_round_trip(pages.limit(0)).collect() == []
    refers = [Counter((r.page_id, bytes(r.payload), r.refers_to) for r in warc.with_revisits(pages, broadcast_rows=n).collect()) for n in (0, 250_000)]
    assert refers[0] == refers[1] and sum(refers[0].values()) == len(html)


def test_archives_of_very_long_payloads(spark):
    html = [(i, f"u{i}", c * n) for i, (c, n) in enumerate([("x", 3_000_000), ("é", 400_000), ("y", 10), ("x", 3_000_000)])]
    s = common.Scratch(spark, "long")
    folder = s.path("archives") if "://" in s.path("archives") else f"file://{s.path('archives')}"
    listing = s.keep(warc.write_archives(spark.createDataFrame(html, "page_id long, url string, html string").coalesce(1), folder, member_bytes=1000, archive_bytes=5000), "listing")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.payload) for r in warc.read_archives(listing, folder, payloads=True).collect()}
    assert {i: v[:2] for i, v in got.items()} == {0: (3_000_000, "revisit"), 1: (800_000, "response"), 2: (10, "response"), 3: (3_000_000, "response")}
    assert bytes(got[1][2]).decode() == "é" * 400_000 and bytes(got[3][2]) == b"x" * 3_000_000


# --- 6 decontamination


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(UPPER))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(UPPER))
        hit, who = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    who |= own
        out.append((doc, len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("block", [16 << 20, 600])
def test_decontamination_finds_every_window(spark, awkward, block):
    base = " ".join(f"w{i}" for i in range(30))
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    docs += [(100, base), (101, "z " + " ".join(base.split()[5:15]) + " z"), (102, " ".join(base.split()[5:14])), (103, "tiny  ITEM here tiny-item"), (104, "a " * 200), (105, "W3 é w4")]
    docs += [r[:2] for r in rows_of("documents")]
    items = [r[:2] for r in rows_of("benchmark")] + [(900, base), (901, "Tiny item"), (902, None), (903, ""), (904, "a " * 25), (905, base), (10, "é"), (9, "w3 É w4".lower())]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, block_bytes=block).drop("item_ids", "spans").collect()
    assert Counter(tuple(r) for r in got) == brute_contamination(docs, items)
    assert not any(r.contaminated for r in decontaminate.contamination(d, b.limit(0)).collect())
    assert decontaminate.contamination(d.limit(0), b).collect() == []
    kept = decontaminate.clean_documents(d.withColumn("n", F.lit(1)), b, block_bytes=block)
    clean = Counter((r[0],) for r in brute_contamination(docs, items).elements() if not r[-1])
    assert kept.columns == ["doc_id", "text", "n"] and Counter((r.doc_id,) for r in kept.collect()) == clean
    assert decontaminate.clean_documents(d, b.limit(0)).count() == len(docs)


# --- 7 Jaccard join


def shingles(text, k):
    w = SOLID.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(docs, k, num, den):
    sets = [(d, shingles(t, k)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and den * len(x & y) >= num * len(x | y):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return Counter((d, len(s), find(d)) for d, s in sets)


@pytest.mark.parametrize(("k", "t", "block"), [(3, "0.9", 500_000), (5, "0.8", 500_000), (3, "0.9", 2000), (5, "0.8", 300)])
def test_jaccard_components_equal_brute_force(spark, texts, k, t, block):
    rng = np.random.default_rng(3)
    docs = [(i, x) for i, x in texts] + [(1000 + r[0], r[1]) for r in rows_of("documents")[:120]]
    base = [f"q{i}" for i in rng.integers(0, 500, 120)]
    for i in range(60):  # a large group of near copies
        w = list(base)
        for at in rng.integers(0, len(w), i % 6):
            w[at] = f"n{i}_{at}"
        docs.append((2000 + i, " ".join(w)))
    for i in range(60):  # small sets, where segments are few
        docs.append((3000 + i, " ".join(f"s{x}" for x in range(rng.integers(1, 4), rng.integers(6, 22)))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    num, den = (9, 10) if t == "0.9" else (4, 5)
    got = jaccard.jaccard_components(df, k, t, block=block, block_sets=1024 if block != 300 else 7, broadcast_rows=0 if block == 2000 else 500_000).collect()
    assert Counter(tuple(r) for r in got) == brute_components(docs, k, num, den)


def test_jaccard_awkward_rows(spark, awkward, empty):
    got = jaccard.jaccard_components(awkward).collect()
    assert len(got) == awkward.count()
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}
    assert all(r.component_id == r.doc_id for r in got if not r.n_shingles)
    assert jaccard.jaccard_components(empty).collect() == []
    kept = jaccard.one_of_each(awkward).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (0, 1, 6, 7)) == [0, 1, 6]
    assert kept and set(kept[0].__fields__) == set(awkward.columns)
    assert sum(r.doc_id == 6 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1
    assert jaccard.one_of_each(empty).collect() == []


@pytest.mark.parametrize("most", [0, 500_000])
def test_one_of_each_with_repeated_and_missing_ids(spark, texts, most):
    base = texts[6][1]
    rows = [(1, base, "a"), (2, base, "b"), (None, base, "c"), (None, "no id", "d"), (None, "no id", "e"), (None, None, "f"), (3, "own text", "g"), (3, "a text", "h"), (4, None, "i"), (5, None, "j"), (6, base.replace("quiet", "loud") + " once more", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _document string")
    got = jaccard.one_of_each(docs, broadcast_rows=most).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, base), (None, "no id"), (None, None), (3, "a text"), (4, None), (5, None), (6, rows[-1][1])])
    assert got[0].__fields__ == docs.columns


def test_jaccard_writes_no_keys_that_one_class_alone_has(spark, monkeypatch):
    kinds, keep = Counter(), common.Scratch.keep

    def kept(self, df, name, **how):
        out = keep(self, df, name, **how)
        if name == "scan":
            kinds.update({r.kind: r["count"] for r in out.groupBy("kind").count().collect()})
        return out

    monkeypatch.setattr(common.Scratch, "keep", kept)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(40)] + [(90, None), (91, "")]
    docs = spark.createDataFrame([*rows, (92, rows[3][1] + " more")], "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs, 3, "0.9").collect()}
    assert out == {i: i for i, _ in rows} | {92: 3}
    each = len(jaccard.segment_keys(np.arange(58, dtype=np.uint64), Fraction("0.9"))[0][1])  # what one set emits for a level, at most
    assert kinds[0] == 43 and 0 < kinds[1] <= 4 * each  # of 41 sets only two share keys


def test_tree_finds_links_of_every_size():
    rng = np.random.default_rng(5)
    for universe in (60, 400):
        sets = [np.unique(rng.integers(0, universe, rng.integers(1, universe))).astype(np.int32) for _ in range(60)]
        for _ in range(20):  # near copies, and an equal one
            sets.append(np.unique(np.where(rng.random(len(sets[0])) < 0.05, rng.integers(0, universe, len(sets[0])), sets[0])).astype(np.int32))
        sets.append(sets[0].copy())
        bags = [frozenset(s.tolist()) for s in sets]
        tree = jaccard.PrefixTree(sets)
        for t in map(Fraction, ("0.7", "0.8", "0.9", "1")):
            for x, bag in zip(sets, bags, strict=True):
                want = {j for j, c in enumerate(bags) if len(bag & c) >= t * len(bag | c)}
                assert sorted(tree.probe(x, t).tolist()) == sorted(want)
                assert sorted(tree.probe(x, t, len(x)).tolist()) == sorted(j for j in want if len(sets[j]) <= len(x))


@pytest.mark.parametrize("t", ["0.8", "0.9"])
def test_linked_sets_always_meet(t):
    """Two sets alone in a table: if they are linked, they share as many keys of a level as both ask for."""
    t, rng, linked = Fraction(t), np.random.default_rng(11), 0
    for trial in range(10_000):
        m = int(rng.integers(3, 26)) if trial % 4 else int(rng.integers(26, 200))
        x = np.unique(rng.integers(0, 1 << 63, m).astype(np.uint64) * np.uint64(2))
        changes = int(rng.integers(0, int(m * float(1 - t) * 1.2) + 1))
        gone = int(rng.integers(0, changes + 1))
        y = np.delete(x, rng.choice(len(x), min(gone, len(x) - 1), replace=False))
        y = np.unique(np.concatenate([y, rng.integers(0, 1 << 63, changes - gone).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if shared < t * (len(x) + len(y) - shared):
            continue
        linked += 1
        of_x, of_y = ({lv: (set(keys.tolist()), need) for lv, keys, need in jaccard.segment_keys(v, t)} for v in (x, y))
        assert any(len(of_x[lv][0] & of_y[lv][0]) >= max(of_x[lv][1], of_y[lv][1]) for lv in of_x.keys() & of_y.keys())
    assert linked > 6000


def test_rows_without_id_link_others(spark):
    w = [f"w{i}" for i in range(40)]
    end = lambda n: " ".join(w[:-n] + [f"x{i}" for i in range(n)])
    docs = [(1, " ".join(w)), (None, end(2)), (2, end(4)), (None, "alone without a number"), (None, "alone without a number"), (None, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    without = jaccard.jaccard_components(rows.where("doc_id is not null"), 1, "0.85").collect()
    assert {(r.doc_id, r.component_id) for r in without} == {(1, 1), (2, 2)}
    got = jaccard.jaccard_components(rows, 1, "0.85").collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter([(1, 40, 1), (None, 40, 1), (2, 40, 1), (None, 4, None), (None, 4, None), (None, 0, None)])
    with pytest.raises(ValueError):
        jaccard.jaccard_components(rows, 1, "0.5")
    other = [f"z{i}" for i in range(40)]
    twice = [(1, " ".join(w)), (1, " ".join(other)), (2, end(2)), (3, " ".join(other[:-1]))]  # one id, two texts
    got = jaccard.jaccard_components(spark.createDataFrame(twice, "doc_id long, text string"), 1, "0.85").collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(1, 1), (1, 1), (2, 1), (3, 1)])


# --- 9 licences


def test_licences(spark, awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()] + [r[:2] for r in rows_of("documents")]
    want = Counter()
    for d, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        places = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        want[(d, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = licences.licence_scan(df).collect()
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licences.licence_scan(empty).collect() == []


def spoilt(text, edits):
    out = list(text)
    for i in range(edits):
        out[(i * len(text)) // edits + 1] = "q"
    return "".join(out)


def test_fuzzy_notices_within_their_edits():
    scan = licences.Scanner()
    for text, label, edits in licences.NOTICES:
        found = scan.fuzzy(b" some words " + spoilt(text, edits).encode() + b" and more ")
        assert any(f[0] == label and f[3] <= edits for f in found), text
    assert not scan.fuzzy(b" quite other words about cats and their habits ")
    row = scan.rows([b"Used under the Apache Licence 2.0 and the MITlicense"])
    assert row["labels"] == ["apache"] and row["base_labels"] == [""] and 0.9 < row["score"][0] < 1


def test_every_notice_of_a_crowd_is_found():
    scan = licences.Scanner()
    spans = lambda text, label: [(f[1], f[2], f[3]) for f in scan.fuzzy(text) if f[0] == label]
    assert [s[2] for s in spans(b" mozilla pubic license mozilla public license ", "mpl")] == [1, 0]
    assert [s[2] for s in spans(b" relaesed under the mit license released undr the mit license ", "mit")] == [2, 1]
    for text, label, edits in licences.NOTICES:
        for many in ([edits] * 3, [0, edits, 0], [edits, 0, 0], [edits, edits, 0, edits]):
            crowd = " ".join(spoilt(text, e) for e in many)
            got = sorted(scan._verify(licences.Notice.of(text, label, edits), f" {crowd} ".encode(), 0, len(crowd) + 2))
            assert len(got) == len(many) and all(a[1] <= b[0] for a, b in zip(got, got[1:])), (text, many, got)
            assert set(got) <= {(f[1], f[2], f[3]) for f in scan.fuzzy(f" {crowd} ".encode())}


def test_fuzzy_labels_equal_brute_force():
    """Every text against every notice, without seeds or zones."""
    import regex

    rng = np.random.default_rng(4)
    texts = [t for _, t in [r[:2] for r in rows_of("documents")] if t]
    for text, _, edits in licences.NOTICES:
        for k in range(edits + 3):
            w = list(text)
            for _ in range(k):
                at, how = int(rng.integers(0, len(w))), rng.integers(0, 3)
                w[at : at + 1] = {0: [], 1: ["x"], 2: [w[at], "z"]}[int(how)]
            texts.append("Words before " + "".join(w) + " words after.")
    scan = licences.Scanner()
    got = scan.rows(t.encode() for t in texts)["labels"]
    for text, labels in zip(texts, got, strict=True):
        plain = " " + " ".join(WORD.findall(text.translate(UPPER))) + " "
        want = {label for p, label in licences.PHRASES.items() if f" {p} " in plain}
        want |= {label for p, label, e in licences.NOTICES if regex.search(b"(?:%s){e<=%d}" % (regex.escape(p.encode(), literal_spaces=True), e), plain.encode())}
        assert set(filter(None, labels.split(","))) == want


# --- 10 quality


def brute_counts(text):
    text = text or ""
    w = SOLID.findall(text)
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SOLID.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_counts_and_verdicts(spark, awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()] + [r[:2] for r in rows_of("documents")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rule = quality.Rule((quality.Condition("symbol_ratio", True, 0.05), quality.Condition("upper_ratio", False, 0.9)))
    got = quality.quality_verdicts(df, [rule]).collect()
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter((r.doc_id, *(r[c] for c in columns)) for r in got) == Counter((d, *brute_counts(t)) for d, t in docs)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and not (r.symbol_ratio >= 0.05 and r.upper_ratio <= 0.9))
    assert quality.quality_verdicts(empty, [rule]).collect() == []
    beside = quality.quality_verdicts_beside(awkward.withColumn("n_words", F.lit(-1)).withColumn("kept", F.lit("mine")), [rule])
    assert beside.columns == [*awkward.columns, "n_words", "kept", "quality_verdict"]
    alone = {r.doc_id: (r.n_words, r.kept) for r in quality.quality_verdicts(awkward, [rule]).collect()}
    for r in beside.collect():
        assert (r.n_words, r.kept) == (-1, "mine") and (r.quality_verdict.n_words, r.quality_verdict.kept) == alone[r.doc_id]
    with pytest.raises(ValueError):
        quality.quality_verdicts_beside(beside, [])
    assert quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")) == []


def test_rules_are_ordered_and_precise():
    rng = np.random.default_rng(1)
    x = {"symbol_ratio": rng.random(3000), "upper_ratio": rng.random(3000)}
    y = (x["symbol_ratio"] > 0.8) & (x["upper_ratio"] > 0.5) | (x["upper_ratio"] > 0.95)
    rules = quality.learn_rules(x, y)
    caught = np.zeros(3000, bool)
    for r in rules:
        caught |= r.mask(x)
    assert rules and (caught & y).sum() > 0.9 * y.sum() and (caught & ~y).sum() < 0.02 * (~y).sum()
    assert quality.learn_rules(x, rng.random(3000) < 0.3) == []  # noise teaches nothing precise


def test_learned_rules_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality_verdicts(docs, quality.fit(docs, labels)).join(labels, "doc_id").select("kept", "quality").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) > 0.95 * len(good) and sum(not r.kept for r in bad) > 0.9 * len(bad)


# --- pipeline


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    model = toxicity.fit(docs, common.table(spark, sf, "labels"))
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, model).where("score >= 0.5").collect()}
    before = {r.doc_id for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        now = {r.doc_id for r in docs.collect()}
        assert now <= before and now
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if i == 2:
            kept = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(d == c for d, _, c in brute_components(kept, 5, 4, 5))
        if i == 3:
            assert not any(x[-1] for x in brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [r[:2] for r in rows_of("benchmark")]))
        if i == 4:
            assert before == now
        before = now


def test_pipeline_stages_on_awkward_rows(spark, sf, awkward, empty):
    """Nulls in any column, clashing names, repeated rows and no rows at all; every column comes through as it was."""
    import corpus_pipeline

    clash = "n_words long, kept string, base_failed string, score double, toxicity_score string, quality_verdict string, _document string, root long, label string, `a b` int"
    more = [F.lit(None if i % 2 else "7").cast(f.split()[-1]).alias(f.rsplit(" ", 1)[0].strip("`")) for i, f in enumerate(clash.split(", "))]
    wide = common.table(spark, sf, "documents").limit(60).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars"))
    wide = wide.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, None)], wide.schema)).select("*", *more)
    wide = spark.createDataFrame(wide.collect(), wide.schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, wide.limit(0), sf)
        assert none.collect() == [], name
        out = stage(spark, wide, sf)
        rows = out.collect()
        if name == "byte-level BPE":
            assert len(rows) == wide.count()
            continue
        assert out.columns == wide.columns and out.dtypes == wide.dtypes, name
        before = Counter(tuple(r) for r in wide.collect())
        assert rows and not Counter(tuple(r) for r in rows) - before, name


def test_scratch_needs_a_shared_folder_on_a_cluster():
    assert common.free_name(["a", "X", "x_"], "x") == "x__"

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Cluster.conf)  # noqa: N815

    with pytest.raises(ValueError):
        common.shared_root(Cluster)


def test_common_passages_chain_no_group(spark):
    """Any two of twelve classes share one key, each of which is thereby shared, but a link would take ten; two others are linked."""
    s = common.Scratch(spark, "test")
    pairs = [(i, j) for i in range(12) for j in range(i + 1, 12)]
    rows = [(100 * i + j, b, 0, 10) for i, j in pairs for b in (i, j)] + [(5000 + a, b, 0, 8) for a in range(10) for b in (50, 51)]
    edges = jaccard._coarse_edges(spark.createDataFrame(rows, "a long, b long, lv long, need long"), s)
    roots = {r.vertex: r.root for r in connected_components(edges, s, "groups").collect()}
    assert roots[50] == roots[51] == 50
    assert max(Counter(roots.values()).values()) <= 3


def test_shuffle_files_go_with_their_step(spark):
    s = common.Scratch(spark, "test")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with common.shuffles_removed(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key) == "false"
    kept = s.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6
