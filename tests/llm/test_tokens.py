"""Pieces, sequence files, source divergence and fill-in-middle against the libraries and brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import bpe, common, divergence, infill, pieces, sequences, token_counts

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, h1 string, n long, form string, start long"
ALPHABET = [*"aZb01.,'\" \n\t\r-(<|>sdltrve", "é", "à", " ", "　", " ", "\u0085", " ", "中", "\x1c", "\x00", "<|endoftext|>", "'s", "'ll", "࢏", "😀", "²", "\U000323b0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(token_counts.production_config())


@pytest.fixture(scope="module")
def awkward(spark):
    texts = [None, "", "  \n\t ", "one", "a\nb\n\nc", "\n", "two words\nhere", "É中 \U0001f600\nß <P> tag", "don't\n<|endoftext|>  x", "word " * 3000, "x" * 9000, "l\n" * 5000, "two words\nhere"]
    rows = [(i, t, None if i % 3 else "en", "s" if i % 2 else None, "mine", 1, "mine", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], (None, "no id\nat all", None, None, "mine", 1, "mine", 2), (None, "no id", "de", "s", "mine", 1, "mine", 2)], DOCS)


def test_letters_and_numbers_are_the_libraries():
    """Every code point by what the library's split joins it to."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    find = regex.compile(pieces.bounded(pieces.BYTE_LEVEL)).findall
    at = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(at), 4096):
        text = "".join(f"a{c}0{c}-{c}\n" for c in at[i : i + 4096])
        got, ends = [len(x) for x in find(text)], [b - a for _, (a, b) in split.pre_tokenize_str(text)]
        assert got == ends


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), max_size=8), st.integers(1, 40))
def test_pieces_encode_as_whole_texts(texts, limit):
    config = token_counts.production_config()
    encode, apart, specials = pieces.library_encoder(config) if not hasattr(test_pieces_encode_as_whole_texts, "kept") else test_pieces_encode_as_whole_texts.kept
    test_pieces_encode_as_whole_texts.kept = encode, apart, specials
    assert apart
    encoder = pieces.PieceEncoder(encode, specials)
    got = []
    for i, j, ids, at in encoder.texts(pa.array([*texts, None], pa.string()), limit):
        got += [ids[at[k] : at[k + 1]].tolist() for k in range(j - i)]
    assert got == [encode([t.encode()])[0] for t in [*texts, ""]]


def test_piece_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEY_BYTES", 40)
    encoder = pieces.PieceEncoder(lambda xs: [[len(x), x[0]] for x in xs])
    for _ in range(3):
        column = pa.array([f" w{i} x{i}" for i in range(50)])
        got = [ids.tolist() for _, _, ids, _ in encoder.texts(column, 1)]
        assert got == [[2, 32, len(str(i)), ord(str(i)[0]), 2, 32, len(str(i)), ord(str(i)[0])] for i in range(50)]
        assert encoder.key_bytes <= 40


def test_encoder_memory_is_bounded_as_objects_take_it():
    import tracemalloc

    letters = str.maketrans("0123456789", "abcdefghij")
    held = bpe.Encoder(bpe.Vocabulary({bytes([i]): i for i in range(256)}, pieces.BYTE_LEVEL)).pieces
    held.encode = lambda xs: [[1]] * len(xs)
    tracemalloc.start()
    for n in range(0, 800_000, 20_000):
        for _ in held.texts(pa.array([" ".join(f"{i:06d}".translate(letters) for i in range(n, n + 20_000))])):
            pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 90 << 20


def test_worker_holds_one_state():
    a = common.worker_state("a", lambda: [1])
    assert common.worker_state("a", lambda: [2]) is a
    common.worker_state("b", list)
    assert common.worker_state("a", lambda: [3]) == [3]


def test_bpe_and_counts_on_strange_texts(library):
    import tiktoken

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(ALPHABET, rng.integers(0, 25))) for _ in range(3000)]
    v = bpe.production_vocabulary()
    own = tiktoken.Encoding("own", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
    encoder = bpe.Encoder(v)
    for text, ids in zip(texts, encoder.texts(pa.array(texts)), strict=True):
        assert ids.tolist() == own.encode_ordinary(text) and encoder.decode(ids, 3) == text.encode()
    config = token_counts.production_config()
    table = token_counts.length_table(config)
    assert 20_000 < len(table) < 50_257 and table[b" the"] == 1
    for entries in (600_000, 10):
        counter = token_counts.Counter(config, pa.array(table, pa.large_binary()), np.frombuffer(bytes(table.values()), np.uint8), entries)
        assert counter.counts(pa.array([*texts, None])).tolist() == [len(library.encode(t, add_special_tokens=False)) for t in [*texts, ""]]


def test_counts_of_a_tokenizer_that_needs_whole_texts(spark, awkward):
    from tokenizers import Tokenizer

    config = token_counts.production_config("word_bpe_49k.json")
    other = Tokenizer.from_str(config)
    got = token_counts.token_counts(awkward, config).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r.doc_id, len(other.encode(r.text or "", add_special_tokens=False))) for r in awkward.collect())


# --- 11 sequences


def in_order(df):
    rows = df.withColumn("tie", F.xxhash64("text")).collect()
    return sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie, r.text or ""))


@pytest.mark.parametrize(("length", "per_batch", "shards"), [(2048, 64, None), (4, 3, 3), (1, 1, 2)])
def test_sequences_give_all_documents_back(spark, awkward, library, length, per_batch, shards):
    docs = awkward.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    want, at = [], 0
    for r in in_order(docs):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = sequences.sequence_round_trip(docs, token_counts.production_config(), 2, ids=True, length=length, per_batch=per_batch, shards=shards).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_sequences_of_nothing(spark, awkward):
    assert sequences.sequence_round_trip(awkward.limit(0), token_counts.production_config(), 2).collect() == []


@pytest.mark.parametrize("vocabulary", [300, 70_000])
def test_random_access_without_a_copy(tmp_path, vocabulary):
    rng = np.random.default_rng(3)
    fs = pafs.LocalFileSystem()
    writer = sequences.ShardWriter(fs, f"{tmp_path}/x", 5, 4, vocabulary, 9)
    docs = [rng.integers(10, vocabulary, rng.integers(0, 60)) for _ in range(23)]
    for i, ids in enumerate(docs):
        writer.add(i, ids)
    n = writer.close()
    flat = np.concatenate([np.append(ids, 9) for ids in docs])
    assert n == -(-len(flat) // 5)
    with sequences.file_system(f"file://{tmp_path}")[0].open_input_file(f"{tmp_path}/x.ids.arrows") as f:
        s = sequences.Sequences(f)
        assert len(s) == n
        for i in rng.permutation(n).tolist():
            ids, mask = s[i]
            part = flat[i * 5 : i * 5 + 5]
            assert ids[: len(part)].tolist() == part.tolist() and mask.to_pylist() == [True] * len(part) + [False] * (5 - len(part))
            assert not ids.flags.owndata and not ids.flags.writeable
        assert np.concatenate(list(s.run(7, 40))).tolist() == flat[7:47].tolist()
        with pytest.raises(IndexError):
            s[n]
        with pytest.raises(ValueError):
            list(s.run(len(flat) - 2, 3))
    # any reader of Arrow's stream format reads it too
    with pa.OSFile(f"{tmp_path}/x.ids.arrows") as f:
        table = pa.ipc.open_stream(f).read_all()
    assert table.column("ids").combine_chunks().flatten().to_numpy()[: len(flat)].tolist() == flat.tolist()


# --- 12 divergence


def brute_divergence(rows, least, top=10):
    docs = [(r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r.text or "").translate(LOW))) for r in rows]
    seen, total, own = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = {(x, y) for x, y, _ in docs}
    for lang, source, words in docs:
        seen[lang].update(set(words))
        total[lang].update(words)
        own[lang, source].update(words)
    out = set()
    for lang in {x for x, _ in groups}:
        kept = sorted((w for w, c in seen[lang].items() if c >= least), key=str.encode)
        p = lambda counts, n: {w: 1 + 10**9 * (counts[w] + 2) // (n + 2 * len(kept)) for w in kept}
        share = {s: p(own[lang, s], sum(own[lang, s][w] for w in kept)) for x, s in groups if x == lang}
        whole = p(total[lang], sum(total[lang][w] for w in kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, mine in share.items():
            pairs = [(t, sum(f(mine[w], q[w]) for w in kept)) for t, q in share.items() if t != s]
            terms = [(w, f(mine[w], whole[w])) for w in kept if own[lang, s][w] and mine[w] > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("least", [1, 3, 10])
def test_divergence_equals_brute_force(spark, awkward, least):
    docs = awkward.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    got = [tuple(r) for r in divergence.divergence(docs, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(docs.collect(), least)


def test_divergence_without_terms(spark, awkward):
    assert divergence.divergence(awkward.limit(0)).collect() == []
    got = divergence.divergence(awkward, 1000).collect()
    assert got and all(r.part == "pair" and r.value == 0 for r in got)


def test_shares_are_exact_for_great_counts(spark):
    rows = [(c, n, v) for c in (0, 1, 7, 10**12, 10**14 + 3) for n in (10**14 + 7, 3 * 10**14 + 1) for v in (1, 10**6)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.n + 2 * r.v) for r in got)


# --- 13 fill-in-middle


def units_of(text, unit):
    return re.findall({"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "char": r"(?s)."}[unit], text)


def brute_infill(doc_id, text, unit, rate, spm, seed):
    text = text or ""
    u = units_of(text, unit)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, z = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:z]), "".join(u[z:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, len(u), "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm", "seed"), [("line", 100, 50, "7"), ("word", 60, 20, "x"), ("char", 100, 0, "7")])
def test_infill_equals_brute_force(spark, awkward, unit, rate, spm, seed):
    docs = awkward.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    made = infill.fill_in_middle(docs, unit, seed, rate, spm)
    got = made.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter(brute_infill(r.doc_id, r.text, unit, rate, spm, seed) for r in rows)
    assert Counter((r.doc_id, r.back) for r in got) == Counter((r.doc_id, r.text or "") for r in rows)
    assert infill.fill_in_middle(awkward.limit(0), unit).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n中é😀", max_size=40), min_size=1, max_size=6), st.integers(1, 9), st.sampled_from(infill.UNITS))
def test_every_rank_is_found_by_chunks(texts, chunk, unit):
    raw = [t.encode() for t in texts]
    ranks = infill.Ranks(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), unit, chunk)
    for row, text in enumerate(texts):
        u = units_of(text, unit)
        assert ranks.units[row] == len(u)
        for k in range(len(u) + 1):
            place, points = ranks.cut(row, k)
            assert place - ranks.offsets[row] == len("".join(u[:k]).encode()) and points == len("".join(u[:k]))


def test_no_query_needs_ids(spark, awkward):
    """Scratch tables hold what the plans read; a second run gives the same."""
    first = divergence.divergence(awkward, 2).collect()
    assert sorted(map(str, first)) == sorted(map(str, divergence.divergence(awkward.repartition(5), 2).collect()))
    assert common.shared_root(spark)
