"""An approximate vector index: inverted lists under a coarse quantiser, product codes, exact re-ranking.

Files under one folder, plain Parquet:

- `lists`: a row per vector (node_id, what it is filtered by, its product code, the vector), partitioned by list; within a
  list, rows lie in slices of about `slice_rows`, so a list that holds a third of all vectors is many groups of work.
- `slices` (list, version, slice, n), `centroids` (list, centroid), `codebooks` (sub, code, word), `settings`, and `gone`
  (node_id, version): tombstones, which end what was written up to their version.

The quantisers are fitted on a sample of at most `sample` vectors (a parameter, taken by a hash of the id), by passes of Lloyd's
algorithm in Spark; every vector is indexed. How many lists a search probes by default is measured while the index is built: the
least number that holds `target` of the true neighbours of a few of its own vectors. A search reads the probed lists' codes
(other folders are pruned), filters before any cut, keeps the best by code of each bundle of slices, and computes exact cosines of the best of all.
Adding writes new slices, removing writes tombstones; neither touches what is there. `compact` writes a clean copy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.functions import expr as X
from engram.functions.frames import kept, rows_of
from engram.operators.search import vector_topk_batch

SLICE_ROWS = 8192
BUNDLE_ROWS = 8192  # codes that meet queries in one task, about
PART_QUERIES = 1024  # queries that a bundle meets at once, at most
FOUND_ROWS = 1 << 20  # candidates that a task gives at once, about
_STEP = 4096  # vectors that a task compares with all centroids at once


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float32)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def nearest(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row; the first among equals."""
    half = 0.5 * (centroids**2).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64), *(np.argmax(m[i : i + _STEP] @ centroids.T - half, axis=1) for i in range(0, len(m), _STEP))])


def lloyd(m: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """k centroids of the rows of one bounded matrix; starts from rows spread over it, an empty one stays where it is."""
    c = m[np.linspace(0, len(m) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(m, c)
        n = np.bincount(own, minlength=k)
        for j in range(m.shape[1]):
            s = np.bincount(own, weights=m[:, j], minlength=k)
            c[n > 0, j] = (s[n > 0] / n[n > 0]).astype(np.float32)
    return c


@dataclass(frozen=True)
class Settings:
    dim: int
    lists: int
    subs: int
    codes: int
    probes: int


class VectorIndex:
    """An index that lies in `root`; holds the quantisers (bounded by `lists` and `codes`), nothing that grows with the vectors."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.settings = Settings(**spark.read.parquet(f"{root}/settings").first().asDict())
        self.centroids = np.array([r.centroid for r in spark.read.parquet(f"{root}/centroids").orderBy("list").collect()], np.float32)
        rows = spark.read.parquet(f"{root}/codebooks").orderBy("sub", "code").collect()
        self.words = np.array([r.word for r in rows], np.float32).reshape(self.settings.subs, self.settings.codes, -1)

    def lists(self) -> DataFrame:
        """Every row that is not gone."""
        rows = self.spark.read.parquet(f"{self.root}/lists")
        gone = self.gone().groupBy("node_id").agg(F.max("version").alias("until"))
        return rows.join(gone, (rows.node_id == gone.node_id) & (rows.version <= gone.until), "left_anti")

    def gone(self) -> DataFrame:
        return self.spark.read.schema("node_id string, version int").parquet(f"{self.root}/gone")

    def version(self) -> int:
        tables = (self.spark.read.parquet(f"{self.root}/slices"), self.gone())
        return max(t.agg(F.max("version")).first()[0] or 0 for t in tables)

    # --- writing

    def encode(self, vectors: DataFrame) -> DataFrame:
        """vectors (node_id, embedding, ...) with `list` and `code`; both are of the unit vector."""
        shared = self.spark.sparkContext.broadcast((self.centroids, self.words))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)

        def run(frames):
            centroids, words = shared.value
            width = words.shape[2]
            for pdf in frames:
                if pdf.empty:
                    continue
                m = _unit(_matrix(pdf["embedding"]))
                own = nearest(m, centroids)
                rest = m - centroids[own]
                code = np.stack([nearest(rest[:, s * width : (s + 1) * width], words[s]) for s in range(len(words))], axis=1).astype(np.uint8)
                yield pdf.assign(list=own.astype(np.int32), code=[c.tobytes() for c in code])

        return vectors.mapInPandas(run, f"{schema}, list int, code binary")

    def add(self, vectors: DataFrame, slice_rows: int = SLICE_ROWS) -> None:
        """Indexes more vectors: new slices, of a version of their own. An id that is there already should be removed first."""
        self._write(vectors, self.version() + 1, slice_rows, "append")

    def remove(self, ids: DataFrame) -> None:
        """ids: (node_id). Whatever is indexed under them so far is gone."""
        ids.select("node_id", F.lit(self.version()).alias("version")).distinct().write.mode("append").parquet(f"{self.root}/gone")

    def _write(self, vectors: DataFrame, version: int, slice_rows: int, mode: str) -> None:
        coded = kept(self.encode(vectors))
        sizes = coded.groupBy("list").agg(F.ceil(F.count("*") / F.lit(slice_rows)).cast("int").alias("g"))  # at most a row a list
        dealt = coded.join(F.broadcast(sizes), "list").withColumn("slice", F.pmod(F.xxhash64("node_id"), F.col("g")).cast("int")).drop("g").withColumn("version", F.lit(version))
        dealt.repartition("list", "slice").sortWithinPartitions("list", "slice").write.mode(mode).partitionBy("list").parquet(f"{self.root}/lists")
        dealt.groupBy("list", "version", "slice").agg(F.count("*").alias("n")).write.mode(mode).parquet(f"{self.root}/slices")

    def compact(self, root: str, slice_rows: int = SLICE_ROWS) -> VectorIndex:
        """A copy without what is gone, in slices of full size; quantisers stay."""
        for name in ("centroids", "codebooks", "settings"):
            self.spark.read.parquet(f"{self.root}/{name}").write.parquet(f"{root}/{name}")
        self.spark.createDataFrame([], "node_id string, version int").write.parquet(f"{root}/gone")
        out = VectorIndex(self.spark, root)
        out._write(self.lists().drop("list", "code", "slice", "version"), 1, slice_rows, "error")
        return out

    # --- searching

    def probes_of(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, user_id, q, list): the nearest lists of every query; q is its vector."""
        shared = self.spark.sparkContext.broadcast(self.centroids)

        def run(frames):
            c = shared.value
            half = 0.5 * (c**2).sum(axis=1)
            for pdf in frames:
                for i in range(0, len(pdf), 1024):
                    part = pdf.iloc[i : i + 1024]
                    m = _unit(_matrix(part["embedding"]))
                    near = np.argsort(-(m @ c.T - half), axis=1, kind="stable")[:, :probes]
                    n = near.shape[1]
                    yield pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), n), "user_id": np.repeat(part["user_id"].to_numpy(), n), "q": [x for x in part["embedding"] for _ in range(n)], "list": near.ravel().astype(np.int32)})

        user = F.col("user_id") if "user_id" in queries.columns else F.lit(None).cast("string").alias("user_id")
        return queries.select("query_id", user, "embedding").mapInPandas(run, "query_id string, user_id string, q array<float>, list int")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int = 20, where: str | None = None) -> DataFrame:
        """queries: (query_id, embedding) and maybe user_id -> (query_id, node_id, score, rn), the k best by cosine.

        A query of a user meets that user's vectors; `where` filters by any stored column. Both come before any cut. The
        `refine` * k best by code are compared exactly. Slices meet queries in bundles, some queries at once, so a task's
        memory follows neither the queries nor the lists, and a query is sent to a bundle once, not to each slice of it.
        """
        probes = min(probes or self.settings.probes, self.settings.lists)
        asked, most = kept(self.probes_of(queries, probes)), refine * k
        wanted = asked.select("list").distinct()  # at most a row a list
        rows = self.lists()
        rows = rows.where(where) if where else rows
        owner = F.col("user_id") if "user_id" in rows.columns else F.lit(None).cast("string").alias("user_id")
        codes = rows.join(F.broadcast(wanted), "list", "left_semi").select("list", "version", "slice", "node_id", owner, "code")
        slices = self.spark.read.parquet(f"{self.root}/slices")
        bundles = max(1, -(-(slices.agg(F.sum("n")).first()[0] or 0) // BUNDLE_ROWS))
        parts = max(1, -(-asked.select("query_id").distinct().count() // max(1, min(PART_QUERIES, FOUND_ROWS // min(most, BUNDLE_ROWS)))))
        bundle = F.pmod(F.xxhash64("list", "version", "slice"), F.lit(bundles)).cast("int").alias("bundle")
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part")
        held = slices.select("list", bundle).distinct()
        todo = asked.join(held, "list").groupBy("query_id", "user_id", "bundle").agg(F.first("q").alias("q"), F.collect_list("list").alias("lists")).select("*", part)
        codes = codes.select("*", bundle, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        shared = self.spark.sparkContext.broadcast((self.centroids, self.words))

        def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if q.empty or v.empty:
                return rows_of([], kind)
            centroids, words = shared.value
            at, owners = v["list"].to_numpy(), v["user_id"].to_numpy()
            code = np.frombuffer(b"".join(v["code"]), np.uint8).reshape(len(v), -1)
            like = np.concatenate([words[s][code[:, s]] for s in range(len(words))], axis=1) + centroids[at]
            like = _unit(like).T
            taken, nears = [], []
            for i in range(0, len(q), 256):  # so many queries at once
                some = q.iloc[i : i + 256]
                sims = _unit(_matrix(some["q"])) @ like
                for row, (user, lists) in enumerate(zip(some["user_id"], some["lists"], strict=True)):
                    probed = np.zeros(len(centroids), bool)
                    probed[lists] = True
                    ok = np.flatnonzero(probed[at] & (owners == user) if user is not None else probed[at])
                    s = sims[row][ok]
                    taken.append(ok[np.argpartition(-s, most)[:most]] if len(s) > most else ok)
                    nears.append(sims[row][taken[-1]])
            best = np.concatenate(taken)
            asker = np.repeat(q["query_id"].to_numpy(), list(map(len, taken)))
            return pd.DataFrame({"query_id": asker, **{c: v[c].to_numpy()[best] for c in ("node_id", *keys)}, "near": np.concatenate(nears).astype(float)})

        keys, kind = ["list", "version", "slice"], "query_id string, node_id string, list int, version int, slice int, near double"
        found = todo.groupBy("bundle", "part").cogroup(codes.groupBy("bundle", "part")).applyInPandas(meet, kind)
        rn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "node_id"))
        close = found.withColumn("rn", rn).where(F.col("rn") <= most).select("query_id", "node_id", *keys)
        exact = rows.join(F.broadcast(wanted), "list", "left_semi").select("node_id", *keys, "embedding")
        both = close.join(exact, ["node_id", *keys]).join(asked.select("query_id", "q").dropDuplicates(["query_id"]), "query_id")
        scored = both.select("query_id", "node_id", X.cosine(F.col("embedding"), F.col("q")).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
        return scored.withColumn("rn", rank).where(F.col("rn") <= k)


def _train(sample: DataFrame, lists: int, rounds: int) -> np.ndarray:
    """Coarse centroids: each round assigns the sample in parallel, sums per centroid in Spark, and takes the means."""
    spark = sample.sparkSession
    c = _unit(np.array([r.embedding for r in sample.orderBy(F.xxhash64("node_id"), "node_id").limit(lists).collect()], np.float32))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(c)

        def assign(frames, shared=shared):
            sums, n = np.zeros(shared.value.shape), np.zeros(len(shared.value), np.int64)
            for pdf in frames:
                if len(pdf):
                    m = _unit(_matrix(pdf["embedding"]))
                    own = nearest(m, shared.value)
                    np.add.at(sums, own, m)
                    n += np.bincount(own, minlength=len(n))
            some = np.flatnonzero(n)
            yield pd.DataFrame({"list": some.astype(np.int32), "n": n[some], "s": list(sums[some])})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each task of the pass
            return pd.DataFrame({"list": [pdf["list"].iloc[0]], "n": [pdf["n"].sum()], "s": [np.sum(np.vstack(pdf["s"].to_numpy()), axis=0)]})

        kind = "list int, n long, s array<double>"
        for r in sample.mapInPandas(assign, kind).groupBy("list").applyInPandas(add, kind).collect():
            c[r.list] = np.array(r.s) / r.n
    return c


def build(vectors: DataFrame, root: str, lists: int | None = None, subs: int | None = None, codes: int = 256, sample: int = 65_536, rounds: int = 8, target: float = 0.95, slice_rows: int = SLICE_ROWS) -> VectorIndex:
    """Fits the quantisers on a sample, indexes all vectors (node_id, embedding and columns to filter by), and measures the
    number of lists to probe. Vectors must have one length; `lists` is the root of their number, 4096 at most."""
    spark = vectors.sparkSession
    n, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("an index needs vectors to be fitted on")
    few = kept(vectors.select("node_id", "embedding").orderBy(F.xxhash64("node_id"), "node_id").limit(sample))
    lists = max(1, min(lists or math.isqrt(n), 4096, n))
    subs = subs or next(s for s in (dim // 4, dim // 3, dim // 2, dim, 1) if s and dim % s == 0)
    centroids = _train(few, lists, rounds)
    shared, width, codes = spark.sparkContext.broadcast(centroids), dim // subs, min(codes, 256, n)

    def split(frames):
        for pdf in frames:
            if len(pdf):
                m = _unit(_matrix(pdf["embedding"]))
                rest = m - shared.value[nearest(m, shared.value)]
                for s in range(subs):
                    yield pd.DataFrame({"sub": s, "node_id": pdf["node_id"], "part": list(rest[:, s * width : (s + 1) * width])})

    def words(pdf: pd.DataFrame) -> pd.DataFrame:  # the bounded sample, one part of each vector
        c = lloyd(_matrix(pdf.sort_values("node_id")["part"]), codes, rounds)
        return pd.DataFrame({"sub": pdf["sub"].iloc[0], "code": np.arange(codes, dtype=np.int32), "word": list(c)})

    few.mapInPandas(split, "sub int, node_id string, part array<float>").groupBy("sub").applyInPandas(words, "sub int, code int, word array<float>").write.parquet(f"{root}/codebooks")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<float>").write.parquet(f"{root}/centroids")
    spark.createDataFrame([], "node_id string, version int").write.parquet(f"{root}/gone")
    kind = "dim int, lists int, subs int, codes int, probes int"
    spark.createDataFrame([(dim, lists, subs, codes, lists)], kind).write.parquet(f"{root}/settings")
    index = VectorIndex(spark, root)
    index._write(vectors, 1, slice_rows, "error")
    probes = _probes(index, few, target)
    spark.createDataFrame([(dim, lists, subs, codes, probes)], kind).write.mode("overwrite").parquet(f"{root}/settings")
    return VectorIndex(spark, root)


def _probes(index: VectorIndex, sample: DataFrame, target: float, asked: int = 128, k: int = 10) -> int:
    """The least number of probed lists that hold `target` of the k true neighbours of some of the sample's vectors."""
    some = sample.orderBy(F.xxhash64("node_id", F.lit("probes")), "node_id").limit(asked).select(F.col("node_id").alias("query_id"), F.lit(None).cast("string").alias("user_id"), "embedding")
    rows = index.lists().select("node_id", F.lit(None).cast("string").alias("user_id"), "embedding", "list")
    true = vector_topk_batch(rows, some, k).select("query_id", "node_id").join(rows.select("node_id", "list"), "node_id")
    order = index.probes_of(some, index.settings.lists).groupBy("query_id").agg(F.collect_list("list").alias("order"))  # bounded: asked x lists
    at = true.join(order, "query_id").select(F.array_position("order", F.col("list")).alias("at")).groupBy("at").agg(F.count("*").alias("n")).orderBy("at").collect()
    total, held = sum(r.n for r in at), 0
    for r in at:
        held += r.n
        if held >= target * total:
            return int(r["at"])
    return index.settings.lists
