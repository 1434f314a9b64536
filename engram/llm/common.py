"""Shared helpers: table access, scratch tables in the cluster's shared folder, fair buckets."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`. Where that is unset and Spark runs in one process, as in
    tests, a temporary folder; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="engram-"))
    return _LOCAL_ROOT[0]


def free_name(columns: list[str], name: str) -> str:
    """`name`, with as many underscores added as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of the queries that run meanwhile go as soon as each ends, not when the driver next collects garbage, so that
    those of several steps don't add up. A stage that still needs lost ones is run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While it lasts, Python workers get batches of at most `rows` rows: texts and sets are long, so fewer of them are in
    memory at once on both sides. Results don't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: What this worker process holds ready for the tasks that follow.
_WORKER: dict[object, object] = {}


def worker_state(key: object, make):
    """`make()`, kept in this worker process under `key`. One state is held at a time, whichever operator it is of, so the stages
    of a pipeline don't add up in workers that serve all of them."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


class Scratch:
    """Tables that cut lineage: written as Parquet under the shared root, so a lost executor loses nothing.

    `keep` writes and rereads a frame; `drop` removes tables that no later plan reads. What a returned
    plan still reads stays, as with `DataFrame.checkpoint()`; `clean_scratch` removes it all.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_root(spark)}/engram-scratch/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        with small_batches(self.spark), shuffles_removed(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean_scratch(spark: SparkSession) -> None:
    """Remove every scratch table; only when no unfinished plan reads one."""
    _delete(spark, f"{shared_root(spark)}/engram-scratch")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def salts(rows: int, least: int = 256, per: int = 20_000) -> int:
    """Number of sub-buckets into which a hot key is dealt: grows with the rows, each holds about `per`."""
    return max(least, rows // per)


def salt(column: str, n: int):
    """A deterministic sub-bucket of a row."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("salt")), F.lit(n)).cast("int")
