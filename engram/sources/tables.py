"""Sources and sinks: driver tables as memory tables, event store, migrations, export, statistics."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X

NOW = "2024-02-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as memory nodes: a narrow projection, so unused columns never leave the scan."""
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "event").when(F.col("event_type") == "view", "note").when(F.col("event_type") == "purchase", "decision").when(F.col("event_type") == "signup", "fact").otherwise("task")
    m = F.col("event_id") % 11
    state = F.when(m == 0, "superseded").when(m == 1, "archived").when(m == 2, "contested").when(m == 3, "deprecated").when(m.between(4, 6), "stable").otherwise("tentative")
    hours = F.make_dt_interval(F.lit(0), F.col("k"), F.lit(0), F.lit(0))
    e = e.withColumns({"node_type": kind, "epistemic_type": pick(list(S.EPISTEMIC_WEIGHTS), F.col("event_id") % 7)})
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        "node_type",
        F.col("user_id").cast("string").alias("user_id"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        pick(S.SCOPES, F.col("user_id") % 6).alias("scope"),
        F.concat_ws(" ", "event_type", F.col("k").cast("string")).alias("content"),
        F.col("props").alias("metadata"),
        (F.lit(0.3) + (F.col("k") % 70) / F.lit(100.0)).alias("confidence"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("salience"),
        state.alias("lifecycle_state"),
        F.col("ts").alias("valid_from"),
        F.when(F.col("event_id") % 13 == 0, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("valid_to"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("e"), F.col("event_id").cast("string")))).otherwise(F.array().cast("array<string>")).alias("evidence_refs"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        "epistemic_type",
        pick(S.SOURCE_TYPES, F.col("event_id") % 5).alias("source_type"),
        X.lookup(S.EPISTEMIC_DECAY, F.col("epistemic_type"), "medium").alias("decay_profile"),
        (F.col("ts") + hours).alias("last_reinforced_at"),
        ((F.col("k") % 6) / F.lit(10.0)).alias("reinforcement_boost"),
        F.least(F.col("value") / F.lit(100.0), F.lit(1.0)).alias("salience_base"),
        (F.lit(0.3) + (F.col("k") % 70) / F.lit(100.0)).alias("confidence_base"),
        (F.col("event_id") % 97 == 0).alias("pinned"),
        F.try_element_at(F.create_map(*[F.lit(x) for kv in S.TTL_DAYS.items() for x in kv]), F.col("node_type")).alias("ttl_days"),
        F.when(F.col("k") > 50, F.col("ts") - hours).alias("event_time"),
    )


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part_of edges: nation to region, customer and supplier to nation, order to customer."""
    part = lambda t, a, p, b, q: read(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("source_id"), F.concat(F.lit(q), F.col(b).cast("string")).alias("target_id"))
    parts = [part("nation", "n_nationkey", "n", "n_regionkey", "r"), part("customer", "c_custkey", "c", "c_nationkey", "n"), part("supplier", "s_suppkey", "s", "s_nationkey", "n"), part("orders", "o_orderkey", "o", "o_custkey", "c")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("edge_type", F.lit("part_of"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("node_id"), F.col("label").cast("string").alias("user_id"), "embedding")


def lexical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("node_id"), F.col("text").alias("content"), F.col("lang").alias("user_id"), F.col("source").alias("scope"))


@dataclass
class MemoryTables:
    """The tables an engine works on; every operator takes and gives DataFrames."""

    events: DataFrame
    nodes: DataFrame
    edges: DataFrame
    operations: DataFrame
    vectors: DataFrame | None = None
    documents: DataFrame | None = None
    feedback: DataFrame | None = None

    def register(self) -> None:
        """Temporary views, so `spark.sql` works on them."""
        for name in ("events", "nodes", "edges", "operations", "vectors", "documents"):
            if (df := getattr(self, name)) is not None:
                df.createOrReplaceTempView(name)


def empty_tables(spark: SparkSession) -> MemoryTables:
    return MemoryTables(*(spark.createDataFrame([], s) for s in (S.EVENTS, S.NODES, S.EDGES, S.OPERATIONS, S.VECTORS)))


BY_SCOPE, PLAIN = ("events", "nodes"), ("edges", "operations", "vectors", "documents", "feedback")


def write_tables(tables: MemoryTables, root: str) -> None:
    """Parquet under root; nodes and events lie by scope, so a scoped read skips other folders. Root must not be where the
    tables are read from."""
    for name in (*BY_SCOPE, *PLAIN):
        if (df := getattr(tables, name)) is not None:
            writer = df.write.mode("overwrite")
            (writer.partitionBy("scope") if name in BY_SCOPE else writer).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str) -> MemoryTables:
    """What `write_tables` wrote; tables that aren't there are left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = {f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)}
    read = lambda n: spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(f"{root}/{n}") if n in there else None
    shapes = {"events": S.EVENTS, "nodes": S.NODES}
    parts = {n: read(n) for n in (*BY_SCOPE, *PLAIN)}
    parts |= {n: parts[n].select(*[f.name for f in shapes[n].fields]) for n in shapes if parts[n] is not None}
    empty = empty_tables(spark)
    return MemoryTables(*(parts[n] if parts[n] is not None else getattr(empty, n) for n in ("events", "nodes", "edges", "operations", "vectors")), parts["documents"], parts["feedback"])


def migrate(df: DataFrame, schema, defaults: dict[str, object] | None = None) -> DataFrame:
    """Brings older rows to a schema: missing columns are added, nulls of given columns get their default."""
    defaults = {"scope": "personal", "epistemic_type": "asserted", "source_type": "user_stated", "decay_profile": "medium", "reinforcement_boost": 0.0, "pinned": False} | (defaults or {})
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in defaults:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        elif f.name in ("salience_base", "confidence_base") and f.name[:-5] in df.columns:
            c = F.coalesce(c, F.col(f.name[:-5]).cast("double"))
        elif f.name == "last_reinforced_at" and "updated_at" in df.columns:
            c = F.coalesce(c, F.col("updated_at").cast(f.dataType))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def new_events(rows: DataFrame, now) -> DataFrame:
    """Raw messages (id, role, content, user_id, ...) as immutable events with their content hash."""
    return migrate(rows.withColumns({"content_hash": F.sha2("content", 256), "timestamp": F.coalesce(F.col("timestamp"), X.at(now)) if "timestamp" in rows.columns else X.at(now), "created_at": X.at(now)}), S.EVENTS)


def event(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("id") == event_id)


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new events; ids that it holds already are left out, so a repeated append changes nothing."""
    return events.unionByName(new.dropDuplicates(["id"]).join(events.select("id"), "id", "left_anti").select(*events.columns))


def events_by_user(events: DataFrame, user_id: str, session_id: str | None = None, scopes: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, id breaks ties; planned as a bounded top-k."""
    out = events.where(F.col("user_id") == user_id)
    out = out.where(F.col("session_id") == session_id) if session_id is not None else out
    out = out.where(F.col("scope").isin(scopes)) if scopes else out
    return out.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def events_by_hash(events: DataFrame, hashes: DataFrame) -> DataFrame:
    """Events whose content hash is listed, (content_hash, user_id), newest first."""
    return events.join(hashes, ["content_hash", "user_id"], "left_semi").orderBy(F.desc("timestamp"), "id")


def statistics(df: DataFrame, by: str) -> DataFrame:
    """Rows by a column's value, most frequent first."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def averages(nodes: DataFrame) -> DataFrame:
    return nodes.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in ("confidence", "salience")])


def info(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and newest timestamp per table, in one plan."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n"), F.max(ts).alias("newest")) for name, (df, ts) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def export_json(tables: MemoryTables) -> DataFrame:
    """One JSON line per row, tagged by its table and a sort key (events: by time); write it with `.write.text`."""
    events = tables.events.select("id", "timestamp", "role", "content", "user_id", "scope")
    parts = [df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")) for kind, df, key in (("node", tables.nodes, F.col("id")), ("edge", tables.edges, F.col("id")), ("event", events, F.col("timestamp")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def derived_key(password: str, salt: bytes, rounds: int = 600_000) -> str:
    """A 32-byte key from a password (PBKDF2, SHA-256), as hexadecimal digits of 16 bytes: what `encrypt` takes."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 16).hex()


def encrypt(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """Columns as AES-GCM ciphertext under a 16, 24 or 32 byte key."""
    return df.withColumns({c: F.aes_encrypt(F.col(c).cast("binary"), F.lit(key)) for c in columns})


def decrypt(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.withColumns({c: F.aes_decrypt(F.col(c), F.lit(key)).cast("string") for c in columns})


def doctor(tables: MemoryTables) -> DataFrame:
    """One row per check: is a table there (events and nodes must be, the others should), and do rows keep the model's rules."""
    spark, n, e = tables.nodes.sparkSession if tables.nodes is not None else None, tables.nodes, tables.edges
    there = [(f"table {t}", "ok" if getattr(tables, t) is not None else "fail" if t in ("events", "nodes") else "warn", 0) for t in ("events", "nodes", "edges", "operations", "vectors", "documents")]
    state = n.agg(F.lit("known lifecycle states").alias("check_name"), F.count_if(~F.col("lifecycle_state").isin(list(S.TRANSITIONS))).alias("violations"))
    kind = n.agg(F.lit("known node types").alias("check_name"), F.count_if(~F.col("node_type").isin(S.NODE_TYPES)).alias("violations"))
    loose = e.join(n.select(F.col("id").alias("source_id")), "source_id", "left_anti").agg(F.lit("edges start at nodes").alias("check_name"), F.count("*").alias("violations"))
    rows = state.unionByName(kind).unionByName(loose).select("check_name", F.when(F.col("violations") == 0, "ok").otherwise("fail").alias("status"), "violations")
    return spark.createDataFrame(there, "check_name string, status string, violations long").unionByName(rows)
