"""A memory's tables in versions. A batch's tables are staged together and published by one manifest.

Under a root: `data/<name>/<table>` holds plain Parquet that is never changed once written; `manifests/<version>.json` names, for
each table, the folders it consists of. A manifest appears whole, by a rename that fails if the version is there, so a batch
counts whole or not at all, and of two writers that started from one version only one succeeds. Readers take the newest
manifest, or stay with the version they name. What was staged by a batch that died is named by no manifest; `vacuum` removes it.

Tables come back as scans: whatever a batch's plans were, the next batch starts from files, so plans don't grow.
The root must be in a file system whose renames are atomic (a local disk, HDFS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types

from engram.sources import tables as T

NAMES = ("events", "nodes", "edges", "operations", "vectors", "documents", "feedback")
#: Tables whose rows aren't changed once written, and what names a row there.
GROWING = {"events": "id", "operations": "id", "vectors": "node_id", "documents": "node_id"}


class CommitConflict(RuntimeError):
    """Another batch was published first."""


class VersionedMemory:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    # --- files

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        where = self._path(folder)
        fs = where.getFileSystem(self._conf)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def _publish(self, version: int, manifest: dict) -> None:
        draft, final = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{version:08d}.json")
        out = draft.getFileSystem(self._conf).create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, never)
        except Exception as e:
            draft.getFileSystem(self._conf).delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {version} is there") from None
            raise

    # --- reading

    def versions(self) -> list[int]:
        return [int(n[:8]) for n in self._names("manifests") if n.endswith(".json")]

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"tables": {}}
        rows = self.spark.read.text(f"{self.root}/manifests/{version:08d}.json").collect()
        return json.loads(rows[0].value)

    def latest(self) -> int:
        """0 where nothing is published."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> T.MemoryTables:
        """The tables of a version, the newest by default. They stay as they are while other versions are published."""
        told = self._manifest(self.latest() if version is None else version)["tables"]
        out = T.empty_tables(self.spark)
        for name, table in told.items():
            kind = types.StructType.fromJson(table["schema"])
            setattr(out, name, self.spark.read.schema(kind).parquet(*[f"{self.root}/{f}" for f in table["folders"]]) if table["folders"] else self.spark.createDataFrame([], kind))
        return out

    # --- writing

    def commit(self, tables: T.MemoryTables, base: int) -> T.MemoryTables:
        """Publishes what became of the tables of version `base` as the next one, and gives it back, read from its files.

        Of a table that only grew, the new rows are written; others are written whole. Raises `CommitConflict` if another
        version was published meanwhile.
        """
        if self.latest() != base:
            raise CommitConflict(f"version {self.latest()} came after {base}")
        old, before = self._manifest(base)["tables"], self.read(base)
        stage, told = f"data/{uuid.uuid4().hex}", {}
        for name in NAMES:
            new: DataFrame | None = getattr(tables, name)
            if new is None:
                continue
            folder, had = f"{stage}/{name}", getattr(before, name) if name in old else None
            fresh = self._grown(name, had, new) if had is not None else None
            (new if fresh is None else fresh).write.parquet(f"{self.root}/{folder}")
            told[name] = {"schema": new.schema.jsonValue(), "folders": [*(old[name]["folders"] if fresh is not None else []), folder]}
        self._publish(base + 1, {"version": base + 1, "tables": told})
        return self.read(base + 1)

    def _grown(self, name: str, had: DataFrame, new: DataFrame) -> DataFrame | None:
        """The rows that came to a table, if none went."""
        key = GROWING.get(name)
        if key is None or had.schema != new.schema or not had.join(new.select(key), key, "left_anti").isEmpty():
            return None
        return new.join(had.select(key).distinct(), key, "left_anti").select(*new.columns)

    def apply(self, change: Callable[[T.MemoryTables], T.MemoryTables], tries: int = 5) -> T.MemoryTables:
        """Runs a change on the newest version and publishes it; if another writer was first, on what that one published."""
        for n in range(tries):
            base = self.latest()
            try:
                return self.commit(change(self.read(base)), base)
            except CommitConflict:
                if n == tries - 1:
                    raise
        raise ValueError("tries must be 1 or more")

    # --- upkeep

    def compact(self) -> T.MemoryTables:
        """The newest version again, every table in one folder."""
        base = self.latest()
        now, stage, told = self.read(base), f"data/{uuid.uuid4().hex}", {}
        for name, table in self._manifest(base)["tables"].items():
            if len(table["folders"]) > 1:
                getattr(now, name).write.parquet(f"{self.root}/{stage}/{name}")
                table = table | {"folders": [f"{stage}/{name}"]}
            told[name] = table
        self._publish(base + 1, {"version": base + 1, "tables": told})
        return self.read(base + 1)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes all but the last `keep` versions and every folder that none of these names; the folders' names. No batch may
        be staging meanwhile."""
        versions = self.versions()
        kept = versions[-keep:]
        used = {f.split("/")[1] for v in kept for t in self._manifest(v)["tables"].values() for f in t["folders"]}
        for v in versions[:-keep] if keep else versions:
            where = self._path(f"manifests/{v:08d}.json")
            where.getFileSystem(self._conf).delete(where, False)
        gone = [n for n in self._names("data") if n not in used]
        for n in gone:
            where = self._path(f"data/{n}")
            where.getFileSystem(self._conf).delete(where, True)
        return gone
