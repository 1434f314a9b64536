"""Token ids as Arrow streams of equal-length sequences, and a reader with random access to them.

A shard is two files in Arrow's stream format. `*.ids.arrows` holds batches of `per_batch` sequences with two fixed-size
lists of `length` values: `ids` (16 bits where the vocabulary allows, else 32) and `mask` (a bit: a token, or padding). Without
nulls or compression all full batches have one size, so sequence i lies at a place known by arithmetic: a reader maps or
range-reads that batch alone, and its values are views of the bytes read. Only the last batch of a shard may be shorter, only
its last sequence is padded. `*.docs.arrows` names the documents of the shard in order: doc_id, where its ids start in the
shard, how many there are, the end id included. Parameters are in the schemas' metadata; nothing else is needed to read.

Documents are dealt to shards by ranges of doc_id (nulls first; rows of one id go on by the text's hash and the text, so a
hot id is split), sorted within them by Spark, and encoded while they are written. Texts are encoded piece by piece
(`engram.llm.pieces`) by the tokenizers library itself, whole texts where its file asks for more than the byte-level split.
Each task writes under names of its own to the shared folder and lists them in a table, all that readers go by; a lost or
repeated task leaves files nobody lists. Where a shard's ids start among all is the sum of the shards before it.

Nulls are empty texts: the end id alone. Very long texts are encoded whole, in one task, and go to the file in batches.
Repeated rows each have their place; rows equal in id and text are alike, whatever their order. Other columns are ignored;
an empty table has no shards and gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import Scratch, small_batches
from engram.llm.pieces import PieceEncoder, WholeTexts, library_encoder

LENGTH, PER_BATCH, DOCS_PER_BATCH = 2048, 64, 4096
LISTING = "shard int, path string, docs long, tokens long, sequences long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


# --- the format ------------------------------------------------------------------------------------------


def _schema(length: int, per_batch: int, ids: int, end_id: int) -> pa.Schema:
    """`ids`: how many different ones there are."""
    kind = pa.uint16() if ids <= 1 << 16 else pa.uint32()
    meta = {"sequences_per_batch": str(per_batch), "end_id": str(end_id)}
    return pa.schema([pa.field("ids", pa.list_(kind, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)], meta)


def _batch(ids: np.ndarray, tokens: int, schema: pa.Schema) -> pa.RecordBatch:
    """Whole sequences, of whose ids the first `tokens` count."""
    kind = schema.field("ids").type
    lists = [pa.FixedSizeListArray.from_arrays(x, kind.list_size) for x in (pa.array(ids, kind.value_type), pa.array(np.arange(len(ids)) < tokens))]
    return pa.RecordBatch.from_arrays(lists, schema=schema)


class ShardWriter:
    """Fills batches of sequences from documents in order; `fs` and `path` (without ending) say where."""

    def __init__(self, fs: pafs.FileSystem, path: str, length: int, per_batch: int, n_ids: int, end_id: int) -> None:
        self.schema = _schema(length, per_batch, n_ids, end_id)
        self.sinks = [fs.open_output_stream(f"{path}.{kind}.arrows") for kind in ("ids", "docs")]
        self.ids_file, self.docs_file = (pa.ipc.new_stream(s, k) for s, k in zip(self.sinks, (self.schema, _DOCS), strict=True))
        self.length, self.room = length, length * per_batch
        self.ids, self.end = np.zeros(self.room, self.schema.field("ids").type.value_type.to_pandas_dtype()), np.array([end_id])
        self.held = self.tokens = self.docs = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.tokens, len(ids) + 1))
        self._put(ids)
        self._put(self.end)
        self.docs += 1
        if len(self.rows) == DOCS_PER_BATCH:
            self._list()

    def _put(self, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(len(ids) - at, self.room - self.held)
            self.ids[self.held : self.held + n] = ids[at : at + n]
            at, self.held, self.tokens = at + n, self.held + n, self.tokens + n
            if self.held == self.room:
                self._flush(self.room)

    def _flush(self, n: int) -> None:
        self.ids_file.write_batch(_batch(self.ids[:n], self.held, self.schema))
        self.held = 0

    def _list(self) -> None:
        self.docs_file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=_DOCS))
        self.rows = []

    def close(self) -> int:
        """Pads the last sequence; how many there are."""
        if self.held:
            whole = -(-self.held // self.length) * self.length
            self.ids[self.held : whole] = 0
            self._flush(whole)
        if self.rows:
            self._list()
        for f in (self.ids_file, self.docs_file, *self.sinks):
            f.close()
        return -(-self.tokens // self.length)


class Sequences:
    """Random access to the sequences of an `ids` file, read by ranges; on a mapped file without a copy."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.size = file, file.size()
        file.seek(0)
        self.schema = pa.ipc.read_schema(file)
        self.length = self.schema.field("ids").type.list_size
        self.per_batch, self.end_id = (int(self.schema.metadata[x]) for x in (b"sequences_per_batch", b"end_id"))
        self.first = file.tell()
        zeros = np.zeros(self.per_batch * self.length, np.uint16)
        self.stride = pa.ipc.get_record_batch_size(_batch(zeros, 0, self.schema))
        self.end = self.size - 8  # where the mark that ends a stream begins
        self.held: tuple[int, np.ndarray, pa.BooleanArray] | None = None
        self.batches = -(-(self.end - self.first) // self.stride)
        # only the last batch may be shorter: it says itself how many it has
        self.count = (self.batches - 1) * self.per_batch + len(self.batch(self.batches - 1)[0]) // self.length if self.batches else 0

    def __len__(self) -> int:
        return self.count

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """All ids and mask bits of batch k as views of the bytes read; the last one read is kept."""
        if self.held is None or self.held[0] != k:
            at = self.first + k * self.stride
            self.file.seek(at)
            data = self.file.read_buffer(min(self.stride, self.end - at))
            batch = pa.ipc.read_record_batch(pa.ipc.read_message(data), self.schema)
            self.held = (k, batch.column(0).flatten().to_numpy(), batch.column(1).flatten())
        return self.held[1:]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """ids and mask of sequence i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k, at = divmod(i, self.per_batch)
        ids, mask = self.batch(k)
        return ids[at * self.length : (at + 1) * self.length], mask.slice(at * self.length, self.length)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from `start` on, n of them, in views of one batch each."""
        room = self.length * self.per_batch
        while n > 0:
            k, at = divmod(start, room)
            if k >= self.batches:
                raise ValueError("a document ends beyond its file's tokens")
            ids, mask = self.batch(k)
            take = min(n, len(ids) - at)
            if take <= 0 or not mask[at + take - 1].as_py():
                raise ValueError("a document ends beyond its file's tokens")
            yield ids[at : at + take]
            start, n = start + take, n - take


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI; local files are mapped."""
    fs, root = pafs.FileSystem.from_uri(folder)
    return (pafs.LocalFileSystem(use_mmap=True), root) if isinstance(fs, pafs.LocalFileSystem) else (fs, root)


# --- Spark -----------------------------------------------------------------------------------------------


def vocabulary_size(config: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return max(end_id, *Tokenizer.from_str(config).get_vocab().values()) + 1


#: The encoder of this worker process: tasks that follow on find it warm. Holds one tokenizer.
_WORKER: dict[str, PieceEncoder | WholeTexts] = {}


def worker_encoder(config: str) -> PieceEncoder | WholeTexts:
    if config not in _WORKER:
        _WORKER.clear()
        encode, apart, specials = library_encoder(config)
        _WORKER[config] = PieceEncoder(encode, specials) if apart else WholeTexts(encode)
    return _WORKER[config]


def write_sequences(documents: DataFrame, config: str, folder: str, end_id: int, length: int = LENGTH, per_batch: int = PER_BATCH, shards: int | None = None) -> DataFrame:
    """A plan whose rows list the shards it writes to `folder`, a URI of the shared file system. `config`: the tokenizer
    file's JSON text. `shards`: at most so many; else as many as Spark's shuffle partitions."""
    shared, n_ids = documents.sparkSession.sparkContext.broadcast(config), vocabulary_size(config, end_id)

    def run(batches):
        fs, root = file_system(folder)
        encoder, writer, path = worker_encoder(shared.value), None, ""
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for i, j, ids, at in encoder.texts(batch.column(1)):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}"
                    writer = ShardWriter(fs, path, length, per_batch, n_ids, end_id)
                for k in range(i, j):
                    writer.add(ids_of[k], ids[at[k - i] : at[k - i + 1]])
        if writer is not None:
            sequences = writer.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "docs": [writer.docs], "tokens": [writer.tokens], "sequences": [sequences]})

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange(*([shards] if shards else []), "doc_id", "tie")
    return dealt.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text").mapInArrow(run, LISTING)


def with_starts(listing: DataFrame) -> DataFrame:
    """The listing with `before`: the ids of all shards before. A row for each shard, so one task sums them."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return listing.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_sequences(listing: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """Documents of the shards listed: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (and ids).

    Every document is read from the files: its entry in `docs`, then its ids by ranges. The checksum is of 32-bit
    little-endian ids, whatever the file's. A document that doesn't end with the file's end id raises.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if ids else [])

    def run(batches):
        fs, _ = file_system(folder)
        for batch in batches:
            for path, before in zip(*(batch.column(c).to_pylist() for c in (0, 1)), strict=True):
                with fs.open_input_file(f"{path}.ids.arrows") as f, fs.open_input_file(f"{path}.docs.arrows") as g:
                    sequences = Sequences(f)
                    for docs in pa.ipc.open_stream(g):
                        held = []
                        for doc_id, start, n in zip(*(c.to_pylist() for c in docs.columns), strict=True):
                            crc, parts, last = 0, [], None
                            for part in sequences.run(start, n):
                                crc, last = zlib.crc32(part.astype("<u4"), crc), part[-1]
                                if ids:
                                    parts.append(part.astype(np.int32))
                            if last != sequences.end_id:
                                raise ValueError(f"{path}: a document does not end at {start + n}")
                            held.append((doc_id, before + start, n, crc) + ((np.concatenate(parts),) if ids else ()))
                            if ids and len(held) == 64:
                                yield _rows(held, fields)
                                held = []
                        if held:
                            yield _rows(held, fields)

    return listing.select("path", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else ""))


def _rows(held: list[tuple], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def sequence_round_trip(documents: DataFrame, config: str, end_id: int, ids: bool = False, length: int = LENGTH, per_batch: int = PER_BATCH, shards: int | None = None) -> DataFrame:
    """Writes all documents to sequence files in the shared folder and reads them back."""
    s = Scratch(documents.sparkSession, "sequences")
    folder = s.path("shards")
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    with small_batches(documents.sparkSession):
        listing = s.keep(write_sequences(documents, config, folder, end_id, length, per_batch, shards), "listing")
    files = s.keep(with_starts(listing), "starts")
    return read_sequences(files.repartition(min(max(1, files.count()), 10_000), "path"), folder, ids)


def op11_token_sequences(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table
    from engram.llm.token_counts import production_config

    return sequence_round_trip(table(spark, sf_dir, "documents"), production_config(), end_id=2)
