"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file whose members are stored: WARC members of per-record gzip, an index with a line per
record, and a small manifest. The reader finds the end record, follows the ZIP64 one if it is there, reads the
central directory, locates stored members by their local headers, and reads only the byte ranges of the index.

Files live in the cluster's shared folder and are reached through Arrow's file systems (local, HDFS, object
stores), never a machine's own disk. Each task writes under a name of its own and lists it in a table, which is
all that readers go by; a lost or repeated task leaves a file nobody lists.

Very long payloads: a record is built and packed whole, one at a time in a worker's memory, and may pass `MEMBER_BYTES`: it is a
member of its own then. Nulls: a null html is an empty payload, a null url leaves the target header out. Repeated rows: equal payloads
with the same greatest page_id are all responses. Extra columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Scratch, salt, salts

MEMBER_BYTES = 8 << 20
ARCHIVE_BYTES = 32 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP -------------------------------------------------------------------------------------------------


class ZipWriter:
    """Writes stored members to a sink that only appends. ZIP64 where sizes ask for it, or always."""

    def __init__(self, sink, always_64: bool = False) -> None:
        self.sink, self.at, self.entries, self.always = sink, 0, [], always_64

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, where = name.encode(), zlib.crc32(data), self.at
        big = self.always or len(data) >= 0xFFFFFFFF
        size = 0xFFFFFFFF if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.entries.append((raw, crc, len(data), where))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, where in self.entries:
            big = self.always or size >= 0xFFFFFFFF or where >= 0xFFFFFFFF
            extra = struct.pack("<HHQQQ", 1, 24, size, size, where) if big else b""
            n, w = (0xFFFFFFFF, 0xFFFFFFFF) if big else (size, where)
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, w) + raw + extra)
        length, count = self.at - start, len(self.entries)
        if self.always or count >= 0xFFFF or start >= 0xFFFFFFFF:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, count, count, length, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, end64, 1))
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, count, count, length, start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class ZipReader:
    """Reads a ZIP by ranges. `read(offset, n)` gives bytes of the file, whose size is `size`."""

    def __init__(self, read, size: int) -> None:
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
            (where,) = struct.unpack_from("<Q", tail, end - 12)
            record = read(where, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(read(start, length), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, Member]:
        out, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, size, n_name, n_extra, n_note = struct.unpack_from("<H8xIIHHH", data, at + 10)
            (header,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n_name].decode()
            extra, stop = at + 46 + n_name, at + 46 + n_name + n_extra
            while extra + 4 <= stop:
                tag, n = struct.unpack_from("<HH", data, extra)
                if tag == 1:  # 64-bit values stand only for fields that are full, in this order
                    values = list(struct.unpack_from(f"<{n // 8}Q", data, extra + 4))
                    size = values.pop(0) if size == 0xFFFFFFFF else size
                    packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                    header = values.pop(0) if header == 0xFFFFFFFF else header
                extra += 4 + n
            out[name] = Member(name, method, size, header)
            at = stop + n_note
        return out

    def start(self, member: Member) -> int:
        """Where a stored member's bytes begin; the local header's own lengths count."""
        if member.method != 0:
            raise ValueError(f"{member.name} is not stored")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {member.name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n_name + n_extra

    def range(self, name: str, offset: int, n: int) -> bytes:
        member = self.members[name]
        if offset < 0 or offset + n > member.size:
            raise ValueError(f"range beyond {name}")
        return self.read(self.start(member) + offset, n)


# --- WARC ------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A gzip member with a response record, or with a revisit that keeps the HTTP header but no payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> dict:
    """One gzip member -> headers, http header length and payload; a response's payload must have its digest."""
    unpacker = zlib.decompressobj(31)
    data = unpacker.decompress(packed) + unpacker.flush()
    if not unpacker.eof or unpacker.unused_data:
        raise ValueError("a range must hold one whole gzip member")
    cut = data.index(b"\r\n\r\n")
    version, *lines = data[:cut].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = data[cut + 4 : cut + 4 + int(headers["content-length"])]
    http_end = block.index(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block[:http_end].decode("latin-1").split("\r\n")[1:])}
    payload = block[http_end + 4 :]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    page = lambda v: int(v.removeprefix("<urn:page:").removesuffix(">")) if v and v != "<urn:page:>" else None
    return {
        "page_id": page(headers["warc-record-id"]),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": int(http["content-length"]),
        "payload_digest": digest,
        "record_type": headers["warc-type"],
        "refers_to": page(headers.get("warc-refers-to")),
        "payload": payload if headers["warc-type"] == "response" else None,
    }


class ArchiveWriter:
    """Fills WARC members of bounded size, then the index and the manifest."""

    def __init__(self, sink, member_bytes: int, always_64: bool) -> None:
        self.zip, self.most = ZipWriter(sink, always_64), member_bytes
        self.held, self.size, self.index, self.members, self.records = [], 0, [], 0, 0

    def add(self, record: bytes) -> None:
        if self.held and self.size + len(record) > self.most:
            self._flush()
        self.index.append(f"archive/{self.members:05d}.warc.gz {self.size} {len(record)}")
        self.held.append(record)
        self.size += len(record)
        self.records += 1

    def _flush(self) -> None:
        self.zip.add(f"archive/{self.members:05d}.warc.gz", b"".join(self.held))
        self.members += 1
        self.held, self.size = [], 0

    @property
    def bytes(self) -> int:
        return self.zip.at + self.size

    def close(self) -> None:
        if self.held:
            self._flush()
        self.zip.add("indexes/index.txt", "".join(f"{x}\n" for x in self.index).encode())
        self.zip.add("datapackage.json", json.dumps({"profile": "data-package", "records": self.records}).encode())
        self.zip.close()


def read_archive(read, size: int):
    """Records of an archive, in the order of its index; each is one range of one stored member."""
    z = ZipReader(read, size)
    starts: dict[str, int] = {}
    for name in sorted(m for m in z.members if m.startswith("indexes/")):
        for line in z.range(name, 0, z.members[name].size).decode().splitlines():
            member, offset, n = line.rsplit(" ", 2)
            if member not in starts:
                starts[member] = z.start(z.members[member])
            if int(offset) + int(n) > z.members[member].size:
                raise ValueError(f"range beyond {member}")
            yield parse_record(read(starts[member] + int(offset), int(n)))


# --- Spark -----------------------------------------------------------------------------------------------


def repeated_payloads(base: DataFrame, least_bytes: int) -> DataFrame:
    """digest, salt, last: of every payload that occurs twice or more, the greatest page_id, per salt it occurs under.

    Only digests are shuffled. They are counted per (digest, salt) first, so a payload that a third of the pages
    share is split over many tasks.
    """
    parts = base.where("digest is not null").groupBy("digest", "salt").agg(F.max("page_id").alias("own_max"), F.count("*").alias("c"))
    whole = parts.groupBy("digest").agg(F.max("own_max").alias("last"), F.sum("c").alias("n")).where("n > 1").select("digest", "last")
    return parts.select("digest", "salt").join(whole, "digest")


def with_revisits(pages: DataFrame, least_bytes: int = 1000, broadcast_rows: int = 250_000) -> DataFrame:
    """page_id, url, payload, refers_to: of equal payloads of `least_bytes` or more all but the greatest page_id refer to that one.

    The table of repeated digests (32 bytes and a long a row) is written once and counted. Up to
    `broadcast_rows` it meets the payloads where they are scanned; beyond, in a shuffle join on (digest, salt).
    """
    s = Scratch(pages.sparkSession, "revisits")
    n = salts(pages.count())
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.when(F.length("payload") >= least_bytes, F.unhex(F.sha2("payload", 256)))).withColumn("salt", salt("page_id", n))
    last = s.keep(repeated_payloads(base, least_bytes), "repeated")
    few = last.count() <= broadcast_rows
    if few:
        joined = base.join(F.broadcast(last.select("digest", "last").distinct()), "digest", "left")
    else:
        joined = base.join(last, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id"), F.lit(-(1 << 62))) < F.col("last"), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, member_bytes: int = MEMBER_BYTES, archive_bytes: int = ARCHIVE_BYTES, always_64: bool = False) -> DataFrame:
    """A plan whose rows (path, records) list the archives it writes to `folder`, a URI of the shared file system."""

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        archive = sink = path = None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(c)[i].as_py() for c in range(4))
                if archive is None:
                    path = f"{root}/{uuid.uuid4().hex}.wacz"
                    sink = fs.open_output_stream(path)
                    archive = ArchiveWriter(sink, member_bytes, always_64)
                archive.add(make_record(page_id, url, payload, refers_to))
                if archive.bytes >= archive_bytes:
                    archive.close()
                    sink.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [archive.records]})
                    archive = None
        if archive is not None:
            archive.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [archive.records]})

    return with_revisits(pages, least_bytes).mapInArrow(run, "path string, records long")


def read_archives(listing: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives listed: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] if payloads else []

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as f:
                    held = []

                    def ranged(offset: int, n: int, f=f) -> bytes:
                        return f.read_at(n, offset)

                    for record in read_archive(ranged, f.size()):
                        held.append(record)
                        if len(held) == 256:
                            yield _batch(held, fields)
                            held = []
                    if held:
                        yield _batch(held, fields)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    return listing.select("path").mapInArrow(run, kinds)


def _batch(records: list[dict], fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in records], kind) for name, kind in fields], names=[name for name, _ in fields])


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000, payloads: bool = False, always_64: bool = False) -> DataFrame:
    """Writes every page to archives in the shared folder and reads the records back."""
    s = Scratch(pages.sparkSession, "warc")
    folder = s.path("archives")
    if "://" not in folder:
        folder = f"file://{folder.removeprefix('file:')}"
    listing = s.keep(write_archives(pages, folder, least_bytes, always_64=always_64), "listing")
    files = max(1, listing.count())
    return read_archives(listing.repartition(min(files, 10_000), "path"), folder, payloads)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")
