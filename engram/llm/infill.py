"""Fill-in-middle: a text's prefix, middle and suffix in another order, cut between units (lines, words, characters).

Overlapping-chunk decomposition. Whether a unit ends between two bytes depends on those two alone, so a text is cut into
chunks that overlap by one byte, and each chunk counts the ends it owns and the code points it begins, all chunks at once.
Prefix sums over the chunks of a text then say which chunk owns a wanted rank; only that chunk is scanned again, to find the
byte. The same sums give the code points before a cut. Texts are neither split nor joined into lists of units.

Which ranks and which form are decided by a hash of the id, in Spark; restoring is a column expression over output and form.
Each row is worked on where it lies: nothing is shuffled.

A null text is empty: 0 units, form plain, empty output. Texts that hold a tag stay plain. Very long texts are counted in
blocks of chunks, so beside the text and its output memory doesn't follow their length. A null id hashes as no digits; rows of
equal ids get equal hashes. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.textscan import chunks

#: The tags before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK, BLOCK = 4096, 256
UNITS = ("line", "word", "char")
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ends_between(before: np.ndarray, after: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit ends between neighbouring bytes. A line ends after \\n, a word before what follows white space, a
    character before a byte that begins one."""
    if unit == "line":
        return before == 0x0A
    if unit == "word":
        return _SPACE[before] & ~_SPACE[after]
    if unit == "char":
        return (after & 0xC0) != 0x80
    raise ValueError(f"unit must be one of {UNITS}")


class Ranks:
    """Unit ends and code points of the rows `b[offsets[i]:offsets[i + 1]]`, by chunks of each row.

    Chunk c of a row covers its bytes [starts[c], stops[c]) and owns the places before each of them but the row's first byte:
    it also reads the byte before, which is its overlap.
    """

    def __init__(self, b: np.ndarray, offsets: np.ndarray, unit: str, chunk: int = CHUNK) -> None:
        self.b, self.offsets, self.unit = b, offsets, unit
        lengths = np.diff(offsets)
        per_row = -(-lengths // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_row)])  # chunk of each row
        row = np.repeat(np.arange(len(lengths)), per_row)
        inner = np.arange(len(row)) - self.first[row]
        self.row_start = offsets[row]
        self.starts = self.row_start + inner * chunk
        self.stops = np.minimum(self.starts + chunk, offsets[row + 1])
        counted = [self._counts(k, min(k + BLOCK, len(row))) for k in range(0, len(row), BLOCK)]
        ends, points = (np.concatenate([[0], *(c[i] for c in counted)]).astype(np.int64) for i in (0, 1))
        self.ends, self.points = np.cumsum(ends), np.cumsum(points)
        #: Units of each row: the ends inside it, and its own.
        self.units = self.ends[self.first[1:]] - self.ends[self.first[:-1]] + (lengths > 0)

    def _counts(self, k: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends and code points of the chunks k to stop, which lie side by side."""
        at, end = self.starts[k], self.stops[stop - 1]
        after = self.b[at:end]
        before = np.concatenate([[self.b[at - 1] if at else 0x20], after[:-1]]).astype(np.uint8)
        ends = ends_between(before, after, self.unit)
        heads = self.row_start[k:stop]
        ends[heads[(heads >= at) & (heads < end)] - at] = False  # a row's first byte follows nothing
        bounds = self.starts[k:stop] - at
        return np.add.reduceat(ends, bounds, dtype=np.int64), np.add.reduceat((after & 0xC0) != 0x80, bounds, dtype=np.int64)

    def cut(self, row: int, rank: int) -> tuple[int, int]:
        """Byte position after the first `rank` units of a row, and the code points before it in the row."""
        first, last = self.first[row], self.first[row + 1]
        if rank <= 0:
            return int(self.offsets[row]), 0
        if rank >= self.units[row]:
            return int(self.offsets[row + 1]), int(self.points[last] - self.points[first])
        wanted = self.ends[first] + rank
        c = int(np.searchsorted(self.ends[first + 1 : last + 1], wanted)) + int(first)  # the chunk that owns the rank
        at, end = int(self.starts[c]), int(self.stops[c])
        lead = max(at, int(self.row_start[c]) + 1)
        found = np.flatnonzero(ends_between(self.b[lead - 1 : end - 1], self.b[lead:end], self.unit))
        place = lead + int(found[wanted - self.ends[c] - 1])
        return place, int(self.points[c] - self.points[first] + np.count_nonzero((self.b[at:place] & 0xC0) != 0x80))


def _hashes(seed: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(documents: DataFrame, unit: str = "line", seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, text -> doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    `rate` of a hundred documents are transformed, `spm` of a hundred of those with the suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    tags = [t.encode() for t in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches):
        for batch in batches:
            ids, h = batch.column(0), [batch.column(2 + i).to_numpy() for i in range(4)]
            for i, j, b, offsets in chunks(batch.column(1)):
                ranks = Ranks(b, offsets, unit)
                rows = []
                for k in range(j - i):
                    text, n = b[offsets[k] : offsets[k + 1]].tobytes(), int(ranks.units[k])
                    h1, h2, h3, h4 = (int(x[i + k]) for x in h)
                    if not text or any(t in text for t in tags) or h3 % 100 >= rate:
                        rows.append((n, "plain", None, None, text))
                        continue
                    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
                    (p, p_chars), (m, m_chars) = ranks.cut(k, a), ranks.cut(k, z)
                    p, m = p - int(offsets[k]), m - int(offsets[k])
                    if h4 % 100 < spm:
                        rows.append((n, "spm", p_chars, m_chars - p_chars, b"".join((tags[1], text[m:], tags[0], text[:p], tags[2], text[p:m]))))
                    else:
                        rows.append((n, "psm", p_chars, m_chars - p_chars, b"".join((tags[0], text[:p], tags[1], text[m:], tags[2], text[p:m]))))
                n, form, prefix, middle, output = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *_hashes(seed)).mapInArrow(run, OUT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: its parts by the tags, in their old order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # empty, then the three parts in the form's order
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_infill(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import small_batches, table

    with small_batches(spark):
        made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
