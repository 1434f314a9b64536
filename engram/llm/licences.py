"""Licence scans: exact phrases, and fuzzy search for short notices.

A notice may differ in at most `e` characters. Cut into e + 1 pieces, one piece at least must then stand
unchanged (pigeonhole), so exact `find` of the pieces locates candidates; the `regex` library's bounded-error
matching, on the candidate's neighbourhood only, verifies the edits and gives the span.

Texts are normalised once: A-Z lowered, words joined by single spaces. Base phrases are found on the same
form, so word positions come from counting spaces. Nulls and empty texts have no word, no place, no label and
score 0; very long texts are searched whole, one at a time; repeated rows each get their result; of places that tie in
edits the first is taken, and places of one notice don't overlap; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base phrases and their labels, fixed by the contract.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices that the fuzzy search looks for, the label of each, and the edits allowed.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("licensed under the apache license", "apache", 3),
    ("under the apache license", "apache", 2),
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("creative commons attribution", "cc-by", 3),
    ("this is free and unencumbered software released into the public domain", "unlicense", 5),
    ("boost software license", "bsl", 2),
    ("eclipse public license", "epl", 2),
    ("all rights reserved", "all-rights-reserved", 1),
]

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"


@dataclass(frozen=True)
class Notice:
    text: bytes
    label: str
    edits: int
    pieces: tuple[tuple[int, bytes], ...]
    near: object
    best: object

    @classmethod
    def of(cls, text: str, label: str, edits: int) -> Notice:
        raw = text.encode()
        cuts = [len(raw) * i // (edits + 1) for i in range(edits + 2)]
        pieces = tuple((a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
        if any(len(p) < 3 for _, p in pieces):
            raise ValueError(f"{edits} edits leave no seed in {text!r}")
        if len(raw) < 6 * edits:
            raise ValueError(f"{edits} edits are too many for {text!r}")
        fuzzy = rb"(?:" + regex.escape(raw, literal_spaces=True) + rb"){e<=%d}" % edits
        return cls(raw, label, edits, pieces, regex.compile(fuzzy), regex.compile(rb"(?b)" + fuzzy))


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> None:
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = [Notice.of(*n) for n in notices]

    def base(self, text: bytes) -> list[tuple[int, str]]:
        """(byte position of the first word, label) of every place of a phrase in a spaced text."""
        found = []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                found.append((at + 1, label))
                at = text.find(phrase, at + 1)
        return found

    def fuzzy(self, text: bytes) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of notices on a spaced text; overlapping candidates are verified together."""
        found = []
        for n in self.notices:
            zones: list[list[int]] = []
            marks = []
            for offset, piece in n.pieces:
                at = text.find(piece)
                while at >= 0:
                    marks.append((max(0, at - offset - n.edits), min(len(text), at - offset + len(n.text) + n.edits)))
                    at = text.find(piece, at + 1)
            for lo, hi in sorted(marks):
                if zones and lo <= zones[-1][1]:
                    zones[-1][1] = max(zones[-1][1], hi)
                else:
                    zones.append([lo, hi])
            for lo, hi in zones:
                for m in self._verify(n, text, lo, hi):
                    found.append((n.label, *m))
        return sorted(set(found), key=lambda f: (f[1], f[2], f[0], f[3]))

    @staticmethod
    def _verify(n: Notice, text: bytes, lo: int, hi: int):
        """Places of the notice in a zone that don't overlap: exact ones first; then, in the gaps between them from left
        to right, the best fit around each place that is near enough."""
        gaps, at = [], lo
        while (place := text.find(n.text, at, hi)) >= 0:
            yield place, place + len(n.text), 0
            gaps.append((at, place))
            at = place + len(n.text)
        gaps.append((at, hi))
        for lo, hi in gaps:
            while hi - lo >= len(n.text) - n.edits and (near := n.near.search(text, lo, hi)):
                best = n.best.search(text, near.start(), min(hi, near.end() + 2 * n.edits))
                yield best.start(), best.end(), sum(best.fuzzy_counts)
                lo = best.end()

    def rows(self, texts) -> dict[str, list]:
        out = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for raw in texts:
            words = (raw or b"").translate(_SPACED).split()
            text = b" " + b" ".join(words) + b" "
            base = self.base(text)
            fuzzy = self.fuzzy(text)
            labels = {label for _, label in base}
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            places = (min(base)[0], max(base)[0]) if base else None
            out["first_word"].append(text.count(b" ", 0, places[0]) - 1 if places else None)
            out["last_word"].append(text.count(b" ", 0, places[1]) - 1 if places else None)
            out["base_labels"].append(",".join(sorted(labels)))
            out["labels"].append(",".join(sorted(labels | {f[0] for f in fuzzy})))
            best = max((1 - f[3] / max(1, f[2] - f[1]) for f in fuzzy), default=0.0)
            out["score"].append(1.0 if base else max(0.0, best))
            out["spans"].append([{"label": f[0], "start": text.count(b" ", 0, f[1] + 1) - 1, "end": text.count(b" ", 0, f[2]), "edits": f[3]} for f in fuzzy])
        return out


def licence_scan(documents: DataFrame, phrases: dict[str, str] | None = None, notices=None) -> DataFrame:
    """Per document: base places and labels, fuzzy labels, and spans in words with their edits. No shuffle."""
    phrases, notices = phrases or PHRASES, notices or NOTICES

    def run(batches):
        scanner = Scanner(phrases, notices)
        span = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = scanner.rows(x.as_py() for x in part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, OUT)


def op9_licences(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return licence_scan(table(spark, sf_dir, "documents")).drop("spans")
