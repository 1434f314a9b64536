"""N-gram Jaccard join on a prefix tree, at any number of documents.

1. One pass over the texts hashes every document's distinct word shingles. Equal sets form one class;
   only classes go on, so exact copies cost one row each.
2. Dealing. Two sets of sizes a, b that reach similarity t differ in at most (a + b)(1 - t)/(1 + t)
   elements. Cut hash space into more segments than that: the rest are the same in both. Each class emits a
   hash per segment; a class that shares fewer than a link would need is left out, and the others that meet
   are joined into coarse groups. Groups are supersets of the true ones, so no link is lost.
3. Every coarse group is dealt into blocks of at most `block` elements and `block_sets` sets, and each block is
   joined in one task on a prefix tree: its sets, in one global order (most frequent first), share paths, so the
   overlap of a probe with a shared path is counted once; a subtree is left as soon as the remaining lengths
   can't reach the threshold. A task's memory follows `block` and the longest text.
4. Groups of several blocks: a few sets of each component found so far are joined with one another, which
   merges the parts of a group of near copies; then every set outside the group's largest component meets
   all sets of the group. A link between two components has an end outside the largest, so none is lost,
   and a large group of near copies costs a pass over it, not all pairs of blocks. This goes in rounds, so what is
   written at once follows the sets; the time of a group without a large component is quadratic.
5. A task tells only which sets are joined to the least of theirs, never pairs; of groups of several blocks these labels
   are closed to components.

Nulls, empty texts and wordless texts have no set and link with nothing; a text with fewer words than the
shingle is one shingle; very long texts are scanned in pieces, and their distinct shingles are held by one
task; repeated rows are copies of one another, rows that share a doc_id count as one document, and among ties the
least doc_id names a component. A row without doc_id is known by its text (as a number of 2**62 or more): it
links like any other, but names a component only where no numbered document is in it, and then the name is null. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import textscan as ts
from engram.llm.common import Scratch, free_name, shuffle_partitions
from engram.llm.components import connected_components

GROWTH = 1.5
#: Shingles and sets of a block.
BLOCK, BLOCK_SETS = 500_000, 1024
SCAN = "kind int, doc_id long, n long, a long, b long"


def level_bounds(most: int = 1 << 40) -> np.ndarray:
    """First set size of each level: sizes grow by half from level to level."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out)


BOUNDS = level_bounds()


def most_apart(a: int, b: int, t: Fraction) -> int:
    """Elements in which sets of sizes a, b with similarity t or more can differ."""
    return int((a + b) * (1 - t) / (1 + t))


def segments(level: int, t: Fraction) -> int:
    """Segments of the level: more than linked sets of its sizes can differ in, and some to spare for empty ones.

    Small sets get so many that few of their elements share one: only full segments are emitted, so that costs no rows.
    """
    largest = int(BOUNDS[level + 1]) - 1
    least = most_apart(largest, largest, t) + 1
    return max(least + 2 + least // 8, min(8 * largest, 64))


def shingle_sets(b: np.ndarray, offsets: np.ndarray, k: int, word: np.ndarray = ts.SOLID) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted, and the offsets of the rows in them."""
    w = ts.scan(ts.LOWER[b], offsets, word)
    rows = len(offsets) - 1
    counts = np.bincount(w.docs, minlength=rows)
    within = w.within(k)
    grams, docs = w.grams(k)[within], w.docs[: len(within)][within]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):  # the whole sequence as one
        first = np.searchsorted(w.docs, short)
        more = np.array([_sequence(w.hashes[f : f + counts[r]]) for r, f in zip(short, first, strict=True)], np.uint64)
        grams, docs = np.concatenate([grams, more]), np.concatenate([docs, short])
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(rows + 1))


def _sequence(words: np.ndarray) -> int:
    out = np.array([len(words) + 7], np.uint64)
    for h in words:
        out = ts.mix(out * np.uint64(0x100000001B3) + h)
    return int(out[0])


def _signature(values: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def segment_keys(values: np.ndarray, t: Fraction) -> list[tuple[int, np.ndarray, int]]:
    """(level, a key per segment in which a linked set would have the same elements, how many of them it must share).

    Every set emits its full segments. With more of them than it can differ in from a linked set (`apart`), it
    shares all but `apart` of them with that set. Otherwise it emits its empty segments too: of two linked sets
    one has more full segments than they differ in, so a full one is shared, or neither has, and both emit all.
    """
    n = len(values)
    level = int(np.searchsorted(BOUNDS, n, side="right")) - 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(ts.mix(values), out=total[1:])
    high, out = values >> np.uint64(32), []
    for lv in (level, level + 1):
        if lv > level and n < t * int(BOUNDS[lv]):  # no partner that large
            break
        r = segments(lv, t)
        # values are sorted, so a segment is a run; its key folds all of the run
        at = np.searchsorted((high * np.uint64(r)) >> np.uint64(32), np.arange(r + 1, dtype=np.uint64))
        keys = ts.mix(total[at[1:]] - total[at[:-1]] + ts.mix(np.arange(r, dtype=np.uint64) + np.uint64(lv << 40)))
        full = at[1:] > at[:-1]
        apart = most_apart(n, min(int(BOUNDS[lv + 1]) - 1, int(n / t)), t)
        enough = int(full.sum()) - apart
        out.append((lv, keys[full], enough) if enough > 0 else (lv, keys, 1))
    return out


def _rows(kind: int, doc_id, n, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(doc_id), pa.array(n), pa.array(a), pa.array(b)], names=["kind", "doc_id", "n", "a", "b"])


def _scan_documents(k: int, t: Fraction, remembered: int = 100_000):
    """Kind 0: doc_id, set size, signature. Kind 1: level, keys to share, segment key, class. A class comes once a task."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for i, j, b, offsets in ts.chunks(batch.column(1)):
                values, at = shingle_sets(b, offsets, k)
                sizes = np.diff(at)
                sig = np.zeros((2, j - i), np.int64)
                held = []
                for r in np.flatnonzero(sizes).tolist():
                    own = values[at[r] : at[r + 1]]
                    sig[:, r] = _signature(own)
                    name = int(sig[0, r])
                    if name in seen:
                        continue
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add(name)
                    held += [(lv, need, keys, name) for lv, keys, need in segment_keys(own, t)]
                yield _rows(0, batch.column(0).slice(i, j - i), sizes.astype(np.int64), sig[0], sig[1])
                if held:
                    many = [len(x[2]) for x in held]
                    spread = lambda c: np.repeat(np.array([x[c] for x in held], np.int64), many)  # noqa: E731, B023
                    yield _rows(1, spread(0), spread(1), np.concatenate([x[2] for x in held]).view(np.int64), spread(3))

    return run


def _shared(batches):
    """Rows (a key, b class, lv, need) sorted by key and class: those of keys that two classes or more have, once each.

    Streams: only the last row of the key at hand is held, however many classes share it.
    """
    names, last, told = ["a", "b", "lv", "need"], None, False
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        if last is not None:
            rows = np.concatenate([last, rows], axis=1)
        if not rows.shape[1]:
            continue
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        rows = rows[:, new]
        heads = np.ones(rows.shape[1], bool)
        heads[1:] = rows[0, 1:] != rows[0, :-1]
        run = np.cumsum(heads) - 1
        keep = np.bincount(run)[run] > 1
        again = told and last is not None
        if again:  # the row carried over has been given out; what joins its key is shared
            keep |= run == 0
            keep[0] = False
        told = bool(keep[-1]) or (again and run[-1] == 0)
        last = rows[:, -1:]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows[:, keep]], names=names)


def _gathered(batches):
    """Rows of `SCAN` sorted by kind, a and b -> those of documents as they are, then of keys those that `_shared` gives."""
    keys = lambda batch: pa.RecordBatch.from_arrays([batch.column(c) for c in (3, 4, 1, 2)], names=["a", "b", "lv", "need"])
    batches = iter(batches)
    for batch in batches:
        own = batch.column(0).to_numpy() == 0
        yield batch.filter(pa.array(own))
        if not own.all():  # only keys follow
            for found in _shared(itertools.chain([keys(batch.filter(pa.array(~own)))], map(keys, batches))):
                a, b, lv, need = found.columns
                yield _rows(1, lv, need, a, b)


def _coarse_edges(rows: DataFrame, s: Scratch, rounds: int = 2) -> DataFrame:
    """Star edges of the keys, after leaving out classes that share fewer keys than any linked set would share with them.

    That is exact: a class with a link shares at least `need` keys with one other class. A popular passage
    leaves a document a few shared keys, far fewer than needed, so passages alone chain nobody. Of the classes left, only
    the rarest keys join: in one order of keys, the first of all that two linked classes share has less than `c - need + 1`
    of either's `c` keys before it. So texts of many common passages, each shared with others, chain nobody either.
    """
    for i in range(rounds):
        enough = rows.groupBy("b", "lv").agg(F.count("*").alias("c"), F.max("need").alias("m")).where("c >= m").select("b", "lv")
        rows = rows.join(enough, ["b", "lv"], "left_semi")
        least = rows.groupBy("a").agg(F.min("b").alias("v"), F.max("b").alias("x")).where("v < x").select("a", "v")
        rows = s.keep(rows.join(least, "a").select("a", "b", "lv", "need", "v"), f"keys-{i}")
        if i:
            s.drop(f"keys-{i - 1}")
        rows = rows.drop("v")
    # of a class its rarest keys, one more than it can do without: linked classes share at least `need`, so also one of these
    seen = rows.groupBy("a").agg(F.count("*").alias("f"))
    spare = Window.partitionBy("b", "lv")
    rows = rows.join(seen, "a").withColumn("i", F.row_number().over(spare.orderBy("f", "a"))).withColumn("c", F.count("*").over(spare))
    rows = s.keep(rows.where("i <= c - need + 1").select("a", "b"), "rare")
    s.drop(f"keys-{rounds - 1}")
    least = rows.groupBy("a").agg(F.min("b").alias("v"), F.max("b").alias("x")).where("v < x").select("a", "v")
    return rows.join(least, "a").where("b <> v").select(F.col("b").alias("u"), "v").distinct()


class PrefixTree:
    """Sets in one global element order as a radix tree, laid out in arrays.

    Runs of the tree are cut at the depths of `CUTS`, so nodes fall into slabs. In a slab all nodes below one
    node of the slab above stand together, in preorder; a probe counts its overlap with them at once and goes
    on below those that can still hold a set similar enough.
    """

    CUTS = [0] + [16 * (2**i - 1) for i in range(1, 40)]

    def __init__(self, sets: list[np.ndarray]) -> None:
        """sets: sorted int32 arrays of element ranks, none empty."""
        self.sizes = np.array([len(x) for x in sets], np.int64)
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self._nodes(sets, order)

    def _nodes(self, sets: list[np.ndarray], order: list[int]) -> None:
        start, end, parent, owner, first = [], [], [], [], []  # of a node: depths, node above, a set with its run, place in order
        ends = np.zeros(len(sets), np.int64)

        def chain(at: int, upto: int, above: int, who: int, place: int) -> int:
            while at < upto:
                stop = min(upto, self.CUTS[bisect_right(self.CUTS, at)])
                for column, value in ((start, at), (end, stop), (parent, above), (owner, who), (first, place)):
                    column.append(value)
                above, at = len(start) - 1, stop
                path.append(above)
            return above

        path, before = [], np.zeros(0, np.int32)
        for place, who in enumerate(order):
            own = sets[who]
            m = min(len(own), len(before))
            apart = np.flatnonzero(own[:m] != before[:m])
            shared = int(apart[0]) if len(apart) else m
            while path and start[path[-1]] >= shared:
                path.pop()
            if path and end[path[-1]] > shared:  # split: a new node takes the upper part of the run
                low = path.pop()
                for column, value in ((start, start[low]), (end, shared), (parent, parent[low]), (owner, owner[low]), (first, first[low])):
                    column.append(value)
                parent[low], start[low] = len(start) - 1, shared
                path.append(len(start) - 1)
            ends[who] = chain(shared, len(own), path[-1] if path else -1, who, place)
            before = own
        start, end, parent, first = (np.array(x, np.int64) for x in (start, end, parent, first))
        slab = np.searchsorted(np.array(self.CUTS), start, side="right") - 1
        seq = np.lexsort((start, first, slab))  # by slab, then in preorder
        name = np.empty(len(seq), np.int64)
        name[seq] = np.arange(len(seq))
        self.start, self.end, self.slab = start[seq], end[seq], slab[seq]
        self.parent = np.where(parent[seq] < 0, -1, name[parent[seq]])
        runs = [sets[owner[i]][s:e] for i, s, e in zip(seq.tolist(), self.start.tolist(), self.end.tolist(), strict=True)]
        self.flat = np.concatenate(runs).astype(np.int64) if runs else np.zeros(0, np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.end - self.start)])
        self.last = self.flat[self.at[1:] - 1]
        own = name[ends]
        self.lo, self.hi = np.full(len(seq), 1 << 60), np.zeros(len(seq), np.int64)
        np.minimum.at(self.lo, own, self.sizes)
        np.maximum.at(self.hi, own, self.sizes)
        lo, hi, up = self.lo.tolist(), self.hi.tolist(), self.parent.tolist()
        for i in range(len(seq) - 1, -1, -1):  # deeper slabs come later, and children after parents
            if (p := up[i]) >= 0:
                lo[p], hi[p] = min(lo[p], lo[i]), max(hi[p], hi[i])
        self.lo, self.hi = np.array(lo, np.int64), np.array(hi, np.int64)
        self.ends = np.argsort(own, kind="stable")  # sets by the node they end at
        self.ends_at = np.searchsorted(own[self.ends], np.arange(len(seq) + 1))
        # what stands together: the nodes from one that begins at a cut up to the next such
        heads = np.flatnonzero(self.start == np.array(self.CUTS)[self.slab])
        self.heads, self.tails = heads, np.append(heads[1:], len(seq))
        self.above = self.parent[heads]
        self.by_slab = np.searchsorted(self.slab[heads], np.arange(int(self.slab.max(initial=-1)) + 2))
        # a walk through the nodes of each piece: +node on the way down, -node on the way up
        nodes, signs, entered = [], [], []
        for h, t in zip(heads.tolist(), self.tails.tolist(), strict=True):
            path = []
            for i in range(h, t):
                while path and path[-1] != up[i]:
                    nodes.append(path.pop())
                    signs.append(-1)
                entered.append(len(nodes))
                nodes.append(i)
                signs.append(1)
                path.append(i)
            nodes += reversed(path)
            signs += [-1] * len(path)
        self.step_node, self.step_sign, self.entered = (np.array(x, np.int64) for x in (nodes, signs, entered))
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, np.int8)
        # by node (and step); a probe reads only what it wrote, and 0 above the root
        self._shared, self._live, self._own, self._walk = np.zeros(len(seq) + 1, np.int64), np.zeros(len(seq), bool), np.zeros(len(seq), np.int64), np.zeros(2 * len(seq), np.int64)

    def probe(self, bag: np.ndarray, t: Fraction, most: int = 1 << 60) -> np.ndarray:
        """Sets x of at most `most` elements with |x & bag| >= t * |x | bag|. bag: sorted ranks; unknown elements match nothing."""
        num, den = t.numerator, t.denominator
        n, found = len(bag), []
        known = bag[: np.searchsorted(bag, len(self.mark))]
        self.mark[known] = 1
        shared, live = self._shared, self._live
        live[:] = False
        for j in range(len(self.by_slab) - 1):
            a, b = self.by_slab[j], self.by_slab[j + 1]
            pieces = np.arange(a, b)
            if j:
                pieces = pieces[live[self.above[a:b]]]
            if not len(pieces):
                break
            heads, tails = self.heads[pieces], self.tails[pieces]
            if len(pieces) == b - a:  # all of the slab
                nodes, steps, runs = np.arange(heads[0], tails[-1]), slice(2 * heads[0], 2 * tails[-1]), slice(self.at[heads[0]], self.at[tails[-1]])
            else:
                nodes, steps, runs = _spans(heads, tails), _spans(2 * heads, 2 * tails), _spans(self.at[heads], self.at[tails])
            runs = self.mark[self.flat[runs]]
            lengths = self.end[nodes] - self.start[nodes]
            self._own[nodes] = np.add.reduceat(runs, np.cumsum(lengths) - lengths, dtype=np.int64)
            # the walk of each piece ends at 0, so one running sum serves them all
            self._walk[steps] = np.cumsum(self._own[self.step_node[steps]] * self.step_sign[steps])
            here = np.repeat(shared[self.above[pieces]], tails - heads) + self._walk[self.entered[nodes]]
            shared[nodes] = here
            lo, hi = self.ends_at[nodes], self.ends_at[nodes + 1]
            sets = self.ends[_spans(lo, hi)]
            if len(sets):
                s, z = np.repeat(here, hi - lo), self.sizes[sets]
                found.append(sets[(s * den >= num * (n + z - s)) & (z <= most)])
            if j + 2 < len(self.by_slab):
                # a set of z elements below overlaps in here + min(rest, z - depth) at most: best at z = depth + rest
                rest, depth = n - np.searchsorted(bag, self.last[nodes], side="right"), self.end[nodes]
                z = np.clip(depth + rest, self.lo[nodes], self.hi[nodes])
                live[nodes] = ((here + np.minimum(rest, z - depth)) * (num + den) >= num * (n + z)) & (self.lo[nodes] <= most)
        self.mark[known] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges start..stop, one after another."""
    n = stops - starts
    total = int(n.sum())
    out = np.ones(total, np.int64)
    full = np.flatnonzero(n)
    if not len(full):
        return np.zeros(0, np.int64)
    starts, n = starts[full], n[full]
    out[0] = starts[0]
    out[np.cumsum(n)[:-1]] = starts[1:] - (starts[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def tree_links(own: list[np.ndarray], others: list[np.ndarray] | None, t: Fraction, labels: list | None = None) -> np.ndarray:
    """Which sets links join, among `own` or between `own` and `others` (numbered after them): a number per set.

    `labels`: of every set, the component it is known to be in; sets of one label are joined to begin with.
    """
    sets = own + (others or [])
    comp = np.arange(len(sets)) if labels is None else np.unique(np.array(labels), return_inverse=True)[1]
    every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    freq = np.bincount(inverse)
    rank = np.empty(len(every), np.int32)
    rank[np.lexsort((every, -freq))] = np.arange(len(every))
    ranked = rank[inverse]
    at = np.cumsum([0, *map(len, sets)])
    ordered = [np.sort(ranked[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    tree = PrefixTree(ordered[: len(own)])
    for x in range(len(own), len(sets)) if others is not None else range(len(own)):
        for y in _strange(comp, x, tree.probe(ordered[x], t, 1 << 60 if others is not None else len(ordered[x]))):
            comp[comp == comp[y]] = comp[x]
    return comp


def _strange(comp: np.ndarray, x: int, found: np.ndarray) -> list[int]:
    """One set of every component among `found` but that of x."""
    found = found[comp[found] != comp[x]]
    return found[np.unique(comp[found], return_index=True)[1]].tolist() if len(found) else []


def _unit_links(t: Fraction):
    """Rows (unit, side, cls, label, elements) sorted by unit -> (u, v): of labels that links join, each with the least of
    them. One unit is held at a time."""

    def solve(rows):
        rows.sort(key=lambda r: (r[0], r[1]))
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        n = sum(r[0] == 0 for r in rows)
        if n == 0 or len(rows) < 2:
            return None
        labels = np.array([r[2] for r in rows], np.int64)
        comp = tree_links(sets[:n], sets[n:] or None, t, labels)
        least = np.full(int(comp.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, comp, labels)
        star = np.unique(np.stack([labels, least[comp]])[:, labels != least[comp]], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(star[0]), pa.array(star[1])], names=["u", "v"]) if star.shape[1] else None

    def run(batches):
        unit, rows = None, []
        for batch in batches:
            units = batch.column(0).to_pylist()
            sides, names, labels, bags = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            for i, u in enumerate(units):
                if u != unit:
                    if (found := solve(rows)) is not None:
                        yield found
                    unit, rows = u, []
                rows.append((sides[i], names[i], labels[i], bags[i].as_py()))
        if (found := solve(rows)) is not None:
            yield found

    return run


def _element_sets(k: int):
    def run(batches):
        for batch in batches:
            rest = [batch.column(c) for c in range(batch.num_columns) if c != 1]
            names = [batch.schema.names[c] for c in range(batch.num_columns) if c != 1]
            for i, j, b, offsets in ts.chunks(batch.column(1)):
                values, at = shingle_sets(b, offsets, k)
                bags = pa.array([values[at[r] : at[r + 1]].tobytes() for r in range(j - i)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in rest), bags], names=[*names, "elements"])

    return run


#: Names of rows without doc_id begin here.
NAMELESS = 1 << 62
UNIT_LINKS = "u long, v long"


def _named(documents: DataFrame):
    """doc_id, or a number of `NAMELESS` or more that stands for the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).bitwiseAND(NAMELESS - 1).bitwiseOR(NAMELESS))


def jaccard_components(documents: DataFrame, k: int = 5, threshold: str = "0.8", block: int = BLOCK, block_sets: int = BLOCK_SETS, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, component_id (least doc_id that links of `threshold` reach).

    Runs eagerly; the frame returned reads scratch tables. `block`, `block_sets`: shingles and sets of a block; a task joins two at once.
    `broadcast_rows`: the largest table (two longs a row) that is broadcast to pick texts; beyond, a shuffle join.
    """
    found = _components(documents.select(_named(documents).alias("doc_id"), "text"), k, threshold, block, block_sets, broadcast_rows)
    number = lambda c: F.when(F.col(c) < NAMELESS, F.col(c)).alias(c)
    return found.select(number("doc_id"), "n_shingles", number("component_id"))


def _components(documents: DataFrame, k: int, threshold: str, block: int, block_sets: int, broadcast_rows: int) -> DataFrame:
    """The same for rows that all have a doc_id."""
    spark = documents.sparkSession
    t = Fraction(threshold)
    if not 1 / GROWTH < t <= 1:
        raise ValueError(f"the threshold must lie between {1 / GROWTH:.2f} and 1")  # a link spans two levels at most
    s = Scratch(spark, "jaccard")
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    parts = shuffle_partitions(spark)
    # keys go from the scan right into one shuffle, which leaves out those that one class alone has before anything is written
    dealt = docs.mapInArrow(_scan_documents(k, t), SCAN).repartition(parts, F.expr("if(kind = 0, doc_id, a)")).sortWithinPartitions("kind", "a", "b")
    scanned = s.keep(dealt.mapInArrow(_gathered, SCAN), "scan", partition_by="kind")
    sized = scanned.where("kind = 0").select("doc_id", "n", "a", "b")

    # classes of equal sets; `a` names a class in the coarse stage, where a clash of names only widens a group
    classes = s.keep(sized.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "classes")
    met = scanned.where("kind = 1").select("a", "b", F.col("doc_id").alias("lv"), F.col("n").alias("need"))
    coarse = connected_components(_coarse_edges(met, s), s, "coarse")
    s.drop("scan/kind=1")  # read for the last time

    member = coarse.withColumnRenamed("vertex", "a").join(classes, "a")
    blocks = F.ceil(F.greatest(F.sum("n") / F.lit(block), F.count("*") / F.lit(block_sets))).cast("int")
    involved = s.keep(member.join(member.groupBy("root").agg(blocks.alias("g")), "root").select("rep", F.struct("root", "g").alias("c")), "involved")
    small = involved.count() <= broadcast_rows
    chosen = (F.broadcast(involved) if small else involved).withColumnRenamed("rep", "doc_id")
    # rows that share a doc_id count as one document here, whatever their texts
    sets = s.keep(docs.join(chosen, "doc_id").select("doc_id", "text", "c.*").mapInArrow(_element_sets(k), "doc_id long, root long, g int, elements binary"), "sets")
    s.drop("involved")
    named = s.keep(_group_links(sets, s, t, block, block_sets, parts).distinct(), "named")
    s.drop("sets")
    if named.count() != named.select("vertex").distinct().count():  # a doc_id with several texts lies in several groups
        named = connected_components(named.select(F.col("vertex").alias("u"), F.col("root").alias("v")), s, "final")
    label = classes.join(named.withColumnRenamed("vertex", "rep"), "rep", "left").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("root", "rep").alias("component"))
    out = sized.join(label, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _bucket(n: str):
    return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")


def _group_links(sets: DataFrame, s: Scratch, t: Fraction, block: int, block_sets: int, parts: int) -> DataFrame:
    """sets: doc_id, root (its coarse group), g (blocks of the group), elements -> (vertex, root): each set that has a link, or
    lies in a group of several blocks, with the least set that links reach.

    A group of one block is settled by its unit. Larger groups go on with labels, one per component found so far.
    """

    def solved(units: DataFrame, name: str) -> DataFrame:
        """units: unit, side, doc_id, label, elements -> (u, v): labels and the least label that they are joined with."""
        dealt = units.select("unit", "side", "doc_id", "label", "elements").repartition(parts, "unit").sortWithinPartitions("unit")
        return s.keep(dealt.mapInArrow(_unit_links(t), UNIT_LINKS), name)

    def renamed(known: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """known, with labels replaced by the least that `links` reach."""
        if links.isEmpty():
            return known
        found = connected_components(links, s, name).select(F.col("vertex").alias("label"), F.col("root").alias("new"))
        return s.keep(known.join(found, "label", "left").withColumn("label", F.coalesce("new", "label")).drop("new"), f"{name}-labels")

    unit = lambda *c: F.concat_ws("/", *c).alias("unit")
    first = solved(sets.select(unit("root", _bucket("g")), F.lit(0).alias("side"), "doc_id", F.col("doc_id").alias("label"), "elements"), "links-1")
    settled = first.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    many = sets.where("g > 1").withColumn("size", F.expr("cast(length(elements) div 8 as long)"))
    if many.isEmpty():
        return settled
    blocks = F.ceil(F.greatest(F.sum("size") / F.lit(block), F.count("*") / F.lit(block_sets))).cast("int")
    known = many.select("doc_id", "root", "g", "size").join(first.select(F.col("u").alias("doc_id"), F.col("v").alias("label")), "doc_id", "left")
    known = s.keep(known.withColumn("label", F.coalesce("label", "doc_id")), "labels")

    # a few sets of every component of a group, against one another
    few = known.groupBy("root", "label", F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("i")).agg(F.min(F.struct("doc_id", "size")).alias("x")).select("root", "label", "x.*")
    few = few.join(few.groupBy("root").agg(blocks.alias("h")), "root")
    heads = many.select("doc_id", "elements").join(few, "doc_id").select(unit("root", _bucket("h")), F.lit(0).alias("side"), "doc_id", "label", "elements")
    known = renamed(known, solved(heads, "links-2"), "heads")

    # the sets outside their group's largest component, against all sets of the group
    size = known.groupBy("root", "label").agg(F.count("*").alias("c"))
    largest = size.groupBy("root").agg(F.max(F.struct("c", "label")).alias("m")).select("root", F.col("m.label").alias("largest"))
    told = known.join(largest, "root")
    outside = told.where("label <> largest").groupBy("root").agg(blocks.alias("h"))
    placed = many.select("doc_id", "elements").join(told.join(outside, "root"), "doc_id").withColumn("stray", F.when(F.col("label") != F.col("largest"), _bucket("h")))
    # in rounds, as the sets of a group are written once for every block of strays that they meet: a round writes about twice what all sets take
    most = outside.agg(F.max("h")).first()[0] or 0
    large, of_all = many.agg(F.sum("size")).first()[0], sets.agg(F.sum(F.length("elements"))).first()[0] // 8
    at_once, links = max(1, of_all // large), first.where("false")
    for i in range(0, most, at_once):
        every = placed.where(F.col("h") > i).select("*", F.explode(F.sequence(F.lit(i), F.least("h", F.lit(i + at_once)) - 1)).alias("j")).select(unit("root", _bucket("g"), "j"), F.lit(0).alias("side"), "doc_id", "label", "elements")
        strays = placed.where((F.col("stray") >= i) & (F.col("stray") < i + at_once)).select("*", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("i"))
        strays = strays.select(unit("root", "i", "stray"), F.lit(1).alias("side"), "doc_id", "label", "elements")
        links = links.unionByName(solved(every.unionByName(strays), f"links-3-{i}"))
    known = renamed(known, links, "strays")
    single = settled.join(known.select(F.col("doc_id").alias("vertex")), "vertex", "left_anti")
    return single.unionByName(known.select(F.col("doc_id").alias("vertex"), F.col("label").alias("root")))


def one_of_each(documents: DataFrame, k: int = 5, threshold: str = "0.8", broadcast_rows: int = 500_000) -> DataFrame:
    """Keeps the document of least doc_id of each component, once. Only ids are shuffled, up to `broadcast_rows` of them.

    Rows of one doc_id count as one document, of which the row of least text stays. A row without doc_id is
    known by its text, so equal ones count as one document, and a numbered copy stays rather than they.
    """
    s = Scratch(documents.sparkSession, "one-of-each")
    name = free_name(documents.columns, "_document")
    docs = documents.withColumn(name, _named(documents))
    found = _components(docs.select(F.col(name).alias("doc_id"), "text"), k, threshold, BLOCK, BLOCK_SETS, broadcast_rows)
    rows = found.groupBy("doc_id").agg(F.max(F.expr("doc_id = component_id")).alias("leads"), F.count("*").alias("rows"))
    fate = s.keep(rows.where("not leads or rows > 1").select(F.col("doc_id").alias(name), "leads"), "fate")
    few = fate.count() <= broadcast_rows
    hint = F.broadcast if few else (lambda df: df)
    once = docs.join(hint(fate.select(name)), name, "left_anti").drop(name)
    if fate.where("leads").isEmpty():
        return once
    repeated = docs.join(hint(fate.where("leads").select(name)), name, "left_semi")
    one = repeated.groupBy(name).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), F.coalesce("text", F.lit(""))).alias("r"))
    return once.unionByName(one.select("r.*"))


def op7_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return jaccard_components(table(spark, sf_dir, "documents"), k=3, threshold="0.9")
