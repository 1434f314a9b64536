"""URL filters by a cascade of Bloom filters, in DataFrame operations only.

The key universe of a corpus is known: every (host suffix, path beginning) of a shape that the rules use, over
all its urls. Level 1 encodes the listed keys; level 2 the keys of the universe that level 1 lets through
wrongly; level 3 the listed ones that level 2 lets through, and so on until none is left. The first level that
says no settles a key, so membership is exact over the universe. Filters are arrays of 64-bit words that
reach the scan as constants: urls are judged without a join. Level 1 is sized by the universe as well: a listed key gets
1.44 bits for each doubling of the universe over the list (what exact membership needs at least), so that some half as many
false positives as listed keys are left, however large the universe, and all levels together stay below
`bits_per_key` bits for each listed key.

A url's keys are tried longest first, so the longest rule decides; without one the verdict is `allow`; a rule in both
lists allows. Lists whose filters would pass `most_bytes` are dealt by a hash of the key over several passes, each with a
cascade of bounded size, all its levels counted; a url keeps the longest rule of all passes.

Null urls and urls without `://` have an empty host and path and fit no rule; very long urls are judged whole; repeated
rows each get their verdict; other columns are ignored; an empty table or an empty list gives no rule.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Scratch

#: The contract's rules: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LATER_BITS = 8  # a key, from level 2 on
MOST_HASHES = 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lowered, and path after it; empty where there is none."""
    host = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(host, path)


KEY = "struct<n:int,own:int,key:string>"


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Keys of a url of the given shapes (labels of the host, characters of the path), longest first: structs of `KEY`."""
    if not shapes:
        return F.array().cast(f"array<{KEY}>")
    listed = F.from_json(F.lit(json.dumps([{"l": a, "p": b} for a, b in shapes])), "array<struct<l:int,p:int>>")
    fits = F.filter(listed, lambda s: (F.size(F.split(host, r"\.")) >= s["l"]) & (F.length(path) >= s["p"]) & (host != ""))

    def key(s: Column) -> Column:
        suffix = F.call_function("substring_index", host, F.lit("."), -s["l"])
        whole = rule_key(suffix, F.substr(path, F.lit(1), s["p"]))
        return F.struct(F.length(whole).alias("n"), F.length(suffix).alias("own"), whole.alias("key"))

    return F.reverse(F.array_sort(F.transform(fits, key)))


def first_bits(listed: int, universe: int) -> float:
    """Bits of a listed key on level 1."""
    return max(LATER_BITS, 1.44 * (1 + math.log2(max(1.0, universe / max(1, listed)))))


def bits_per_key(listed: int, universe: int) -> float:
    """Bits of a listed key on all levels: at most half as many false positives are left, of which level 2 lets some 2 % through."""
    return first_bits(listed, universe) + LATER_BITS


def hashes_of(bits: float) -> int:
    """How many hashes serve a filter of so many bits a key best."""
    return max(1, min(MOST_HASHES, round(0.69 * bits)))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key on a level: double hashing with hashes of the level's own."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits)) for i in range(2))
    return [(a + b * F.lit(i)) % F.lit(bits) for i in range(hashes)]


def build_filter(keys: DataFrame, level: int, n: int, per_key: float) -> tuple[DataFrame, int]:
    """A frame with the filter of the keys as one array of longs, and its size in bits."""
    words = max(1, math.ceil(n * per_key / 64))
    bits = words * 64
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes_of(per_key)))).alias("p"))
    set_words = at.groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    dense = set_words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("long")))
    return dense.select(array.alias("bits")), bits


def _says_yes(key: Column, array: Column, level: int, bits: int, hashes: int) -> Column:
    """Whether all bits of the key are set. The filter stands in the expression once."""
    bit = lambda p: F.call_function("bit_get", F.element_at(array, (F.floor(p / 64) + 1).cast("int")), (p % 64).cast("int"))
    return F.forall(F.array(*_positions(key, level, bits, hashes)), lambda p: bit(p) == 1)


def _constant(words: list[int]) -> Column:
    return F.array(*[F.lit(w).cast("long") for w in words]) if len(words) <= 64 else F.from_json(F.lit(str(words)), "array<long>")


class Cascade:
    """Levels as (words of the filter, bits, hashes); `member(key)` is a column, exact for keys of the universe."""

    def __init__(self, levels: list[tuple[list[int], int, int]]) -> None:
        self.levels = levels

    @property
    def bytes(self) -> int:
        return sum(8 * len(w) for w, _, _ in self.levels)

    def member(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            words, bits, hashes = self.levels[i]
            out = F.when(~_says_yes(key, _constant(words), i + 1, bits, hashes), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: (key). Only filters reach the driver; keys never do.

    From level 2 on a level lets some 2 % of the other side through, so few levels are needed: each hashes anew.
    """
    s = Scratch(listed.sparkSession, "cascade")
    keys = listed.where("key is not null").select("key", F.lit(1).alias("l")).unionByName(universe.where("key is not null").select("key", F.lit(0).alias("l")))
    tagged = s.keep(keys.groupBy("key").agg(F.max("l").alias("l")), "level-0")
    inside, outside = tagged.where("l = 1"), tagged.where("l = 0")
    n, levels = inside.count(), []
    per_key = first_bits(n, outside.count()) if n else 0
    while n:
        level = len(levels) + 1
        frame, bits = build_filter(inside, level, n, per_key)
        words, hashes = list(frame.first()["bits"]), hashes_of(per_key)
        levels.append((words, bits, hashes))
        inside, outside = outside.where(_says_yes(F.col("key"), _constant(words), level, bits, hashes)), inside
        per_key = LATER_BITS
        inside = s.keep(inside, f"level-{level}")
        n = inside.count()
    s.drop(*(f"level-{i}" for i in range(len(levels) + 1)))
    return Cascade(levels)


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", most_bytes: int = 4 << 20) -> DataFrame:
    """pages: page_id, url; rules: verdict (block or allow), host, path -> page_id, host, path, rule, verdict.

    Two cascades, one per verdict, of some `most_bytes` together; longer lists take more passes.
    """
    listed = rules.select("verdict", rule_key(F.col("host"), F.col("path")).alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n"))
    shapes = sorted((r.labels, r.n) for r in listed.select("labels", "n").distinct().collect())  # labels of a name times path lengths
    n = listed.count()
    passes = max(1, math.ceil(n * bits_per_key(n, pages.count() * len(shapes)) / 8 / most_bytes))  # a url has at most a key of each shape
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.lit(None).cast("struct<n:int,own:int,key:string,allow:boolean,block:boolean>").alias("best"))
    s = Scratch(pages.sparkSession, "urls")
    for i in range(passes):
        mine = lambda key: F.pmod(F.xxhash64(key, F.lit("pass")), F.lit(passes)) == i  # noqa: B023, E731
        keys = candidate_keys(F.col("host"), F.col("path"), shapes)
        keys = F.filter(keys, lambda x: mine(x["key"])) if passes > 1 else keys  # noqa: B023
        universe = base.select(F.explode(F.transform(keys, lambda x: x["key"])).alias("key"))
        allow, block = (build_cascade(listed.where((F.col("verdict") == v) & mine(F.col("key"))).select("key"), universe) for v in ("allow", "block"))
        judged = F.transform(keys, lambda x: F.struct(x["n"].alias("n"), x["own"].alias("own"), x["key"].alias("key"), allow.member(x["key"]).alias("allow"), block.member(x["key"]).alias("block")))  # noqa: B023
        first = F.try_element_at(F.filter(judged, lambda x: x["allow"] | x["block"]), F.lit(1))
        base = base.withColumn("best", F.greatest("best", first) if passes > 1 else first)
        if passes > 1:
            base = s.keep(base, f"pass-{i}")
            s.drop(f"pass-{i - 1}")
    verdict = F.when(F.col("best").isNull(), F.lit(otherwise)).when(F.col("best.allow"), F.lit("allow")).otherwise(F.lit("block"))
    return base.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + " AS rules(verdict, host, path)")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
