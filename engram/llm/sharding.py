"""Sharding by balanced label propagation, in DataFrame operations only.

Documents that belong together meet in a hub (here: equal texts). Every document starts on a shard by its id;
then, round by round, each hub looks at how many of its members each shard holds (its neighbours' labels,
counted) and moves the others to the fullest shard that has room; rows that have moved stay. A quota per shard, filled in order of hub
size through a join with the running sums of earlier proposals, keeps every shard at or below its target.
Members of a hub are interchangeable, so the state is one row per hub with a count per shard, not one per
link: a hub of a third of all rows is one row, and no pair of copies is ever made. Documents without a
neighbour fill up what is left, so shard sizes come out exact.

Law `rows`: shard sizes differ by one row at most. A hub larger than a shard is split over as few as there is room
on. A null text has no neighbour; equal texts, empty ones included, are one hub; repeated rows are copies;
a null doc_id is placed like any other row; of shards that tie for a hub, a hash of both decides; only hashes of texts are shuffled, however long the texts are; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import Scratch, salt, salts

KEY = ["h", "c"]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0).cast("long"))


def _propose(hubs: DataFrame, room: list[int], targets: list[int], phase: str) -> DataFrame:
    """Where each hub's loose rows would go: to the shard with room that holds most of its members.

    Hubs larger than a shard go first and may be split (phase `large`), then hubs move as a whole (`whole`);
    what fits nowhere as a whole is split in the end (`rest`).
    """
    shards = range(len(room))
    large = F.col("n") > F.lit(min(targets))
    order = [F.struct(F.when(F.lit(room[s] > 0), F.col(f"c{s}") + F.col(f"p{s}")).otherwise(F.lit(-1).cast("long")).alias("v"), F.pmod(F.xxhash64("h", F.lit(s)), F.lit(1 << 20)).alias("tie"), F.lit(s).alias("s")) for s in shards]
    best = F.greatest(*order)["s"] if len(room) > 1 else F.lit(0)
    out = hubs.withColumn("move", _sum([F.col(f"c{s}") for s in shards])).where("move > 0")
    out = out.where(large) if phase == "large" else out
    return out.withColumn("to", best).withColumn("split", large | F.lit(phase == "rest"))


def _accept(moves: DataFrame, room: list[int], buckets: int) -> DataFrame:
    """Rows each proposal may move: proposals to a shard are served largest hubs first until its room is used.

    The running sum has two levels (bucket totals, then rows of a bucket), so no task sees all proposals.
    """
    rank = F.lit(63) - F.floor(F.log2("n")).cast("int")
    moves = moves.withColumn("bucket", (rank * buckets + F.pmod(F.xxhash64(*KEY, F.lit("bucket")), F.lit(buckets))).cast("int"))
    before = Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = moves.groupBy("to", "bucket").agg(F.sum("move").alias("t")).select("to", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("to", "bucket").orderBy(F.desc("n"), *KEY).rowsBetween(Window.unboundedPreceding, -1)
    summed = moves.withColumn("inside", F.coalesce(F.sum("move").over(inner), F.lit(0))).join(totals, ["to", "bucket"])
    rooms = F.array(*[F.lit(r).cast("long") for r in room])
    left = F.element_at(rooms, F.col("to") + 1) - F.col("base") - F.col("inside")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("move"), left))
    return summed.withColumn("take", F.when(F.col("split") | (left >= F.col("move")), part).otherwise(F.lit(0).cast("long"))).where("take > 0")


def _moved(hubs: DataFrame, accepted: DataFrame, shards: int) -> DataFrame:
    """Applies accepted moves: rows that are on the shard already settle first, then others in order."""
    now = hubs.join(accepted.select(*KEY, "to", "take"), KEY, "left")
    own = [F.when(F.col("to") == s, F.least(F.col(f"c{s}"), F.col("take"))).otherwise(F.lit(0)) for s in range(shards)]
    now = now.withColumn("rest", F.coalesce(F.col("take") - _sum(own), F.lit(0)))
    ahead, loose = F.lit(0).cast("long"), []
    for s in range(shards):
        there = F.when(F.col("to") == s, F.lit(0)).otherwise(F.col(f"c{s}"))
        gone = F.greatest(F.lit(0), F.least(there, F.col("rest") - ahead)) + own[s]
        loose.append((F.col(f"c{s}") - F.coalesce(gone, F.lit(0))).cast("long").alias(f"c{s}"))
        ahead = ahead + there
    placed = [(F.col(f"p{s}") + F.when(F.col("to") == s, F.col("take")).otherwise(F.lit(0))).cast("long").alias(f"p{s}") for s in range(shards)]
    return now.select(*KEY, "n", *loose, *placed)


def propagate(members: DataFrame, targets: list[int], scratch: Scratch, rounds: int = 16) -> DataFrame:
    """members: (h, c, label) of linked rows -> per hub p0..p7 rows by shard, no shard above its target."""
    shards = len(targets)
    labels = [F.count(F.when(F.col("label") == s, 1)).alias(f"c{s}") for s in range(shards)]
    zero = [F.lit(0).cast("long").alias(f"p{s}") for s in range(shards)]
    hubs = scratch.keep(members.groupBy(*KEY).agg(F.count("*").alias("n"), *labels).where("n > 1").select("*", *zero), "hubs-0")
    buckets = max(16, hubs.count() // 20_000)
    loose = _sum([F.col(f"c{s}") for s in range(shards)])
    phase, i, left = "large", 0, rounds
    while True:
        seen = hubs.agg(F.coalesce(F.sum(loose), F.lit(0)).alias("loose"), F.coalesce(F.sum(F.when(F.col("n") > min(targets), loose)), F.lit(0)).alias("large"), *[F.coalesce(F.sum(f"p{s}"), F.lit(0)).alias(f"p{s}") for s in range(shards)]).first()
        if not seen.loose:
            return hubs
        room = [targets[s] - seen[f"p{s}"] for s in range(shards)]
        if phase == "large" and not seen.large:
            phase = "whole"
        if phase == "whole" and left == 0:
            phase = "rest"
        i, left = i + 1, left - (phase == "whole")
        accepted = scratch.keep(_accept(_propose(hubs, room, targets, phase), room, buckets), f"moves-{i}")
        if phase == "whole" and accepted.isEmpty():
            left = 0
        hubs = scratch.keep(_moved(hubs, accepted, shards), f"hubs-{i}")
        scratch.drop(f"hubs-{i - 1}", f"moves-{i}")


def _offsets(counts: DataFrame, by: list[str], within: str) -> DataFrame:
    """Rows before each sub-bucket of a key, from its (key, sub-bucket, k) counts."""
    before = Window.partitionBy(*by).orderBy(within).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, within, F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))


def shard_documents(documents: DataFrame, shards: int = 8, rounds: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; see the module's text."""
    spark = documents.sparkSession
    s = Scratch(spark, "shards")
    data = F.col("text").cast("string").cast("binary")
    base = s.keep(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(F.col("text")), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(data).alias("text_crc32"),
            F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"),
            F.coalesce(F.crc32(data), F.lit(-1)).alias("c"),
            F.col("text").isNull().alias("alone"),
        ),
        "base",
    )
    total = base.count()
    targets = [total // shards + (i < total % shards) for i in range(shards)]
    n_salts = salts(total)
    rows = base.withColumn("salt", salt("doc_id", n_salts))
    start = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("start")), F.lit(shards)).cast("int")
    linked = rows.where("not alone").select(*KEY, start.alias("label"))
    hubs = propagate(linked, targets, s, rounds)
    sums = hubs.agg(*[F.coalesce(F.sum(f"p{i}"), F.lit(0)).alias(f"p{i}") for i in range(shards)]).first()
    # rows of a hub are numbered through its sub-buckets; number r goes to the shard whose share holds r
    free = [targets[i] - sums[f"p{i}"] for i in range(shards)]
    shares = hubs.select(*KEY, "n", *[f"p{i}" for i in range(shards)])
    counted = rows.where("not alone").groupBy(*KEY, "salt").agg(F.count("*").alias("k"))
    where = counted.join(shares, KEY, "left")
    placed = _offsets(where.where("n is not null").select(*KEY, "salt", "k"), KEY, "salt").join(shares, KEY)
    # what has no neighbour is one pseudo-hub, whose shares are the room that is left
    lone_counts = where.where("n is null").groupBy("salt").agg(F.sum("k").alias("k")).unionByName(rows.where("alone").groupBy("salt").agg(F.count("*").alias("k"))).groupBy("salt").agg(F.sum("k").alias("k"))
    lone = _offsets(lone_counts.withColumn("one", F.lit(1)), ["one"], "salt").select("salt", F.col("base").alias("lone_base"))
    tagged = rows.join(placed, [*KEY, "salt"], "left").withColumn("lone", F.col("alone") | F.col("n").isNull())
    tagged = tagged.join(F.broadcast(lone) if n_salts <= 100_000 else lone, "salt", "left")
    group = [F.when(F.col("lone"), F.lit(0)).otherwise(F.col("h")), F.when(F.col("lone"), F.lit(-2)).otherwise(F.col("c")), F.col("salt")]
    number = F.row_number().over(Window.partitionBy(*group).orderBy("doc_id", "h", "c")) - 1
    tagged = tagged.withColumn("r", number + F.when(F.col("lone"), F.col("lone_base")).otherwise(F.col("base")))
    place, upto = F.lit(shards - 1), [F.lit(0).cast("long")]
    for i in range(shards):
        upto.append(upto[-1] + F.when(F.col("lone"), F.lit(free[i])).otherwise(F.col(f"p{i}")))
    for i in reversed(range(shards - 1)):
        place = F.when(F.col("r") < upto[i + 1], F.lit(i)).otherwise(place)
    put = s.keep(tagged.select("doc_id", "size", "text_crc32", "salt", place.cast("int").alias("shard"), "h"), "placed")
    base_of = _offsets(put.groupBy("shard", "salt").agg(F.count("*").alias("k")), ["shard"], "salt")
    slot = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "h")) - 1
    out = put.withColumn("within", slot).join(base_of, ["shard", "salt"])
    s.drop("base")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("within") + F.col("base")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    from engram.llm.common import table

    return shard_documents(table(spark, sf_dir, "documents"))
