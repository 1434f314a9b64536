"""Dates in questions by hand, and the stateful stream against the batch."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.functions import expr as X
from engram.operators import analysis, ingest
from engram.sources import tables as T
from engram.streaming import materialise

#: A Wednesday.
NOW = "2024-03-13 10:30:00"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("on 2024-01-05 and 2023/2/7", ["2024-01-05 00:00", "2023-02-07 00:00"]),
        ("March 3rd, 2023 or 4 of May 2022", ["2023-03-03 00:00", "2022-05-04 00:00"]),
        ("from March 12 to 20 March", ["2024-03-12 00:00", "2023-03-20 00:00"]),
        ("February 30, 2024 is no day", []),
        ("in March, since december, next May", ["2024-03-13 00:00", "2023-12-13 00:00", "2024-05-13 00:00"]),
        ("February 2023", ["2023-02-13 00:00"]),
        ("last Monday, on Wednesday, next friday, next Wednesday, Tuesday", ["2024-03-11 00:00", "2024-03-06 00:00", "2024-03-15 00:00", "2024-03-20 00:00", "2024-03-12 00:00"]),
        ("3 days ago, two weeks ago, 1 month ago, five years ago, 90 minutes ago", ["2024-03-10 10:30", "2024-02-28 10:30", "2024-02-13 10:30", "2019-03-13 10:30", "2024-03-13 09:00"]),
        ("in 2 days or in three months", ["2024-03-15 10:30", "2024-06-13 10:30"]),
        ("last week and next year", ["2024-03-06 10:30", "2025-03-13 10:30"]),
        ("the beginning of this year, end of last month, start of next week, end of the week", ["2024-01-01 00:00", "2024-02-29 00:00", "2024-03-18 00:00", "2024-03-17 00:00"]),
        ("the day before yesterday, yesterday, today, tomorrow, day after tomorrow", ["2024-03-11 10:30", "2024-03-12 10:30", "2024-03-13 10:30", "2024-03-14 10:30", "2024-03-15 10:30"]),
        ("marching in step may do, 12 monkeys", []),
        ("", []),
    ],
)
def test_dates_by_hand(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(analysis.signals(F.col("t"), X.at(NOW)).alias("s")).first().s
    assert [s.resolved.strftime("%Y-%m-%d %H:%M") for s in got] == want
    assert all((s.kind == "ABSOLUTE") == any(c.isdigit() for c in s.value) for s in got)


def said(spark, sf):
    c = T.read(spark, sf, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("event_id"), F.lit("u").alias("user_id"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("text").alias("content"))


def source(spark, folder):
    return spark.readStream.schema(materialise.IN).parquet(folder)


def test_stream_equals_batch_across_a_restart(spark, sf, tmp_path):
    rows = said(spark, sf)
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    rows.where("turn < 2").write.parquet(folder)
    materialise.run(spark, source(spark, folder), out, checkpoint)
    rows.where("turn = 1").unionByName(rows.where("turn >= 2")).repartition(3).write.mode("append").parquet(folder)  # some are sent twice
    got = materialise.run(spark, source(spark, folder), out, checkpoint)
    again = materialise.run(spark, source(spark, folder), out, checkpoint).collect()
    nodes = Counter((r.event_id, r.content) for r in got.where("kind = 'node'").collect())
    assert nodes == Counter((r.event_id, r.content) for r in rows.collect())
    pairs = Counter((int(r.session_id), r.turn, r.content) for r in got.where("kind = 'pair'").collect())
    assert pairs == Counter(tuple(r) for r in ingest.qa_pairs(T.read(spark, sf, "conversations")).collect()) and pairs
    assert len(again) == got.count() and got.where("kind = 'dead'").isEmpty()


def test_failed_messages_are_tried_again_and_given_up(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))
    flag = f"{tmp_path}/works"

    def extract(text):
        import os

        if "never" in text or ("later" in text and not os.path.exists(flag)):
            raise ValueError(text)
        return text.upper()

    def send(*texts):
        spark.createDataFrame([(t, "u", "s", i, "user", t) for i, t in enumerate(texts)], materialise.IN).write.mode("append").parquet(folder)
        return materialise.run(spark, source(spark, folder), out, checkpoint, extract, wait=0.2, factor=2.0, tries=3, backlog=2)

    first = send("one", "later", "never", "never again").collect()
    assert {(r.kind, r.event_id) for r in first} == {("node", "one"), ("dead", "never again")}  # the backlog holds two
    open(flag, "w").close()
    for n in range(4):
        time.sleep(0.6)
        rows = send(f"tick {n}").collect()
    kinds = {r.event_id: (r.kind, r.content, r.attempt) for r in rows}
    assert kinds["later"] == ("node", "LATER", 2) and kinds["never"] == ("dead", "never", 3) and len(rows) == len(kinds) == 8


def test_conversations_as_a_folder_of_files_equal_the_sql(spark, sf, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from engram.plans import indexed

    spark.read.parquet(f"{sf}/conversations.parquet").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = Counter(duckdb.sql(indexed.ORACLES["streamed_memory"]).fetchall())
    for place in (sf, str(tmp_path)):
        assert Counter(map(tuple, indexed.streamed_memory(spark, place).collect())) == want
