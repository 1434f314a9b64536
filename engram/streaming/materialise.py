"""Messages to memory as a stateful stream, keyed by user and session.

State of a session: its last turn, the ids it has taken, and a backlog of messages whose extraction failed. Each message becomes a
node once, whatever the number of times it is sent; two turns of different roles become a pair; a failed message is tried again by a
timer after 5, 30, 180 ... seconds, and goes to the dead letters after the last try or where the backlog is full. Rows of one
micro-batch may come in any order; from batch to batch a session's turns must not go back.

The sink appends Parquet under a checkpoint, so a stream that is stopped goes on where it was, and what it has written counts once.
State is kept by Spark's state store (RocksDB), on the cluster's shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.functions.frames import rows_of

IN = "event_id string, user_id string, session_id string, turn long, role string, content string"
OUT = "kind string, event_id string, user_id string, session_id string, turn long, content string, attempt int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURN, ITEM = "role string, content string", "turn long, content string, attempt int, due long"


class Materialiser(StatefulProcessor):
    """`extract` gives a node's text for a message's, or raises."""

    def __init__(self, extract: Callable[[str], str], most: int = 1000, backlog: int = 1000, tries: int = 3, wait: float = 5.0, factor: float = 6.0, remember_ms: int | None = None) -> None:
        self.extract, self.most, self.backlog, self.tries, self.wait, self.factor, self.remember_ms = extract, most, backlog, tries, wait, factor, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", TURN)
        self.taken = handle.getMapState("taken", "event_id string", "yes boolean", self.remember_ms)
        self.failed = handle.getMapState("failed", "event_id string", ITEM)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["turn", "role", "content"], kind="stable")  # a session's share of a micro-batch
        out, now, held = [], timerValues.getCurrentProcessingTimeInMs(), None
        last = self.last.get() if self.last.exists() else None
        for r in batch.itertuples():
            if self.taken.containsKey((r.event_id,)):
                continue
            self.taken.updateValue((r.event_id,), (True,))
            held = sum(1 for _ in self.failed.keys()) if held is None else held
            held += self._try(key, r.event_id, r.turn, r.content, 1, now, held, out)
            if last is not None and last[0] != r.role and len(last[1] or "") + len(r.content or "") < self.most:
                out.append(("pair", r.event_id, *key, r.turn, f"{last[1] or ''}\n{r.content or ''}", 1))
            last = (r.role, r.content)
        if last is not None:
            self.last.update(last)
        yield self._rows(out)

    def _try(self, key, event_id: str, turn: int, content: str, attempt: int, now: int, held: int, out: list) -> int:
        """Appends a node, or puts the message off; how many more the backlog holds."""
        try:
            out.append(("node", event_id, *key, turn, self.extract(content), attempt))
            return 0
        except Exception:
            if attempt >= self.tries or held >= self.backlog:
                out.append(("dead", event_id, *key, turn, content, attempt))
                return 0
            due = now + round(1000 * self.wait * self.factor ** (attempt - 1))
            self.failed.updateValue((event_id,), (turn, content, attempt, due))
            self.handle.registerTimer(due)
            return 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, due = [], expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((k[0], *v) for k, v in self.failed.iterator() if v[3] <= due)
        for event_id, turn, content, attempt, _ in ready:
            self.failed.removeKey((event_id,))
            self._try(key, event_id, turn, content, attempt + 1, timerValues.getCurrentProcessingTimeInMs(), 0, out)
        yield self._rows(out)

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return rows_of(out, OUT)

    def close(self) -> None:
        pass


def materialised(stream: DataFrame, extract: Callable[[str], str] = str, **how) -> DataFrame:
    """A stream of messages (`IN`) as a stream of nodes, pairs and dead letters (`OUT`)."""
    rows = stream.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in IN.split(", ")])
    return rows.groupBy("user_id", "session_id").transformWithStateInPandas(statefulProcessor=Materialiser(extract, **how), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")


def run(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str, extract: Callable[[str], str] = str, **how) -> DataFrame:
    """Takes what the source holds now, appends what comes of it to `folder`, and gives all that is there. Run again, it goes on:
    with new rows, and with the messages whose time to be tried again has come."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        sink = materialised(stream, extract, **how).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        # one micro-batch: with timers, Spark would go on for ever looking for some to fire
        sink.trigger(once=True).start(folder).awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return spark.read.schema(OUT).parquet(folder)
