"""Chat sessions as state of a stream, by Spark's stateful processors.

Each session keeps a context (counts) as value state and its messages as list state. A message that comes again (same turn,
role and text) counts again, as in the batch rollup; late turns are put in order when the transcript is made. A session without a
message for `idle_ms` is closed: a timer gives out its last state and clears it. `ttl_ms`, if given, lets state that nothing
touches go even where no timer runs. State lives in RocksDB, beside the heap, and in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

CONTEXT = "turns long, user_turns long, last_turn long, due long"
MESSAGE = "turn long, role string, text string"
OUT = "session string, turns long, user_turns long, last_turn long, transcript string, closed boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"


class Sessions(StatefulProcessor):
    def __init__(self, idle_ms: int | None, ttl_ms: int | None = None):
        self.idle_ms, self.ttl_ms = idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.context = handle.getValueState("context", CONTEXT, self.ttl_ms)
        self.messages = handle.getListState("messages", MESSAGE, self.ttl_ms)

    def _now(self, key, closed: bool) -> pd.DataFrame:
        turns, users, last, _ = self.context.get()
        every = sorted((m for m in self.messages.get()), key=lambda m: (m[0], m[1], m[2]))
        return pd.DataFrame({"session": [key[0]], "turns": [turns], "user_turns": [users], "last_turn": [last], "transcript": ["\n".join(f"{r}: {t}" for _, r, t in every)], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, users, last, due = self.context.get() if self.context.exists() else (0, 0, -1, 0)
        for f in rows:
            new = [(int(a), b, c) for a, b, c in zip(f["turn"], f["role"], f["text"])]
            self.messages.appendList(new)
            turns, users, last = turns + len(new), users + sum(r == "user" for _, r, _ in new), max(last, *(a for a, _, _ in new))
        if self.idle_ms is not None:
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(due)
        self.context.update((turns, users, last, due))
        yield self._now(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.context.exists():  # else its time to live is over
            yield self._now(key, True)
            self.context.clear()
            self.messages.clear()

    def close(self) -> None:
        pass


def sessions(messages: DataFrame, idle_ms: int | None = 3_600_000, ttl_ms: int | None = None, session: str = "conv_id") -> DataFrame:
    """A stream (session, turn, role, text) as one row for each session that a batch has messages of, or that it closes."""
    x = messages.select(F.col(session).cast("string").alias("session"), F.col("turn").cast("long").alias("turn"), "role", "text")
    timed = idle_ms is not None or ttl_ms is not None
    return x.groupBy("session").transformWithStateInPandas(Sessions(idle_ms, ttl_ms), OUT, "Update", "ProcessingTime" if timed else "None")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's setting is put back."""
    before = dict(spark.conf.getAll).get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def start_sessions(messages: DataFrame, path: str, checkpoint: str, idle_ms: int | None = None, ttl_ms: int | None = None, session: str = "conv_id", **trigger) -> StreamingQuery:
    """Each batch's rows as a partition of a Parquet table at `path`; a batch that is run again replaces its own."""

    def write(df: DataFrame, n: int) -> None:
        df.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    with rocksdb(messages.sparkSession):
        w = sessions(messages, idle_ms, ttl_ms, session).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Each session as its last batch left it."""
    x = spark.read.schema(f"{OUT}, batch int").parquet(path)
    return x.groupBy("session").agg(F.max_by(F.struct(*[c for c in x.columns if c not in ("session", "batch")]), F.struct("batch", "turns")).alias("s")).select("session", "s.*")
