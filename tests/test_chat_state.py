"""Chat sessions on streams against the batch rollup; closing by timer; another run goes on."""

import time

from pyspark.sql import functions as F

from conftest import SF
from ticketloom.streaming import chat_state, sessions

TURNS = "conv_id long, turn long, role string, text string"


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_rollup(spark, tmp_path):
    """Turns in any order over several batches and two runs give the rollup of all of them."""
    c = spark.read.parquet(f"{SF}/conversations.parquet")
    where, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    before = dict(spark.conf.getAll)
    for run in (0, 1):
        for part in (0, 1):
            c.where(f"(turn * 7 + conv_id) % 4 = {2 * run + part}").coalesce(1).write.mode("append").parquet(where)
        stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(where)
        chat_state.start_sessions(stream, out, check).awaitTermination()
    assert dict(spark.conf.getAll) == before
    got = chat_state.latest(spark, out).select("session", "turns", "user_turns", "last_turn", "transcript")
    want = sessions.session_rollup(c).withColumn("conv_id", F.col("conv_id").cast("string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(out).select("batch").distinct().count() == 4


def test_idle_sessions_close(spark, tmp_path):
    """A session without messages is given out as closed and forgotten; what comes later begins anew."""
    where, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    deliver(spark, [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "x")], where)
    stream = spark.readStream.schema(TURNS).parquet(where)
    q = chat_state.start_sessions(stream, out, check, idle_ms=1500, processingTime="500 milliseconds")
    try:
        def closed():
            try:
                return {r.session: r for r in spark.read.schema(f"{chat_state.OUT}, batch int").parquet(out).where("closed").collect()}
            except Exception:  # nothing is written yet
                return {}

        end = time.time() + 60
        while set(closed()) != {"1", "2"} and time.time() < end and q.isActive:
            time.sleep(0.5)
        got = closed()
        assert got["1"].transcript == "user: a\nassistant: b" and (got["1"].turns, got["1"].user_turns, got["1"].last_turn) == (2, 1, 1)
        deliver(spark, [(1, 7, "user", "again")], where)
        end = time.time() + 60
        while time.time() < end and q.isActive and chat_state.latest(spark, out).where("session = '1'").first().transcript != "user: again":
            time.sleep(0.5)
    finally:
        q.stop()
    last = chat_state.latest(spark, out).where("session = '1'").first()
    assert (last.turns, last.transcript) == (1, "user: again")
