"""Streams against the same operators on whole tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import SF
from ticketloom.operators.incremental import categorize, merge_delta, upsert
from ticketloom.schema import PROCESSED
from ticketloom.streaming import sessions, updates


def processed(spark, rows):
    t0 = datetime(2024, 1, 1)
    full = [(i, s, d, t0, t0 + timedelta(seconds=at), None, t0, d, None, c, None if c is None else 0.5) for i, s, d, at, c in rows]
    return spark.createDataFrame(full, PROCESSED)


def test_batches_equal_stream(spark, tmp_path):
    parts = [
        processed(spark, [("A", "first summary", "text one", 0, 1), ("B", "second", "text two", 0, 2)]),
        processed(spark, [("A", "first summary", "text ones", 9, None), ("C", "third", "text three", 0, None)]),
        processed(spark, [("B", "second", "quite different 42", 0, None), ("C", "third", "text three", 0, None)]),
    ]
    store = updates.SnapshotStore(spark, str(tmp_path / "state"), PROCESSED)
    for n, p in enumerate(parts):  # a file is a batch
        p.coalesce(1).write.mode("append").json(str(tmp_path / "in"), ignoreNullFields=False)
        stream = spark.readStream.schema(PROCESSED).json(str(tmp_path / "in"))
        updates.start_updates(stream, store, "updated_at", str(tmp_path / "check")).awaitTermination()
    state = spark.createDataFrame([], PROCESSED)
    for p in parts:
        state = upsert(state, merge_delta(categorize(p, state)), "updated_at")
    key = lambda df: sorted((r.issue_id, r.description, r.cluster_id, r.updated_at) for r in df.collect())
    assert key(store.read()) == key(state) and len(key(state)) == 3
    before = key(store.read())
    updates.apply_batch(store, parts[2], 2, "updated_at")  # the same batch again
    assert key(store.read()) == before


def test_store_keeps_what_it_needs(spark, tmp_path):
    """A batch rewrites its own buckets; versions beyond the last ones go, rows stay."""
    store = updates.SnapshotStore(spark, str(tmp_path / "s"), "k string, v int", key="k", buckets=8, keep=2)
    want = {}
    for n in range(6):
        batch = spark.createDataFrame([(f"k{n}", n), ("k0", n)], "k string, v int")
        only = store.touched(batch)
        old = store.read(before=n, only=only)
        store.write(old.join(batch, "k", "left_anti").unionByName(batch.dropDuplicates(["k"]) if n == 0 else batch), n, only)
        want |= {f"k{n}": n, "k0": n}
        assert {r.k: r.v for r in store.read().collect()} == want and store.read().count() == len(want)
    assert store._versions() == [4, 5] and len(list((tmp_path / "s" / "list").iterdir())) == 2
    assert len([f for f in (tmp_path / "s" / "data").rglob("bucket=*")]) <= 2 * 8
    assert {r.k: r.v for r in store.read(before=5).collect()} == {f"k{n}": n for n in range(1, 5)} | {"k0": 4}


def test_windows_and_last(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = updates.window_counts(events, "ts", "1 hour")
    assert got.agg(F.sum("n")).first()[0] == events.count()
    slide = updates.window_counts(events, "ts", "2 hours", "1 hour")
    assert slide.agg(F.sum("n")).first()[0] == 2 * events.count()
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = updates.window_counts(stream, "ts", "1 hour", late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, got.collect()))
    assert updates.session_counts(events, "ts", "30 minutes", ("user_id",)).agg(F.sum("n")).first()[0] == events.count()


def test_route(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, centroid array<double>")
    x = spark.createDataFrame([(1, [0.9, 0.1]), (2, [0.1, 2.0]), (3, [1.0, 1.0])], "i int, embedding array<float>")
    assert {r.i: r.cluster_id for r in updates.route(x, c).collect()} == {1: 0, 2: 1, 3: None}


def test_sessions(spark, tmp_path):
    turns = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in sessions.session_rollup(turns).collect()}
    assert got[1].transcript == "user: a\nassistant: b" and (got[1].turns, got[1].user_turns, got[1].last_turn) == (2, 1, 1)
    m = spark.createDataFrame([("s1", "assistant", "ok", None, 0.3, 2), ("s1", "user", "hi", 15, None, 1), ("s2", "user", "yo", None, None, 3)], "session_id string, role string, content string, min_size int, epsilon double, at int")
    m.coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(m.schema).parquet(str(tmp_path / "m"))
    q = sessions.track_sessions(stream, order="at").writeStream.outputMode("update").format("memory").queryName("s").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    for _ in range(60):
        if q.awaitTermination(1) or spark.table("s").count():
            break
    q.stop()
    out = {r.session_id: r for r in spark.table("s").collect()}
    assert (out["s1"].messages, out["s1"].last_role, out["s1"].min_cluster_size, out["s1"].epsilon) == (2, "assistant", 15, 0.3)
    assert (out["s2"].messages, out["s2"].min_cluster_size) == (1, None)
