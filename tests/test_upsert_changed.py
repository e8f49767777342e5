"""A batch merged in one shuffle against the delta and the merge one after the other."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_hdbscan_blocks import shuffled_mb

from ticketloom.operators.incremental import delta, upsert, upsert_changed
from ticketloom.schema import PROCESSED
from ticketloom.streaming import updates


def row(key, text, seconds, cluster=None, **more):
    at = None if seconds is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
    return {"issue_id": key, "summary": text[:20], "description": text, "cleaned_description": text, "updated_at": at, "cluster_id": cluster, "cluster_confidence": None if cluster is None else 0.5} | more


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in PROCESSED.fieldNames()) for r in rows], PROCESSED)


def test_same_as_delta_and_merge(spark):
    """Odd rows too: no id, no time, repeated ids, older times, texts alike and not, clusters on either side."""
    random.seed(4)
    text = lambda: "".join(random.choices("abcdefghijkl ", k=30))
    old = [row(f"K{i}", text(), random.choice([0, 5, None]), random.choice([None, i])) for i in range(60)] + [row(None, "no id", 1, 3)]
    new = []
    for r in old[:45]:
        kind = random.randrange(4)
        new.append(r | {"cluster_id": 99} if kind == 0 else row(r["issue_id"], r["description"] + "a", 1, None) if kind == 1 else row(r["issue_id"], text(), 9, 98) if kind == 2 else row(r["issue_id"], r["description"], 7, 97))
    new += [row("K1", "last of two", 50), row("K1", "first of two", 40), row("N1", "new", None, 5), row("N1", "new and later", 3, 6), row(None, "no id either", 2, 4)]
    a, b = frame(spark, old), frame(spark, new)
    want = sorted(map(str, upsert(a, delta(b, a), "updated_at").collect()))
    got = upsert_changed(a, b, "updated_at", F.pmod(F.xxhash64("issue_id"), F.lit(8)).cast("int"), 3)
    assert got.columns == [*PROCESSED.fieldNames(), "bucket"] and sorted(map(str, got.drop("bucket").collect())) == want and len(want) > 60


def test_rows_are_shuffled_once(spark, tmp_path):
    """Of a batch into an empty store, and of one more: each row with its texts crosses the network once."""
    random.seed(5)
    rows = [row(f"K{i}", "".join(chr(random.randrange(0x4E00, 0x9FFF)) for _ in range(600)), i) for i in range(500)]
    size = sum(2 * len(r["description"].encode()) for r in rows) / 1e6  # description and cleaned description
    store = updates.SnapshotStore(spark, str(tmp_path), PROCESSED)
    x = frame(spark, rows).repartition(4).persist()
    x.count()
    assert 0 < shuffled_mb(spark, lambda: updates.apply_batch(store, x, 0, "updated_at")) < 1.3 * size
    assert 0 < shuffled_mb(spark, lambda: updates.apply_batch(store, x, 1, "updated_at")) < 2.6 * size
    assert store.read().count() == 500
    x.unpersist()
