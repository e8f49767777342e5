"""Versions by time against plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from ticketloom.operators import history

T0 = datetime(2024, 1, 1)
V, M = "issue_id string, at timestamp, seq int, body string, _b int", "issue_id string, moment timestamp, note int, _at string"


def some(seed, hot=0):
    random.seed(seed)
    at = lambda: T0 + timedelta(minutes=random.choice([random.randint(0, 30), random.randint(-10_000, 10_000)]))
    versions = [(f"T{random.randint(0, 8)}", at(), i, f"b{i}", 1) for i in range(200)] + [("HOT", T0 + timedelta(minutes=i), i, f"h{i}", 2) for i in range(hot)]
    versions += [versions[3][:2] + (5000, "later seq", 1), (None, at(), 1, "x", 1), ("T1", None, 1, "x", 1), ("T1", at(), None, "x", 1)]
    moments = [(f"T{random.randint(0, 9)}", at(), i, "a") for i in range(300)] + [("HOT", T0 + timedelta(minutes=i * 7 - 20), i, "h") for i in range(hot // 5)]
    moments += [(versions[3][0], versions[3][1], 1, "exact"), ("T1", None, 2, "null"), (None, T0, 3, "null")]
    return versions, moments


@pytest.mark.parametrize("width, hot", [(history.DAY, 0), (60_000_000, 300), (10**15, 300)])
def test_brute(spark, width, hot):
    versions, moments = some(hot, hot)
    v, m = spark.createDataFrame(versions, V).repartition(3), spark.createDataFrame(moments, M).repartition(3)
    fine = [r for r in versions if None not in r[:3]]
    best = {}
    for r in fine:
        best[r[:2]] = max(best.get(r[:2], (-1, "")), (r[2], r[3]))
    got = history.intervals(v, "issue_id", "at", "seq", width)
    assert got.columns == ["issue_id", "at", "seq", "body", "_b", "valid_from", "valid_to"]
    times = {}
    for k, t in sorted(best):
        times.setdefault(k, []).append(t)
    want = sorted((k, t, *best[k, t], n) for k, ts in times.items() for t, n in zip(ts, [*ts[1:], None]))
    form = lambda rows: sorted(map(repr, rows))
    assert form((r.issue_id, r.valid_from, r.seq, r.body, r.valid_to) for r in got.collect()) == form(want)
    held = history.as_of(m, v, "issue_id", "at", "seq", width=width).collect()

    def then(k, t):
        old = [x for x in times.get(k, []) if t is not None and x <= t]
        return best[k, max(old)] if old else None

    assert form((r.issue_id, r.moment, r.note, r._at, r.version and (r.version.seq, r.version.body)) for r in held) == form((*m, then(*m[:2])) for m in moments)


def test_empty(spark):
    v, m = spark.createDataFrame([], V), spark.createDataFrame([("a", T0, 1, "x")], M)
    assert history.intervals(v, "issue_id", "at", "seq").count() == 0
    assert [r.version for r in history.as_of(m, v, "issue_id", "at", "seq").collect()] == [None]
    assert history.as_of(m.limit(0), v, "issue_id", "at", "seq").count() == 0
