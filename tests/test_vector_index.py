"""The vector index against all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import vector_index as vi

SCHEMA = "vec_id long, embedding array<float>, g int"


def some_vectors(seed, n=700, dims=10):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    rows = [(i, (centres[i % 12] + 0.3 * rng.normal(size=dims)).astype(np.float32).tolist(), i % 12) for i in range(n)]
    rows += [(n + i, [1.0] + [0.5] * (dims - 1), 0) for i in range(400)]  # a third are copies
    return rows + [(9000, None, 0), (9001, [0.0] * dims, 0), (9002, [1.0] * (dims + 1), 0), (9003, [float("nan")] * dims, 0), (9004, [], 0), (9020, None, 1)]


def brute(rows, wanted, k, dims=10):
    fine = [(i, np.array(v)) for i, v, _ in rows if v and len(v) == dims and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in fine]), np.array([v for _, v in fine])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return {int(q): np.sort((x @ x[j])[ids != q])[::-1][:k] for j, q in enumerate(ids) if wanted(q)}


@pytest.mark.parametrize("extra", [{}, {"slot_rows": 50}, {"slot_rows": 60, "slot_queries": 7}, {"parts": 3, "codes": 8, "cells": 5}])
def test_exact(spark, tmp_path, extra):
    """Every true neighbour, however rows and queries are dealt; the index opened again gives the same."""
    rows = some_vectors(len(extra))
    x = spark.createDataFrame(rows, SCHEMA).repartition(5)
    index = vi.build(x, str(tmp_path / "index"), vi.IndexConfig(**extra))
    assert index.rows.sum() == 1100 and (index.slots >= np.ceil(index.rows / index.config.slot_rows)).all()
    want = brute(rows, lambda i: i % 20 == 0, 5)
    for ix in (index, vi.open_index(spark, str(tmp_path / "index"), index.config)):
        got = vi.search(ix, x.where("vec_id % 20 = 0"), 5, probes=2, rerank=8, exact=True).collect()
        by = {}
        for r in sorted(got, key=lambda r: r["rank"]):
            assert r.id != r.query_id
            by.setdefault(r.query_id, []).append(r.cosine)
        assert by.keys() == want.keys() and all(np.allclose(by[q], want[q], atol=1e-9) for q in want)


def test_recall(spark, tmp_path):
    rows = some_vectors(9, 2000)
    x = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = vi.build(x, str(tmp_path / "index"))
    q = x.where("vec_id % 20 = 0 and vec_id < 2000")
    true = vi.search(index, q, 5, exact=True).persist()
    probes = vi.tuned_probes(index, q, 5, 0.95)
    r = vi.recall(vi.search(index, q, 5, probes), true).first()
    assert r.queries == 100 and r.recall >= 0.9 and probes < len(index.centroids)
    assert vi.recall(true, true).first().recall == 1.0
    plan = vi.search(index, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") == 2  # codes and vectors stay where they are


def test_few_and_none(spark, tmp_path):
    x = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0)], SCHEMA)
    index = vi.build(x, str(tmp_path / "two"))
    assert [(r.query_id, r.id) for r in vi.search(index, x.where("vec_id = 1"), 5, exact=True).collect()] == [(1, 2)]
    assert vi.search(index, x.limit(0), 5).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        vi.build(x.limit(0), str(tmp_path / "none"))


def test_small_cells_share_slots(spark, tmp_path):
    """A query goes once to a slot, however many of its cells it probes, so probes grow with queries and not with cells."""
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(3000, 8)))], SCHEMA).repartition(3)
    index = vi.build(x, str(tmp_path / "index"), vi.IndexConfig(cells=300))
    assert (index.slots == 1).all() and len(set(index.first)) < 2 * vi.SHELVES
    q = x.where("vec_id < 10").select("vec_id", F.col("embedding").alias("q"))
    asked = q.mapInArrow(vi._probes(index, 300), vi.PROBE)
    assert asked.count() == asked.select("query_id", "slot").distinct().count() == 10 * len(set(index.first))
