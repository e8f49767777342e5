"""The block-by-block tree against the one over all rows at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import hdbscan, hdbscan_blocks as hb


def points(seed, n, dims=5, far=0.1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, dims)) * 8
    p = c[rng.integers(0, 6, n)] + rng.normal(size=(n, dims))
    p[: int(n * far)] = rng.normal(size=(int(n * far), dims)) * 10
    p[n // 2 : n // 2 + n // 3] = p[0]  # a third are copies: every weight among them is 0
    p[-20:] = np.round(p[-20:])  # and ties elsewhere
    return p


def frame(spark, p, step=3):
    return spark.createDataFrame([(i * step, r.tolist()) for i, r in enumerate(p)], "n long, v array<double>").repartition(5)


@pytest.mark.parametrize("block, k, group", [(40, 5, 10**6), (100, 1, 1), (37, 30, 500), (1000, 5, 10**6)])
def test_same_tree(spark, monkeypatch, block, k, group):
    """The same edges in every bit, whatever the blocks; the same labels from them."""
    monkeypatch.setattr(hb, "GROUP", group)
    p = points(block, 400)
    core = hdbscan.core_distances(spark, p, k)
    want = hdbscan.spanning_tree(spark, p, core)
    got = hb.spanning_tree(frame(spark, p), k, block)
    assert got.numbers.tolist() == list(range(0, 1200, 3)) and (got.edges == want).all()
    assert all((a == b).all() for a, b in zip(hdbscan.select_clusters(want, 400, 8, 0.2), hdbscan.select_clusters(got.edges, 400, 8, 0.2)))


def test_bounds_leave_pairs_out(spark):
    """Groups far from each other: most pairs of blocks are never compared, and the tree is still the least one."""
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(size=(60, 4)) + 1000 * rng.normal(size=4) for _ in range(12)])
    got = hb.spanning_tree(frame(spark, p, 1), 4, 30)
    want = hdbscan.spanning_tree(spark, p, hdbscan.core_distances(spark, p, 4))
    assert (got.edges == want).all() and got.compared < got.blocks * (got.blocks - 1) / 4


def test_cluster_of_all_rows(spark):
    """Beyond max_exact every row is clustered as if it weren't; rows without vectors, repeated ids and other columns stay."""
    p = points(7, 300, far=0.2)
    rows = [(f"T{i:04d}", r.tolist(), i, "x") for i, r in enumerate(p)] + [("T9990", None, 1, "y"), ("T9991", None, 2, "y")]
    x = spark.createDataFrame(rows, "issue_id string, embedding array<double>, block int, n string")
    form = lambda df: sorted((r.issue_id, r.block, r.n, r._label, round(r._probability, 12)) for r in df.collect())
    whole, blocks = hdbscan.cluster(x, 8, 0.2), hdbscan.cluster(x, 8, 0.2, max_exact=50, block=60)
    assert blocks.columns == [*x.columns, "_label", "_probability"] and form(blocks) == form(whole) and len({r[3] for r in form(whole)}) > 3
    twice = hdbscan.cluster(x.unionByName(x), 8, 0.2, max_exact=50, block=60)
    assert twice.count() == 604 and twice.where("embedding is null").agg(F.max("_label")).first()[0] == -1


def test_few_rows(spark):
    one = hb.spanning_tree(frame(spark, np.ones((1, 3))), 5)
    assert len(one.edges) == 0 and one.numbers.tolist() == [0]
    same = hb.spanning_tree(frame(spark, np.ones((50, 3))), 5, 10)
    assert len(same.edges) == 49 and (same.edges[:, 2] == 0).all()


def test_blocks_are_bounded(spark):
    """More rows make larger blocks, not more of them: a row travels to no more tasks. The tree stays the least one."""
    rng = np.random.default_rng(5)
    p = rng.normal(size=(1200, 6))
    got = hb.spanning_tree(frame(spark, p, 1), 3, 20)
    want = hdbscan.spanning_tree(spark, p, hdbscan.core_distances(spark, p, 3))
    assert (got.edges == want).all() and got.blocks <= 2 * hb.MAX_BLOCKS


def test_more_rows_than_are_compared_at_once(spark, tmp_path):
    """q56 beyond MAX_EXACT rows: every vector is in its label's cluster."""
    from ticketloom.plans.more_queries import q56_hdbscan_copies

    n = hdbscan.MAX_EXACT + 500
    p = np.random.default_rng(6).normal(size=(n, 8))
    rows = [(i, r.tolist(), i % 4) for i, r in enumerate(p / np.sqrt((p * p).sum(axis=1, keepdims=True)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.label: (r.clusters, r.n, r.sure) for r in q56_hdbscan_copies(spark, str(tmp_path)).collect()}
    assert got == {i: (1, n // 4, True) for i in range(4)}


def shuffled_mb(spark, run):
    """MB that stages started by run() wrote for shuffles."""
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() / 1e6 for s in gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jsc.sc().statusStore().stageList(gateway.jvm.java.util.ArrayList(), False, False, none, gateway.jvm.java.util.ArrayList()))}
    before = stages()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(v for k, v in stages().items() if k not in before)


def test_vectors_are_not_shuffled_by_pairs(spark):
    """Tasks of pairs read their blocks: what is shuffled is a few times the vectors, not a time for each block."""
    n, dims = 800, 256
    rows = frame(spark, np.random.default_rng(8).normal(size=(n, dims)), 1).persist()
    rows.count()
    mb = shuffled_mb(spark, lambda: hb.spanning_tree(rows, 3, 20))
    rows.unpersist()
    assert 0 < mb < 6 * n * dims * 8 / 1e6


def test_scan_in_parts(spark, monkeypatch):
    """Rows that look for an edge in one block are dealt out, and the tree is the same."""
    monkeypatch.setattr(hb, "PAIRS", 400)
    p = points(9, 300)
    want = hdbscan.spanning_tree(spark, p, hdbscan.core_distances(spark, p, 5))
    assert (hb.spanning_tree(frame(spark, p), 5, 100).edges == want).all()


def test_plan_does_not_grow_with_pairs(spark, monkeypatch):
    """Pairs of blocks meet in one product: the tables that are read don't grow with them."""
    from pyspark.sql import DataFrameReader

    read, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: read.append(paths) or parquet(self, *paths, **options))
    p = np.random.default_rng(11).normal(size=(400, 6))
    got = hb.spanning_tree(frame(spark, p, 1), 3, 20)
    assert got.compared > 100 and len(read) < 25


def test_copies_stand_for_one(spark):
    """Fewer copies of a vector than the core distance counts: one of them is compared, and the tree is the same in every bit."""
    p = points(12, 120)
    p = np.concatenate([p, p, p])[np.random.default_rng(13).permutation(360)]
    for k in (2, 5):
        want = hdbscan.spanning_tree(spark, p, hdbscan.core_distances(spark, p, k))
        got = hb.spanning_tree(frame(spark, p), k, 30)
        assert (got.edges == want).all() and got.blocks < 10
