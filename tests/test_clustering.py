"""K-means, silhouette, HDBSCAN and embedding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.functions import vectors
from ticketloom.operators import embed, hdbscan, kmeans
from ticketloom.plans.config import ClusteringParameters
from ticketloom.plans.pipeline import cluster_tasks, cosine_top_k


def groups(spark, k=4, n=12, dims=20, spread=0.05, noise=0, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((k, dims)) * 3
    rows = [(f"T{g:02d}{i:03d}", f"s{g}", int(g), [float(x) for x in centres[g] + rng.standard_normal(dims) * spread]) for g in range(k) for i in range(n)]
    rows += [(f"Z{i:03d}", "noise", -1, [float(x) for x in rng.standard_normal(dims) * 30]) for i in range(noise)]
    return spark.createDataFrame(rows, "issue_id string, summary string, g int, embedding array<float>")


def same_partition(df, a, b):
    pairs = df.select(a, b).distinct().count()
    return pairs == df.select(a).distinct().count() == df.select(b).distinct().count()


def test_kmeans(spark):
    x = groups(spark)
    r = cluster_tasks(x, ClusteringParameters(algorithm="kmeans"))
    assert r.k == 4 and r.clusters_found == 4 and r.total_tasks == 48 and same_partition(r.assignments, "g", "cluster_id")
    assert r.report.agg(F.sum("size")).first()[0] == 48 and r.report.where("centroid_distance > 0").count() == 4
    p = r.assignments.agg(F.min("cluster_confidence"), F.max("cluster_confidence")).first()
    assert 0 <= p[0] <= p[1] <= 1
    assert kmeans.optimal_k(x.limit(5)) == 2


def test_silhouette(spark):
    x = groups(spark, k=3, n=15, spread=1.5)
    t = x.toPandas()
    v, g = np.array(t.embedding.tolist()), t.g.to_numpy()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    s = []
    for i in range(len(v)):
        a = d[i][(g == g[i]) & (np.arange(len(v)) != i)].mean()
        b = min(d[i][g == o].mean() for o in set(g) - {g[i]})
        s.append((b - a) / max(a, b))
    assert abs(kmeans.silhouette(x, "g") - np.mean(s)) < 1e-6
    assert kmeans.silhouette(x.where("g = 0"), "g") is None and kmeans.silhouette(x, "g", method="fast") > 0


def test_hdbscan(spark):
    x = groups(spark, k=4, n=14, noise=6)
    r = cluster_tasks(x, ClusteringParameters(min_cluster_size=5, cluster_selection_epsilon=0.1))
    a = r.assignments
    assert r.clusters_found == 4 and same_partition(a.where("g >= 0"), "g", "cluster_id") and a.where("g < 0 and cluster_id is not null").count() == 0
    assert a.where("cluster_id is null and cluster_confidence is not null").count() == 0
    noise = r.report.where("is_noise").first()
    assert noise["size"] == 6 and noise.cluster_id == -1
    assert a.agg(F.max("cluster_confidence")).first()[0] == 1.0


def test_spanning_tree_is_minimal(spark):
    rng = np.random.default_rng(3)
    p = rng.standard_normal((300, 4))
    p[10:20] = p[0]
    core = hdbscan.core_distances(spark, p, 5)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    assert np.allclose(core, np.sort(d, axis=1)[:, 4])
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    tree = hdbscan.spanning_tree(spark, p, core)
    inside, best, total = {0}, m[0].copy(), 0.0  # Prim
    for _ in range(299):
        j = min((i for i in range(300) if i not in inside), key=lambda i: best[i])
        total += best[j]
        inside.add(j)
        best = np.minimum(best, m[j])
    assert len(tree) == 299 and abs(tree[:, 2].sum() - total) < 1e-9


def test_hdbscan_edges(spark):
    equal = spark.createDataFrame([(f"E{i}", "s", [1.0] * 10) for i in range(10)], "issue_id string, summary string, embedding array<float>")
    r = cluster_tasks(equal, ClusteringParameters(min_cluster_size=3))
    assert r.total_tasks == 10
    x = groups(spark, k=3, n=20)
    model = hdbscan.fit(x, 5, 0.1, max_exact=45)  # a sample; the rest by their nearest
    a = hdbscan.assign(x, model)
    assert a.where("_label >= 0").count() > 45 and a.where("_label >= 0").groupBy("g").agg(F.count_distinct("_label").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError, match="No tasks provided"):
        cluster_tasks(equal.limit(0))
    with pytest.raises(ValueError, match="No tasks with embeddings"):
        cluster_tasks(equal.withColumn("embedding", F.lit(None).cast("array<float>")))


def test_embedding(spark):
    x = spark.createDataFrame([("1", "same text", "x"), ("2", "same text", "x"), ("3", "", ""), ("4", "other things", None)], "issue_id string, summary string, cleaned_description string")
    got = {r.issue_id: r.embedding for r in embed.embed_tasks(x).collect()}
    assert len(got["1"]) == 384 and got["1"] == got["2"] != got["4"] and abs(sum(v * v for v in got["1"]) - 1) < 1e-5
    again = {r.issue_id: r.embedding for r in embed.embed_tasks(x, dedupe=True).collect()}
    assert again == got and embed.embedding_dimension(embed.embed_tasks(x)) == 384
    assert embed.model_for("no such model").dims == 384 and embed.model_for("bge-m3").dims == 1024 and len(embed.text_key("a")) == 16
    null = embed.embed_column(spark.createDataFrame([(1, None), (2, "t")], "i int, t string"), "t", embed.HashedNgrams(16)).collect()
    assert {r.i: r.embedding is None for r in null} == {1: True, 2: False}


def test_top_k(spark):
    x = groups(spark, k=2, n=10).withColumn("vec_id", F.monotonically_increasing_id()).persist()
    q = x.where("vec_id % 5 = 0")
    got = cosine_top_k(q, x, 3).toPandas()
    t = x.toPandas()
    v = np.array(t.embedding.tolist(), dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for qid in q.toPandas().vec_id:
        s = v @ v[t.index[t.vec_id == qid][0]]
        s[t.vec_id == qid] = -2
        want = np.sort(s)[::-1][:3]
        assert np.allclose(got[got.query_id == qid].sort_values("rank").cosine, want)
    with pytest.raises(ValueError):
        cosine_top_k(x, x, 3, block=5)
    assert cosine_top_k(x.limit(0), x, 3).count() == 0


def test_centroids(spark):
    c = kmeans.centroid_table(groups(spark).withColumnRenamed("g", "cluster_id")).collect()
    assert len(c) == 4 and all(abs(r.centroid_distance - float(np.linalg.norm(r.centroid))) < 1e-9 for r in c)
    assert spark.range(1).select(vectors.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))).first()[0] == 11.0


def test_passes_beyond_a_block(spark, monkeypatch):
    """Silhouette, best k and nearest neighbours need no bound: several passes give what one pass gives."""
    from ticketloom.plans import pipeline

    rng = np.random.default_rng(5)
    rows = [(i, i % 3, (rng.normal(size=4) + 4 * (i % 3)).tolist()) for i in range(150)] + [(150, 9, [50.0, 0.0, 0.0, 0.0])]
    e = spark.createDataFrame(rows, "vec_id long, l long, embedding array<double>").repartition(3)
    v = e.select("l", F.col("embedding").alias("v"))
    top = lambda block: sorted(map(tuple, pipeline.top_k_in_passes(e.where("vec_id % 2 = 0"), e, 3, block=block).collect()))
    close = lambda a, b: len(a) == len(b) and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b))
    one, ones = sorted(map(tuple, kmeans.silhouette_rows(v).collect())), top(1024)
    monkeypatch.setattr(kmeans, "MAX_EXACT", 40)
    assert close(sorted(map(tuple, kmeans.silhouette_rows(v).collect())), one)
    assert close(top(10), ones) and len(ones) == 3 * 76
    assert kmeans.optimal_k(e.where("l < 9"), 4, inits=2) == 3


def test_starts_share_passes(spark):
    """The best of ten starts costs no more than any one of them, and each is a local optimum."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(30, 5)) + 6 * rng.normal(size=5) for _ in range(7)])
    x = spark.createDataFrame([(r.tolist(),) for r in v], "embedding array<double>").repartition(3)
    runs = kmeans.fit_many(x, [(7, s) for s in range(5)] + [(3, 1)])
    for cost, c in runs:
        d = ((v[:, None] - c[None]) ** 2).sum(-1)
        own = d.argmin(axis=1)
        assert d.min(axis=1).sum() <= cost + 1e-6 and len(set(own.tolist())) == len(c)
        assert all(np.allclose(v[own == i].mean(axis=0), c[i], atol=0.05) for i in range(len(c)))
    best = np.array(kmeans.fit(x, 7, seed=0, inits=5))
    assert ((v[:, None] - best[None]) ** 2).sum(-1).min(axis=1).sum() <= min(c for c, _ in runs[:5]) + 1e-6
    with pytest.raises(ValueError):
        kmeans.fit(x.limit(0), 3)


def test_labels_near_centroids(spark):
    from ticketloom.plans import pipeline

    rows = [(f"T{i}", "steel bolt" if i < 3 else "tin can" if i < 5 else "nothing", 0, [float(i), 0.0]) for i in range(9)] + [(f"U{i}", "plain", 1, [50.0 + i, 0.0]) for i in range(3)]
    x = spark.createDataFrame(rows, "issue_id string, summary string, cluster_id int, embedding array<double>")
    near = pipeline.near_centroid(x, 5).collect()
    assert sorted(r.issue_id for r in near if r.cluster_id == 0) == ["T2", "T3", "T4", "T5", "T6"] and {r["rank"] for r in near} == {1, 2, 3, 4, 5}
    got = {r.cluster_id: r.label for r in pipeline.label_clusters(x, {"a": {"keywords": ["steel"]}, "b": {"keywords": ["TIN"]}}).collect()}
    assert got == {0: "b", 1: None}
    stats, run = pipeline.RunStatistics(), pipeline.ClusteringResult(x, x, 12, 2, 1.5)
    stats.add(run)
    stats.add(run)
    assert (stats.runs, stats.total_time, stats.average_time) == (2, 3.0, 1.5) and pipeline.RunStatistics().average_time == 0.0
    assert sorted(pipeline.register_views(spark, run, "t_")) == ["t_assignments", "t_clusters", "t_totals"] and spark.sql("SELECT max(total_tasks) AS n FROM t_totals").first().n == 12


def test_all_silhouettes_at_once(spark, monkeypatch):
    """Scores of many sets of centroids from one pass of distances equal those taken one by one, in several passes too."""
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(40, 3)) + 5 * i for i in range(4)])
    x = spark.createDataFrame([(r.tolist(),) for r in v] + [(None,)], "embedding array<double>").repartition(3)
    sets = [rng.normal(size=(k, 3)) * 8 for k in (2, 3, 7)] + [np.array([[0.0, 0, 0], [1e9, 0, 0]]), v[:5]]
    want = [kmeans.silhouette(kmeans.assign(x.where("embedding is not null"), s.tolist()), "cluster_id") for s in sets]
    for bound in (20_000, 50):
        monkeypatch.setattr(kmeans, "MAX_EXACT", bound)
        got = kmeans.silhouettes_by_set(x, sets)
        assert [g is None for g in got] == [w is None for w in want] and got[3] is None
        assert all(g is None or abs(g - w) < 1e-9 for g, w in zip(got, want))


def test_silhouettes_without_the_driver(spark, monkeypatch):
    """Groups and blocks of rows meet in tasks: the same means as at once, and no vectors are sent to the driver."""
    rng = np.random.default_rng(8)
    p = rng.normal(size=(300, 3)) + rng.integers(0, 3, 300)[:, None] * 3
    x = spark.createDataFrame([(r.tolist(),) for r in p], "embedding array<double>").repartition(3)
    sets = [p[:k].copy() for k in (2, 3, 5)]
    want = kmeans.silhouettes_by_set(x, sets)
    labelled = kmeans.assign(x, sets[1].tolist())
    single = kmeans.silhouette(labelled, "cluster_id")
    monkeypatch.setattr(type(x), "toArrow", lambda self: pytest.fail("rows go through the driver"))
    monkeypatch.setattr(kmeans, "GROUP_ROWS", 40)
    got = kmeans.silhouettes_by_set(x, sets)
    assert np.allclose(got, want, rtol=1e-12) and np.isclose(kmeans.silhouette(labelled, "cluster_id"), single) and np.isclose(single, want[1])


def test_copies_are_compared_once(spark, monkeypatch):
    """Silhouettes of rows that are there several times: as of all rows, from distances of the different ones."""
    rng = np.random.default_rng(9)
    p = rng.normal(size=(60, 3)) + rng.integers(0, 3, 60)[:, None] * 3
    p = np.concatenate([p, p, p[:20], p[:20]])
    sets = [p[:k].copy() for k in (2, 3)]
    near = [((p[:, None, :] - s[None]) ** 2).sum(axis=2).argmin(axis=1) for s in sets]
    d = np.sqrt(((p[:, None, :] - p[None]) ** 2).sum(axis=2))

    def score(l):
        mean = [[d[i, l == c].sum() / max(1, (l == c).sum() - (l[i] == c)) for c in range(l.max() + 1)] for i in range(len(p))]
        a = np.array([m[c] for m, c in zip(mean, l)])
        b = np.array([min(x for c, x in enumerate(m) if c != own) for m, own in zip(mean, l)])
        return (b - a) / np.maximum(a, b)

    counted, sums = [], kmeans._distance_sums
    monkeypatch.setattr(kmeans, "_distance_sums", lambda x, count, width: counted.append((count, x.count())) or sums(x, count, width))
    x = spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(p, near[1])], "embedding array<double>, l long").repartition(3)
    assert np.allclose(kmeans.silhouettes_by_set(x, sets), [score(l).mean() for l in near], atol=1e-7)
    rows = kmeans.silhouette_rows(x.select("l", F.col("embedding").alias("v"))).collect()
    assert np.allclose(sorted(r.silhouette for r in rows), sorted(score(near[1])), atol=1e-7) and counted == [(60, 60)] * 2
