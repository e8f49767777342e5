"""Batch plans: clustering by algorithm, whole runs, reviews and re-clustering."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ticketloom.functions.labels import keyword_label
from ticketloom.functions.vectors import euclidean
from ticketloom.operators import hdbscan, kmeans, reports
from ticketloom.operators.embed import Embedder, embed_tasks
from ticketloom.operators.prepare import preprocess_tasks, top_per_group, with_embedding
from ticketloom.plans.config import ALGORITHMS, ClusteringParameters
from ticketloom.sources.tickets import load_tickets


@dataclass
class ClusteringResult:
    assignments: DataFrame
    report: DataFrame
    total_tasks: int
    clusters_found: int
    processing_time: float
    k: int | None = None
    parameters: ClusteringParameters = field(default_factory=ClusteringParameters)

    def release(self) -> None:
        """Give back the cached assignments, once report and assignments are written or shown."""
        self.assignments.unpersist()

    def totals(self) -> DataFrame:
        return self.assignments.sparkSession.createDataFrame([(self.total_tasks, self.clusters_found)], "total_tasks long, clusters_found int")


def cluster_tasks(tasks: DataFrame, config: ClusteringParameters = ClusteringParameters(), order: str = "issue_id", seed: int = 42, inits: int = 10, k: int | None = None) -> ClusteringResult:
    """Assignments, report and totals of tasks with embeddings."""
    if config.algorithm not in ALGORITHMS:
        raise ValueError(f"Unsupported clustering algorithm: {config.algorithm}")
    began = time.perf_counter()
    x = tasks.drop("cluster_id", "cluster_confidence").persist()  # what made the vectors runs once
    x_all, x = x, with_embedding(x)
    if config.algorithm == "kmeans":
        k = k or kmeans.optimal_k(x, config.max_clusters, seed, inits=inits)
        centroids = kmeans.by_size(x, kmeans.fit(x, k, seed, inits), order)
        got = kmeans.assign(x, centroids).persist()
        report = reports.cluster_report(got, order, centroids=kmeans.centroid_table(got), noise=False)
    else:
        got = reports.assignments(hdbscan.cluster(x, config.min_cluster_size, config.cluster_selection_epsilon), "_label", "_probability").drop("_label", "_probability").persist()
        report = reports.cluster_report(got, order)
    t = reports.totals(got, k).first()
    x_all.unpersist()
    return ClusteringResult(got, report, t.total_tasks, t.clusters_found, time.perf_counter() - began, k, config)


def analyze(spark: SparkSession, path: str, config: ClusteringParameters = ClusteringParameters(), embedder: Embedder | None = None) -> ClusteringResult:
    """A ticket file from loading to the report, as one plan."""
    return cluster_tasks(embed_tasks(preprocess_tasks(load_tickets(spark, path)), embedder), config)


@dataclass
class RunStatistics:
    """Runs so far, their time in all and on average."""

    runs: int = 0
    total_time: float = 0.0

    def add(self, result: ClusteringResult) -> None:
        self.runs, self.total_time = self.runs + 1, self.total_time + result.processing_time

    @property
    def average_time(self) -> float:
        return self.total_time / self.runs if self.runs else 0.0


def near_centroid(assigned: DataFrame, n: int = 5, order: str = "issue_id", vector: str = "embedding") -> DataFrame:
    """The n rows of each cluster that are nearest its centroid, with their rank; ties by `order`. First within 64 parts of
    each cluster, so that a large one isn't one task's window."""
    c = kmeans.centroid_table(assigned).select(F.col("cluster_id").alias("_c"), "centroid")
    x = assigned.join(c, F.col("cluster_id") == F.col("_c")).withColumn("distance", euclidean(F.col(vector), F.col("centroid"))).drop("_c", "centroid")
    x = top_per_group(x.withColumn("_g", F.struct("cluster_id", F.pmod(F.xxhash64(order), F.lit(64)))), "_g", n, "distance", order).drop("_g")
    w = Window.partitionBy("cluster_id").orderBy("distance", order)
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def label_clusters(assigned: DataFrame, dictionary: dict, n: int = 5, order: str = "issue_id", text: str = "summary") -> DataFrame:
    """(cluster_id, label): the keyword label that most of the n rows nearest the centroid have; ties to the dictionary's
    order, null where none has one."""
    number = {k: i for i, k in enumerate(dictionary)}
    x = near_centroid(assigned, n, order).withColumn("label", keyword_label(F.col(text), dictionary))
    at = F.coalesce(*[F.when(F.col("label") == k, F.lit(i)) for k, i in number.items()], F.lit(len(number)))
    votes = x.groupBy("cluster_id", "label").agg(F.count("label").alias("n"), F.min(at).alias("o"))
    return votes.groupBy("cluster_id").agg(F.max_by("label", F.struct("n", -F.col("o"))).alias("label"))


def register_views(spark: SparkSession, result: ClusteringResult, prefix: str = "") -> list[str]:
    """Temporary views for SQL: assignments, report and totals of a run."""
    made = {"assignments": result.assignments, "clusters": result.report, "totals": result.totals()}
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in made]


def recent(tasks: DataFrame, as_of: Column, months: int = 6, column: str = "created_at") -> DataFrame:
    """What re-clustering looks at."""
    return tasks.where(F.col(column) >= F.add_months(as_of, -months))


def review(tasks: DataFrame, decisions: DataFrame, key: str = "issue_id") -> DataFrame:
    """tasks with final_label: accept takes the proposed, keep the old one, hybrid the reviewer's; else pending."""
    d = decisions.select(F.col(key).alias("_k"), "decision", "reviewer_label")
    label = F.when(F.col("decision") == "accept", F.col("proposed_label")).when(F.col("decision") == "keep", F.col("cluster_label")).when(F.col("decision") == "hybrid", F.col("reviewer_label"))
    return tasks.join(d, F.col(key) == F.col("_k"), "left").withColumns({"final_label": label, "decision": F.coalesce("decision", F.lit("pending"))}).drop("_k", "reviewer_label")


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """top_k_in_passes() in a single pass; more than `block` queries are an error."""
    if queries.where(F.col(vector).isNotNull()).limit(block + 1).count() > block:
        raise ValueError(f"more than {block} queries: use top_k_in_passes")
    return top_k_in_passes(queries, vectors, k, id_col, vector, block)


def top_k_in_passes(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, id, cosine, rank): exact nearest neighbours of a stated set of queries, about `block` of them in a pass.

    A block of queries goes into the tasks as a matrix; each task sends its own k best, so k rows a query and task are shuffled.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    wanted = queries.select(F.col(id_col).alias("i"), F.col(vector).alias("v")).where("v is not null")
    passes = -(-wanted.count() // block)
    if not passes:
        return vectors.select(F.lit(0).cast("long").alias("query_id"), F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)

    def nearest(q, ids):
        def run(batches):
            scores, who = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
            for b in batches:
                n = pc.fill_null(pc.list_value_length(b.column(1)), -1).to_numpy(zero_copy_only=False)
                there = np.flatnonzero(n == q.shape[1])
                own = b.column(0).to_numpy(zero_copy_only=False)[there]
                p = np.asarray(b.column(1).take(pa.array(there)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(there), q.shape[1])
                p = p / np.maximum(np.sqrt((p * p).sum(axis=1, keepdims=True)), 1e-300)
                for lo in range(0, len(own), 4096):  # a block of rows against all queries, and the best so far
                    s = q @ p[lo : lo + 4096].T
                    s[ids[:, None] == own[None, lo : lo + 4096]] = -np.inf
                    scores, who = np.concatenate([scores, s], axis=1), np.concatenate([who, np.broadcast_to(own[lo : lo + 4096], s.shape)], axis=1)
                    if scores.shape[1] > k:
                        at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                        # Of what ties with the k-th best the lowest ids stay.
                        tied = (scores >= np.take_along_axis(scores, at, 1).min(axis=1, keepdims=True)).sum(axis=1) > k
                        for i in np.flatnonzero(tied):
                            at[i] = np.lexsort((who[i], -scores[i]))[:k]
                        scores, who = np.take_along_axis(scores, at, 1), np.take_along_axis(who, at, 1)
            row, column = np.nonzero(np.isfinite(scores))
            yield pa.record_batch([pa.array(ids[row]), pa.array(who[row, column]), pa.array(scores[row, column])], ["query_id", "id", "cosine"])

        return run

    x = None
    for n in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == n).collect()  # about `block` rows
        if not rows:
            continue
        q = np.array([r.v for r in rows], dtype=np.float64)
        q /= np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
        part = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vector).alias("v")).mapInArrow(nearest(q, np.array([r.i for r in rows], dtype=np.int64)), "query_id long, id long, cosine double")
        x = part if x is None else x.unionByName(part)
    ranked = top_per_group(x, "query_id", k, F.desc("cosine"), "id")
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")))
