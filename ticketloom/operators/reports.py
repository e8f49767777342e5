"""Cluster reports: a row for each cluster, totals, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.functions.text import clip
from ticketloom.operators.prepare import top_per_group

NOISE_ID = -1
NOISE_TEXT = "Tasks that fit no cluster clearly"


def assignments(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Labels of -1 become null ids and confidences."""
    noise = F.col(label) == NOISE_ID
    return df.withColumns({"cluster_id": F.when(~noise, F.col(label)).cast("int"), "cluster_confidence": F.when(~noise, F.col(probability)).cast("double")})


def cluster_report(tasks: DataFrame, order: str = "ord", samples: int = 3, centroids: DataFrame | None = None, noise: bool = True) -> DataFrame:
    """(cluster_id, size, avg_confidence, centroid_distance, is_noise, description, sample_tasks), largest first.

    Samples are cut to `samples` rows by cluster before they are gathered, so no list grows with a cluster.
    """
    real = tasks.where("cluster_id is not null")
    sizes = real.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.avg("cluster_confidence"), F.lit(0.0)).alias("avg_confidence"))
    # First within 64 parts of each cluster, so that a large cluster isn't one task's window.
    parts = real.select("cluster_id", order, "issue_id", "summary", F.struct("cluster_id", F.pmod(F.xxhash64("issue_id"), F.lit(64))).alias("_g"))
    few = top_per_group(parts, "_g", samples, order, "issue_id").drop("_g")
    few = top_per_group(few, "cluster_id", samples, order, "issue_id")
    lists = few.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "issue_id", clip(F.col("summary"), 100).alias("summary")))).alias("_s"))
    lists = lists.select("cluster_id", F.transform("_s", lambda s: F.struct(s["issue_id"].alias("issue_id"), s["summary"].alias("summary"))).alias("sample_tasks"))
    x = sizes.join(lists, "cluster_id", "left")
    x = x.join(centroids.select("cluster_id", "centroid_distance"), "cluster_id", "left") if centroids is not None else x.withColumn("centroid_distance", F.lit(None).cast("double"))
    x = x.select("cluster_id", "size", "avg_confidence", "centroid_distance", F.lit(False).alias("is_noise"), F.lit(None).cast("string").alias("description"), "sample_tasks")
    if noise:
        rest = tasks.where("cluster_id is null").agg(F.count(F.lit(1)).alias("size")).where("size > 0")
        rest = rest.select(F.lit(NOISE_ID).alias("cluster_id"), "size", F.lit(0.0).alias("avg_confidence"), F.lit(None).cast("double").alias("centroid_distance"), F.lit(True).alias("is_noise"), F.lit(NOISE_TEXT).alias("description"), F.lit(None).cast(x.schema["sample_tasks"].dataType).alias("sample_tasks"))
        x = x.unionByName(rest)
    return x.orderBy(F.desc("size"), "cluster_id")


def totals(tasks: DataFrame, k: int | None = None) -> DataFrame:
    """total_tasks and clusters_found: distinct ids, or k where k-means gave it."""
    found = F.count_distinct("cluster_id").cast("int") if k is None else F.lit(k)
    return tasks.agg(F.count(F.lit(1)).alias("total_tasks"), found.alias("clusters_found"))


def export_rows(report: DataFrame) -> DataFrame:
    """What the CSV export holds."""
    noise = F.coalesce(F.col("is_noise"), F.lit(False)) if "is_noise" in report.columns else F.lit(False)
    return report.select("cluster_id", "size", "avg_confidence", noise.alias("is_noise"))


def sample_preview(samples: Column) -> Column:
    """The first two sample summaries, joined and clipped."""
    return clip(F.array_join(F.transform(F.slice(F.coalesce(samples, F.array().cast("array<struct<issue_id:string,summary:string>>")), 1, 2), lambda s: s["summary"]), ", "), 50)


def console_rows(report: DataFrame) -> DataFrame:
    return report.select("cluster_id", "size", F.format_number("avg_confidence", 3).alias("confidence"), sample_preview(F.col("sample_tasks")).alias("samples"))


def top_clusters(report: DataFrame, n: int = 3) -> DataFrame:
    return report.orderBy(F.desc("size"), "cluster_id").limit(n)


def summary_text(report: DataFrame, total: int, found: int, seconds: float) -> str:
    """A short text: totals and the three largest clusters."""
    lines = [f"Clustering done: {total} tasks, {found} clusters, {seconds:.2f} s.", "Largest:"]
    for r in top_clusters(report).collect():
        lines.append(f"- unassigned: {r['size']} tasks" if r.cluster_id == NOISE_ID else f"- cluster {r.cluster_id}: {r['size']} tasks (confidence {r.avg_confidence:.2f})")
    return "\n".join([*lines, "Ask for the detailed results or an export."])


def detailed_text(report: DataFrame, total: int, found: int, seconds: float, at: str) -> str:
    """Every cluster, largest first, with samples. A report has a row for each cluster."""
    lines = [f"Report of {at}: {total} tasks, {found} clusters, {seconds:.2f} s."]
    for r in report.orderBy(F.desc("size"), "cluster_id").toLocalIterator():
        if r.cluster_id == NOISE_ID:
            lines.append(f"Unassigned ({r['size']} tasks): {NOISE_TEXT}")
        else:
            lines.append(f"Cluster {r.cluster_id} ({r['size']} tasks), mean confidence {r.avg_confidence:.3f}")
            lines += [f"  - {s.summary}" for s in r.sample_tasks or []]
    return "\n".join([*lines, "Export as CSV (cluster counts) or JSON (everything)."])
