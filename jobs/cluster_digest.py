"""Cluster digest: how clusters of tickets develop, day by day, and one sheet of all clusters.

    python -m jobs.cluster_digest --tickets PATH --vectors PATH --reviews PATH --output FOLDER [--config FILE]

Tickets, their vectors with cluster ids, and review decisions become

    OUTPUT/daily/month=M/     tickets, repeats of a text, reviews and confidence by day and cluster (Parquet)
    OUTPUT/clusters/          size, confidence, samples, keyword label and repeats of each cluster (JSON)

Only months that have tickets are written, each whole, so another run over the same tables gives the same, and a run
over the tickets of some months replaces those. Texts are reduced to fingerprints and labels where they are read; what
is joined and grouped is narrow. The clusters' centroids are broadcast if there are no more of them than the
configuration says, and joined otherwise.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from jobs._common import load_config, log_to_console, logger, observed, selected, write_partitions
from ticketloom.functions.labels import keyword_label, labelling_text
from ticketloom.functions.vectors import cosine, kmeans_confidence
from ticketloom.operators.kmeans import centroid_table
from ticketloom.operators.prepare import decode_tasks, with_fingerprint
from ticketloom.operators.reports import NOISE_ID, cluster_report
from ticketloom.plans.pipeline import recent, review

LOG = logger("cluster_digest")
DAILY = "day date, cluster_id int, tickets long, repeats long, outliers long, confidence double, accepted long, kept long, pending long, month string"
CLUSTERS = "cluster_id int, size long, avg_confidence double, is_noise boolean, sample_tasks array<struct<issue_id:string,summary:string>>, label string, labelled long, repeats long"


@dataclass(frozen=True)
class DigestConfig:
    #: What of a ticket, a vector and a review the tables' columns are (SQL expressions).
    tickets: dict = field(default_factory=dict)
    vectors: dict = field(default_factory=dict)
    reviews: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    #: Cosine to the own centroid below which a ticket is an outlier of its cluster.
    near: float = 0.8
    #: Tickets of so many months before as_of; null: all.
    months: int | None = None
    as_of: str = "2024-01-01T00:00:00Z"
    #: Most clusters whose centroids are broadcast.
    broadcast_clusters: int = 4096
    samples: int = 3


def scored(vectors: DataFrame, cfg: DigestConfig) -> DataFrame:
    """(issue_id, cluster_id, cluster_confidence, near) of the vectors."""
    c = centroid_table(vectors).select(F.col("cluster_id").alias("_c"), "centroid")
    few = vectors.select("cluster_id").distinct().limit(cfg.broadcast_clusters + 1).count() <= cfg.broadcast_clusters
    x = vectors.join(F.broadcast(c) if few else c, F.col("cluster_id") == F.col("_c"))
    own = (F.col("embedding"), F.col("centroid"))
    return x.select("issue_id", "cluster_id", kmeans_confidence(*own).alias("cluster_confidence"), (cosine(*own) >= cfg.near).alias("near"))


def digest(tickets: DataFrame, vectors: DataFrame, reviews: DataFrame, cfg: DigestConfig) -> tuple[DataFrame, DataFrame]:
    """(daily, clusters)."""
    at = F.lit(cfg.as_of).cast("timestamp")
    x = decode_tasks(tickets, at)
    x = recent(x, at, cfg.months) if cfg.months else x
    x = with_fingerprint(x).withColumn("label", keyword_label(labelling_text(F.col("summary"), F.col("description")), cfg.labels))
    x = x.select("issue_id", F.substring("summary", 1, 200).alias("summary"), "created_at", "fingerprint", "label", "cluster_label")
    x = x.join(scored(vectors, cfg), "issue_id", "left")
    x = review(x.withColumn("proposed_label", F.concat(F.lit("cluster "), "cluster_id")), reviews)
    day = x.withColumns({"month": F.date_format("created_at", "yyyy-MM"), "day": F.to_date("created_at"), "cluster_id": F.coalesce("cluster_id", F.lit(NOISE_ID))})
    n = lambda c: F.count_if(c)
    # Copies of a text are combined first, so a day and cluster that holds most of them is no task's own.
    texts = day.groupBy("month", "day", "cluster_id", "fingerprint").agg(
        F.count(F.lit(1)).alias("tickets"), n(~F.coalesce("near", F.lit(True))).alias("outliers"), F.sum("cluster_confidence").alias("sum"), F.count("cluster_confidence").alias("with_vector"),
        n(F.col("decision") == "accept").alias("accepted"), n(F.col("decision") == "keep").alias("kept"), n(F.col("decision") == "pending").alias("pending"),
    )
    total = lambda c: F.sum(c).alias(c)
    daily = texts.groupBy("month", "day", "cluster_id").agg(
        total("tickets"), (F.sum("tickets") - F.count(F.lit(1))).alias("repeats"), total("outliers"), F.round(F.sum("sum") / F.sum("with_vector"), 6).alias("confidence"), total("accepted"), total("kept"), total("pending"),
    )
    report = cluster_report(x, "created_at", cfg.samples).select("cluster_id", "size", F.round("avg_confidence", 6).alias("avg_confidence"), "is_noise", "sample_tasks")
    key = F.coalesce("cluster_id", F.lit(NOISE_ID)).alias("cluster_id")
    words = x.where("label is not null").groupBy(key, "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.sum("n").alias("labelled"))
    again = x.groupBy(key, "fingerprint").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg(F.sum(F.col("n") - 1).alias("repeats"))
    clusters = report.join(words, "cluster_id", "left").join(again, "cluster_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(0)))
    names = lambda s: [c.split()[0] for c in s.split(", ")]
    return daily.select(names(DAILY)), clusters.select("cluster_id", "size", "avg_confidence", "is_noise", "sample_tasks", "label", "labelled", "repeats")


def run(spark: SparkSession, tickets: str, vectors: str, reviews: str, output: str, cfg: DigestConfig) -> None:
    output = output.rstrip("/")
    read = Observation("tickets")
    t = selected(spark.read.parquet(tickets), cfg.tickets).observe(read, F.count(F.lit(1)).alias("tickets"))
    v, r = selected(spark.read.parquet(vectors), cfg.vectors), selected(spark.read.parquet(reviews), cfg.reviews)
    LOG.info("reading %s, %s and %s", tickets, vectors, reviews)
    daily, clusters = digest(t, v, r, cfg)
    write_partitions(daily, f"{output}/daily", ("month",))
    LOG.info("%d tickets read; days written to %s/daily", observed(read, "tickets")["tickets"], output)
    clusters.write.mode("overwrite").option("ignoreNullFields", False).json(f"{output}/clusters")
    LOG.info("clusters written to %s/clusters", output)


def read_daily(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(f"{output}/daily")


def read_clusters(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(CLUSTERS).json(f"{output}/clusters")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("--tickets", "--vectors", "--reviews", "--output"):
        p.add_argument(name, required=True)
    p.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "cluster_digest.json"))
    a = p.parse_args(argv)
    from ticketloom.session import build_session

    log_to_console()
    spark = build_session("cluster_digest")
    try:
        run(spark, a.tickets, a.vectors, a.reviews, a.output, load_config(spark, a.config, DigestConfig))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
