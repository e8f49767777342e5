"""The jobs as queries: each runs its job twice into a new folder and returns what is there after the second run."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs import cluster_digest, ticket_intake
from jobs._common import load_config
from ticketloom.plans.queries import _CENTROIDS, _clean, fresh_folder

_HERE = os.path.dirname(os.path.abspath(__file__))


def _config(spark: SparkSession, name: str, kind):
    return load_config(spark, f"{_HERE}/{name}.json", kind)


def job1_ticket_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ticket files; the second run finds nothing new. A stream takes a folder or a pattern, and the table may be
    a file, so it is named by a pattern that only fits it."""
    output, cfg = fresh_folder(spark, "intake"), _config(spark, "ticket_intake", ticket_intake.IntakeConfig)
    for _ in range(2):
        ticket_intake.run(spark, f"{sf_dir}/documents.parque[t]", output, cfg)
    x = ticket_intake.history(spark, output)
    return x.select("issue_id", "source", "category", "summary", F.md5("cleaned_description").alias("cleaned"), F.unix_micros("created_at").alias("created"), "fingerprint", "label", F.array_join("all_labels", ",").alias("all_labels"))


def job2_cluster_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and clusters of all documents; the second run writes the same again."""
    output, cfg = fresh_folder(spark, "digest"), _config(spark, "cluster_digest", cluster_digest.DigestConfig)
    for _ in range(2):
        cluster_digest.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "embeddings", "labels")), output, cfg)
    daily = cluster_digest.read_daily(spark, output).select("month", "day", "cluster_id", "tickets", "repeats", "outliers", "confidence", "accepted", "kept", "pending", F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("samples"))
    c = cluster_digest.read_clusters(spark, output)
    none = lambda t: F.lit(None).cast(t)
    whole = c.select(none("string").alias("month"), none("date").alias("day"), "cluster_id", F.col("size").alias("tickets"), "repeats", none("long").alias("outliers"), F.col("avg_confidence").alias("confidence"), F.col("labelled").alias("accepted"), none("long").alias("kept"), none("long").alias("pending"), "label", F.array_join(F.transform("sample_tasks", lambda s: s["issue_id"]), ",").alias("samples"))
    return daily.unionByName(whole)


QUERIES = {"job1_ticket_intake": job1_ticket_intake, "job2_cluster_digest": job2_cluster_digest}


def _labels(t: str) -> str:
    import json

    with open(f"{_HERE}/ticket_intake.json", encoding="utf-8") as f:
        every = json.load(f)["labels"]
    any_of = lambda v: " OR ".join(f"contains(lower({t}), '{k.lower()}')" for k in v["keywords"])
    return "list_filter([" + ", ".join(f"CASE WHEN {any_of(v)} THEN '{k}' END" for k, v in every.items()) + "], lambda y: y IS NOT NULL)"


_TICKETS = f"""t AS (SELECT doc_id, 'DOC-' || doc_id AS issue_id, trim(split_part(text, chr(10), 1)) AS summary, trim(text) AS description, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * doc_id AS created_at, nullif(trim(source), '') AS source FROM documents WHERE text IS NOT NULL AND split_part(text, chr(10), 1) <> ''),
 k AS (SELECT *, substr(md5(summary || '|' || description || '|' || coalesce(source, '')), 1, 16) AS fingerprint, {_labels("summary || ' ' || description")} AS every FROM t)"""
ORACLE_SQL = {
    "job1_ticket_intake": f"WITH {_TICKETS} SELECT issue_id, source, 'new' AS category, summary, md5({_clean('description')}) AS cleaned, epoch_us(created_at) AS created, fingerprint, every[1] AS label, CASE WHEN len(every) > 0 THEN array_to_string(every, ',') END AS all_labels FROM k",
    "job2_cluster_digest": f"""WITH {_TICKETS}, {_CENTROIDS}, z AS (SELECT u.vec_id, sum(u.x * m.c) / sqrt(sum(u.x * u.x)) / sqrt(sum(m.c * m.c)) AS s FROM u JOIN m ON u.i = m.i AND u.label = m.label GROUP BY u.vec_id),
 x AS (SELECT k.*, p.conf, coalesce(p.label, -1) AS cluster_id, coalesce(z.s < 0.3, false) AS outlier, CASE quality WHEN 1 THEN 'accept' WHEN 0 THEN 'keep' ELSE 'pending' END AS decision, strftime(created_at, '%Y-%m') AS month, created_at::DATE AS day FROM k LEFT JOIN p ON p.vec_id = k.doc_id LEFT JOIN z ON z.vec_id = k.doc_id LEFT JOIN labels USING (doc_id)),
 w AS (SELECT cluster_id, arg_max(label, (n, label)) AS label, sum(n)::BIGINT AS labelled FROM (SELECT cluster_id, every[1] AS label, count(*) AS n FROM x WHERE len(every) > 0 GROUP BY ALL) GROUP BY cluster_id),
 s AS (SELECT cluster_id, string_agg(issue_id, ',' ORDER BY created_at, issue_id) AS samples FROM (SELECT * FROM x WHERE cluster_id >= 0 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY created_at, issue_id) <= 3) GROUP BY cluster_id)
 SELECT month, day, cluster_id, count(*) AS tickets, count(*) - count(DISTINCT fingerprint) AS repeats, count(*) FILTER (outlier) AS outliers, round(avg(conf), 6) AS confidence, count(*) FILTER (decision = 'accept') AS accepted, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'pending') AS pending, NULL::VARCHAR AS label, NULL::VARCHAR AS samples FROM x GROUP BY month, day, cluster_id
 UNION ALL SELECT NULL, NULL, x.cluster_id, count(*), count(*) - count(DISTINCT fingerprint), NULL, round(coalesce(avg(conf), 0), 6), coalesce(any_value(labelled), 0), NULL, NULL, any_value(w.label), any_value(samples) FROM x LEFT JOIN w USING (cluster_id) LEFT JOIN s USING (cluster_id) GROUP BY x.cluster_id""",
}
