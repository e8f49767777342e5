"""The jobs over growing input, run again, after a failure, and from the command line."""

import datetime
import json
import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from jobs import cluster_digest, queries, ticket_intake
from jobs._common import load_config

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SCHEMA = "doc_id long, text string, source string, at string"


def intake_config(spark):
    got = load_config(spark, f"file://{ROOT}/jobs/ticket_intake.json", ticket_intake.IntakeConfig)
    return ticket_intake.IntakeConfig(**{**got.__dict__, "schema": SCHEMA, "columns": {**got.columns, "updated_at": "at", "created_at": "at"}})


def deliver(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def plain(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


T = "2024-03-01T00:00:00Z"
FIRST = [(1, "one\nmy password", "a", T), (2, "two\nplain", "b", T), (3, "three", None, T), (None, "no id", "a", T), (5, None, "a", T), (6, "six", "a", "no time"), (7, "seven", "x/y=z", T), (7, "seven later", "x/y=z", "2024-03-01T00:00:05Z")]
SECOND = [(1, "one\nmy password", "a", "2024-03-01T00:00:00.5Z"), (2, "two\nother text under LICENSE", "b", "2023-01-01T00:00:00Z"), (3, "three", None, "2024-03-02T00:00:00Z"), (8, "eight", "a", None), (1, None, "a", T)]


@pytest.mark.parametrize("per_batch, named", [(1000, 1000), (1, 1000), (1000, 0)])
def test_intake_grows(spark, tmp_path, monkeypatch, per_batch, named):
    """Only new files are read; updates are told from what is the same; a run without new files changes nothing."""
    monkeypatch.setattr(ticket_intake, "NAMED", named)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    cfg = ticket_intake.IntakeConfig(**{**intake_config(spark).__dict__, "max_files_per_batch": per_batch})
    os.makedirs(folder)
    assert ticket_intake.run(spark, folder, out, cfg) == 0 and ticket_intake.history(spark, out).count() == 0
    deliver(spark, FIRST, folder)
    assert ticket_intake.run(spark, folder, out, cfg) == 1
    assert sorted((r.issue_id, r.category, r.label, r.source) for r in ticket_intake.history(spark, out).collect()) == [("DOC-1", "new", "security", "a"), ("DOC-2", "new", None, "b"), ("DOC-3", "new", None, None), ("DOC-7", "new", None, "x/y=z")]
    assert ticket_intake.current(spark, out).where("issue_id = 'DOC-7'").first().summary == "seven later"
    deliver(spark, SECOND, folder)
    assert ticket_intake.run(spark, folder, out, cfg) == 1
    runs = {r.batch: r.asDict() for r in spark.read.schema(ticket_intake.RUNS).json(f"{out}/runs").collect()}
    assert [(r["read"], r["rejected"], r["new"], r["updated"], r["unchanged"]) for _, r in sorted(runs.items())] == [(8, 3, 4, 0, 0), (5, 1, 1, 2, 1)]
    assert sorted((r.reason, r.rows) for r in spark.read.schema(ticket_intake.REJECTS).json(f"{out}/rejects").collect()) == [("no issue_id", 1), ("no summary", 1), ("no summary", 1), ("unreadable created_at", 1)]
    now = {r.issue_id: r for r in ticket_intake.current(spark, out).collect()}
    assert {k: (r.category, r.batch) for k, r in now.items()} == {"DOC-1": ("new", 0), "DOC-2": ("updated", 1), "DOC-3": ("updated", 1), "DOC-7": ("new", 0), "DOC-8": ("new", 1)}
    assert now["DOC-2"].label == "legal" and now["DOC-8"].created_at == datetime.datetime(2024, 1, 1)
    before = plain(ticket_intake.history(spark, out))
    assert ticket_intake.run(spark, folder, out, cfg) == 0 and plain(ticket_intake.history(spark, out)) == before


def test_history_is_pruned(spark, tmp_path):
    """A small batch's ids reach the scan of the history, and earlier batches alone are read."""
    folder, out, cfg = str(tmp_path / "in"), str(tmp_path / "out"), intake_config(spark)
    deliver(spark, FIRST, folder)
    ticket_intake.run(spark, folder, out, cfg)
    plan = ticket_intake.known(spark, out, 5, spark.createDataFrame([("DOC-1",), ("DOC-9",), ("DOC-1",)], "issue_id string"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(issue_id, \[DOC-[19],DOC-[19]\]\)", plan) and "Join" not in plan and re.search(r"PartitionFilters: \[[^\]]*batch", plan)
    assert "cleaned_description" not in plan.split("ReadSchema")[-1]


def test_intake_after_failure(spark, tmp_path, monkeypatch):
    """A batch that failed after it wrote its changes is taken again, with the same rows and counts."""
    folder, out, cfg = str(tmp_path / "in"), str(tmp_path / "out"), intake_config(spark)
    deliver(spark, FIRST, folder)
    ticket_intake.run(spark, folder, out, cfg)
    deliver(spark, SECOND, folder)
    whole = ticket_intake.write_partitions

    def fails(df, path, *args, **more):
        if path.endswith("/runs"):
            raise OSError("lost")
        whole(df, path, *args, **more)

    monkeypatch.setattr(ticket_intake, "write_partitions", fails)
    with pytest.raises(Exception, match="lost"):
        ticket_intake.run(spark, folder, out, cfg)
    half = plain(ticket_intake.history(spark, out))
    monkeypatch.setattr(ticket_intake, "write_partitions", whole)
    assert ticket_intake.run(spark, folder, out, cfg) == 1
    assert plain(ticket_intake.history(spark, out)) == half and len(half) == 7
    assert spark.read.schema(ticket_intake.RUNS).json(f"{out}/runs").where("batch = 1").first()["updated"] == 2


def test_intake_of_copies(spark, tmp_path):
    """The given table in two deliveries equals one delivery of all, but for the batches."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    cfg = load_config(spark, f"file://{ROOT}/jobs/ticket_intake.json", ticket_intake.IntakeConfig)
    for n in range(2):
        d.where(F.col("doc_id") % 2 == n).write.mode("append").parquet(str(tmp_path / "in"))
        ticket_intake.run(spark, str(tmp_path / "in"), str(tmp_path / "two"), cfg)
    ticket_intake.run(spark, str(tmp_path / "in"), str(tmp_path / "one"), cfg)
    one, two = (ticket_intake.history(spark, str(tmp_path / x)) for x in ("one", "two"))
    assert plain(one.drop("batch")) == plain(two.drop("batch")) and two.select("batch").distinct().count() == 2


def test_digest_again_and_by_month(spark, tmp_path):
    """A second run writes the same; a run over one month replaces that month only; clusters beyond the bound are joined."""
    cfg = load_config(spark, f"file://{ROOT}/jobs/cluster_digest.json", cluster_digest.DigestConfig)
    out, tables = str(tmp_path / "out"), [str(tmp_path / t) for t in ("t", "v", "r")]
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id") * 400)
    d.write.parquet(tables[0])
    spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("vec_id", F.col("vec_id") * 400).write.parquet(tables[1])
    spark.read.parquet(f"{SF}/labels.parquet").withColumn("doc_id", F.col("doc_id") * 400).write.parquet(tables[2])
    cluster_digest.run(spark, *tables, out, cfg)
    first = plain(cluster_digest.read_daily(spark, out)), plain(cluster_digest.read_clusters(spark, out))
    cluster_digest.run(spark, *tables, out, cluster_digest.DigestConfig(**{**cfg.__dict__, "broadcast_clusters": 3}))
    assert (plain(cluster_digest.read_daily(spark, out)), plain(cluster_digest.read_clusters(spark, out))) == first
    months = [r.month for r in cluster_digest.read_daily(spark, out).select("month").distinct().orderBy("month").collect()]
    assert len(months) > 1 and cluster_digest.read_daily(spark, out).agg(F.sum("tickets")).first()[0] == d.where("text is not null and substring_index(text, '\n', 1) <> ''").count()
    d.where("doc_id < 400 * 10").write.parquet(str(tmp_path / "few"))
    cluster_digest.run(spark, str(tmp_path / "few"), *tables[1:], out, cfg)
    daily = cluster_digest.read_daily(spark, out)
    assert daily.where(F.col("month") == months[0]).agg(F.sum("tickets")).first()[0] == 10
    assert plain(daily.where(F.col("month") > months[0])) == [r for r in first[0] if r[-1] > months[0]]


def test_digest_of_nothing(spark, tmp_path):
    cfg = load_config(spark, f"file://{ROOT}/jobs/cluster_digest.json", cluster_digest.DigestConfig)
    paths = [str(tmp_path / n) for n in "tvr"]
    for p, s in zip(paths, ("doc_id long, text string, source string", "vec_id long, embedding array<float>, label int", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], s).write.parquet(p)
    cluster_digest.run(spark, *paths, str(tmp_path / "out"), cfg)
    assert cluster_digest.read_daily(spark, str(tmp_path / "out")).count() == 0 == cluster_digest.read_clusters(spark, str(tmp_path / "out")).count()


def test_months(spark, tmp_path):
    """Only the tickets of the last months before as_of."""
    cfg = cluster_digest.DigestConfig(tickets={"issue_id": "k", "summary": "'s'", "description": "'d'", "created_at": "at", "cluster_label": "'c'"}, months=6, as_of="2024-07-01T00:00:00Z")
    t = cluster_digest.selected(spark.createDataFrame([("a", "2024-05-01T00:00:00Z"), ("b", "2023-05-01T00:00:00Z")], "k string, at string"), cfg.tickets)
    v = spark.createDataFrame([("a", [1.0, 0.0], 4), ("b", [0.0, 1.0], 5)], "issue_id string, embedding array<double>, cluster_id int")
    daily, clusters = cluster_digest.digest(t, v, spark.createDataFrame([], "issue_id string, decision string, reviewer_label string"), cfg)
    assert [(r.month, r.cluster_id, r.tickets, r.pending) for r in daily.collect()] == [("2024-05", 4, 1, 1)] and [r.cluster_id for r in clusters.collect()] == [4]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    before = dict(spark.conf.getAll)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert dict(spark.conf.getAll) == before and sorted(got.columns) == sorted(columns)
    form = lambda rows: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert form(got.select(columns).collect()) == form(want.fetchall())


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"near": 0.5, "nearr": 1}))
    with pytest.raises(ValueError, match="nearr"):
        load_config(spark, str(tmp_path / "c.json"), cluster_digest.DigestConfig)


def test_command_line(spark, tmp_path):
    """Both jobs as a user starts them, in processes of their own."""
    def start(*args):
        env = os.environ | {"SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
        return subprocess.run([sys.executable, "-m", *args], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)

    (tmp_path / "in").mkdir()
    os.symlink(f"{SF}/documents.parquet", tmp_path / "in" / "documents.parquet")
    r = start("jobs.ticket_intake", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"))
    assert r.returncode == 0, r.stderr[-2000:]
    assert re.search(r"batch 0: \d+ read, \d+ rejected, \d+ new, 0 updated, 0 unchanged", r.stderr) and "1 batches written" in r.stderr
    assert ticket_intake.history(spark, str(tmp_path / "out")).count() == 200
    r = start("jobs.cluster_digest", "--tickets", f"{SF}/documents.parquet", "--vectors", f"{SF}/embeddings.parquet", "--reviews", f"{SF}/labels.parquet", "--output", str(tmp_path / "digest"))
    assert r.returncode == 0, r.stderr[-2000:]
    assert "200 tickets read" in r.stderr and cluster_digest.read_clusters(spark, str(tmp_path / "digest")).count() == 10
