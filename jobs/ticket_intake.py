"""Ticket intake: whatever ticket files are new in a folder, cleaned, labelled and told apart as new, updated or unchanged.

    python -m jobs.ticket_intake --input FOLDER_OR_PATTERN --output FOLDER [--checkpoint FOLDER] [--config FILE]

A file stream takes the files that its checkpoint doesn't know yet, in batches, and ends. Of each batch the last row of a
ticket counts. It is compared with the ticket's last row in the output: newer by more than a second or of other content
is an update, the rest is left out. What stays is written as one partition by batch and source:

    OUTPUT/changes/batch=N/source=S/   new and updated tickets, cleaned, with fingerprint and label (Parquet)
    OUTPUT/rejects/batch=N/            rows without id or summary or with unreadable times, counted by reason (JSON)
    OUTPUT/runs/batch=N/               rows read, rejected, new, updated, unchanged (JSON)

A batch that is run again after a failure reads the same files, sees the batches before it and overwrites its own
partitions, so the result is the same. Output and checkpoint belong together: keep or delete both. Counters come from
observations of the plan that writes, not from another pass; the comparison reads three narrow columns of the history.
"""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from jobs._common import load_config, log_to_console, logger, observed, selected, start_table, write_partitions
from ticketloom.functions.labels import keyword_label, labelling_text, matching_labels
from ticketloom.operators.incremental import meaningful_update
from ticketloom.operators.prepare import decode_tasks, keep_last, preprocess_tasks, reject_reason, with_fingerprint

LOG = logger("ticket_intake")
CHANGES = "issue_id string, summary string, cleaned_description string, created_at timestamp, updated_at timestamp, fingerprint string, label string, all_labels array<string>, category string, batch int, source string"
RUNS = "read long, rejected long, new long, updated long, unchanged long, batch int"
REJECTS = "reason string, rows long, batch int"


@dataclass(frozen=True)
class IntakeConfig:
    #: Columns of the files, and what of a ticket they are (SQL expressions).
    schema: str = "doc_id long, text string, source string"
    columns: dict = field(default_factory=dict)
    #: parquet, orc, json or csv.
    format: str = "parquet"
    options: dict = field(default_factory=dict)
    #: label -> {keywords}; the first label with a keyword in the text counts.
    labels: dict = field(default_factory=dict)
    max_length: int = 500
    max_files_per_batch: int = 1000
    #: Time of tickets that have none.
    as_of: str = "2024-01-01T00:00:00Z"


def history(spark: SparkSession, output: str) -> DataFrame:
    """All changes so far."""
    return spark.read.schema(CHANGES).parquet(f"{output}/changes")


def current(spark: SparkSession, output: str) -> DataFrame:
    """Each ticket as it stands after the last run."""
    return keep_last(history(spark, output), "issue_id", "batch")


#: Ids that are named in the scan of the history.
NAMED = 1000


def known(spark: SparkSession, output: str, number: int, ids: DataFrame) -> DataFrame:
    """(issue_id, batch, updated_at, fingerprint) of earlier batches' rows of these tickets. A small batch names its ids in the scan, where
    statistics and bloom filters skip what can't hold them; a larger one is a semi join, which Spark broadcasts or filters by its size."""
    before = history(spark, output).where(F.col("batch") < number).select("issue_id", "batch", "updated_at", "fingerprint")
    ids = ids.distinct()
    few = [r.issue_id for r in ids.limit(NAMED + 1).collect()]
    return before.where(F.col("issue_id").isin(few)) if len(few) <= NAMED else before.join(ids, "issue_id", "left_semi")


def take_batch(batch: DataFrame, number: int, output: str, cfg: IntakeConfig) -> None:
    spark, one = batch.sparkSession, F.lit(1)
    read, compared = Observation(f"read-{number}"), Observation(f"compared-{number}")
    raw = selected(batch, cfg.columns)
    seen = raw.observe(read, F.count(one).alias("read"), F.count_if(reject_reason(raw).isNotNull()).alias("rejected"))
    tasks = decode_tasks(seen, F.lit(cfg.as_of).cast("timestamp"))
    tasks = keep_last(tasks, "issue_id", "updated_at", "created_at", "summary", "description")
    text = labelling_text(F.col("summary"), F.col("description"))
    new = with_fingerprint(preprocess_tasks(tasks, cfg.max_length)).withColumns({"label": keyword_label(text, cfg.labels), "all_labels": matching_labels(text, cfg.labels), "source": F.col("cluster_label")})

    old = keep_last(known(spark, output, number, selected(batch, {"issue_id": cfg.columns["issue_id"]}).where("issue_id is not null")), "issue_id", "batch").select(F.col("issue_id").alias("_id"), F.unix_micros("updated_at").alias("_old_at"), F.col("fingerprint").alias("_old_fingerprint"))
    x = new.withColumns({"_new_at": F.unix_micros("updated_at"), "_new_fingerprint": F.col("fingerprint")}).join(old, F.col("issue_id") == F.col("_id"), "left")
    x = x.withColumn("category", F.when(F.col("_id").isNull(), "new").when(meaningful_update(), "updated").otherwise("unchanged"))
    x = x.observe(compared, *[F.count_if(F.col("category") == c).alias(c) for c in ("new", "updated", "unchanged")])
    names = [c.split()[0] for c in CHANGES.split(", ")]
    changes = x.where("category <> 'unchanged'").withColumn("batch", F.lit(number)).select(names)
    write_partitions(changes, f"{output}/changes", ("batch", "source"), order="issue_id", options={"parquet.bloom.filter.enabled#issue_id": "true"})
    counts = observed(read, "read", "rejected") | observed(compared, "new", "updated", "unchanged")
    if counts["rejected"]:
        reasons = raw.select(reject_reason(raw).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(one).alias("rows"))
        write_partitions(reasons.withColumn("batch", F.lit(number)), f"{output}/rejects", ("batch",), "json")
    write_partitions(spark.createDataFrame([(*(counts[c] for c in ("read", "rejected", "new", "updated", "unchanged")), number)], RUNS), f"{output}/runs", ("batch",), "json")
    LOG.info("batch %d: %s", number, ", ".join(f"{n} {c}" for c, n in counts.items()))


def run(spark: SparkSession, source: str, output: str, cfg: IntakeConfig, checkpoint: str | None = None) -> int:
    """Take what is new under `source`; how many batches that made."""
    output = output.rstrip("/")
    start_table(spark, CHANGES, f"{output}/changes", ("batch", "source"))
    start_table(spark, REJECTS, f"{output}/rejects", ("batch",), "json")
    start_table(spark, RUNS, f"{output}/runs", ("batch",), "json")
    stream = spark.readStream.schema(cfg.schema).options(**cfg.options, maxFilesPerTrigger=cfg.max_files_per_batch).format(cfg.format).load(source)
    LOG.info("reading new files of %s", source)
    query = (
        stream.writeStream.foreachBatch(lambda df, n: take_batch(df, n, output, cfg))
        .option("checkpointLocation", checkpoint or f"{output}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batches = len({p["batchId"] for p in query.recentProgress if p["numInputRows"]})
    LOG.info("%d batches written to %s", batches, output)
    return batches


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint")
    p.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), "ticket_intake.json"))
    a = p.parse_args(argv)
    from ticketloom.session import build_session

    log_to_console()
    spark = build_session("ticket_intake")
    try:
        run(spark, a.input, a.output, load_config(spark, a.config, IntakeConfig), a.checkpoint)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
