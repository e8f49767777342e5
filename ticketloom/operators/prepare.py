"""Decoding and preparing ticket rows: required fields, defaults, timestamps, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.functions.text import clean_description, content_fingerprint, feature_text, parse_timestamp, strip
from ticketloom.schema import NA_VALUES, TASK_COLUMNS


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text cells that mean "missing" become null."""
    return df.select(*[F.when(F.col(c).isin(*NA_VALUES), None).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def reject_reason(df: DataFrame) -> Column:
    """Why decode_tasks drops a row; null if it keeps it."""
    unread = lambda n: _column(df, n).isNotNull() & parse_timestamp(_column(df, n)).isNull()
    return F.when(_column(df, "issue_id").isNull(), "no issue_id").when(_column(df, "summary").isNull(), "no summary").when(unread("created_at"), "unreadable created_at").when(unread("updated_at"), "unreadable updated_at")


def rejects(df: DataFrame) -> DataFrame:
    """(reason, rows): what decode_tasks drops, counted."""
    return df.select(reject_reason(df).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def decode_tasks(df: DataFrame, as_of: Column | None = None, compat_nan_label: bool = False) -> DataFrame:
    """Rows of any frame to tasks. Unknown columns go; rows without issue_id or summary, or with an unreadable
    timestamp, go. A missing created_at is `as_of` (now), a missing updated_at is created_at."""
    now = F.current_timestamp() if as_of is None else as_of
    c = {n: _column(df, n) for n in TASK_COLUMNS}
    created, updated = parse_timestamp(c["created_at"]), parse_timestamp(c["updated_at"])
    label = F.nullif(strip(c["cluster_label"].cast("string")), F.lit(""))
    if compat_nan_label and "cluster_label" in df.columns:
        label = F.coalesce(label, F.when(c["cluster_label"].isNull(), F.lit("nan")))
    return df.where(reject_reason(df).isNull()).select(
        c["issue_id"].cast("string").alias("issue_id"), strip(c["summary"].cast("string")).alias("summary"),
        strip(F.coalesce(c["description"].cast("string"), F.lit(""))).alias("description"),
        F.coalesce(created, now).alias("created_at"), F.coalesce(updated, created, now).alias("updated_at"), label.alias("cluster_label"),
    )


def preprocess_tasks(tasks: DataFrame, max_length: int = 500, as_of: Column | None = None, extended: bool = False) -> DataFrame:
    """tasks with processed_at, cleaned_description and empty result columns."""
    return tasks.withColumns({
        "processed_at": F.current_timestamp() if as_of is None else as_of,
        "cleaned_description": clean_description(F.col("description"), max_length, extended),
        "embedding": F.lit(None).cast("array<float>"), "cluster_id": F.lit(None).cast("int"), "cluster_confidence": F.lit(None).cast("double"),
    })


def with_fingerprint(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("fingerprint", content_fingerprint(F.col("summary"), F.col("description"), F.col("cluster_label")))


def with_feature_text(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn("feature_text", feature_text(F.col("summary"), F.col("cleaned_description")))


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the last row by `order`, as max_by: copies of a hot key are combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row")).select("_row.*")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def with_embedding(tasks: DataFrame) -> DataFrame:
    """Rows that have an embedding; raises for no rows at all, or none with an embedding."""
    require_rows(tasks, "No tasks provided for clustering")
    return require_rows(tasks.where("embedding is not null"), "No tasks with embeddings found")


def first_seen(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two batches as one; of an id in both only the first batch's rows."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def top_per_group(df: DataFrame, group: str, n: int, *order) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
