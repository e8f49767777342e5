"""Incremental updates: what of a batch is new, updated or unchanged against a snapshot, and the merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.functions.text import characters, content_fingerprint, set_jaccard
from ticketloom.operators.prepare import keep_last

TOLERANCE_MICROS = 1_000_000
PRESERVE_SIMILARITY = 0.8


def _marks(df: DataFrame, side: str) -> list[Column]:
    """What a comparison needs of a row, small whatever its texts: fingerprint, and the sets of characters of its texts. Columns
    of their own, so that those that a query doesn't read are not computed."""
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return [
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias(f"_{side}_at"), content_fingerprint(text("summary"), text("description"), text("cluster_label")).alias(f"_{side}_fingerprint"),
        characters(text("summary")).alias(f"_{side}_summary"), characters(text("cleaned_description")).alias(f"_{side}_cleaned_description"),
    ]


def meaningful_update(new: str = "_new", old: str = "_old") -> Column:
    """Newer by more than a second, or other content; an older timestamp alone is no update."""
    return F.coalesce(F.col(f"{new}_at") - F.col(f"{old}_at") > TOLERANCE_MICROS, F.lit(False)) | (F.col(f"{new}_fingerprint") != F.col(f"{old}_fingerprint"))


def _compared(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Columns of incoming as _n0, _n1, ... and of existing as _o0, ..., category and alike. Fingerprints and character sets are taken
    before the join, and columns cross it one by one, so only what is read is shuffled."""
    old = existing.select(F.col("issue_id").alias("_id"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(existing.columns)], *_marks(existing, "old"))
    new = incoming.select(F.col("issue_id").alias("_new_id"), *[F.col(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(incoming.columns)], *_marks(incoming, "new"))
    x = new.join(old, F.col("_new_id") == F.col("_id"), "left")
    c = F.when(F.col("_id").isNull(), "new").when(meaningful_update(), "updated").otherwise("unchanged")
    return x.withColumns({"category": c, "alike": preserve_clustering()})


def categorize(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """(new struct, old struct, category, alike): each incoming row by itself. `existing` has a row for each id (keep_last); the old
    of a new row has null fields. delta() is leaner where the structs aren't wanted."""
    whole = lambda side, columns: F.struct(*[F.col(f"{side}{i}").alias(c) for i, c in enumerate(columns)])
    return _compared(incoming, existing).select(whole("_n", incoming.columns).alias("new"), whole("_o", existing.columns).alias("old"), "category", "alike")


def delta(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """As merge_delta(categorize()), without the structs: of the old side only the cluster is shuffled beside marks."""
    x = _compared(incoming, existing).where("category <> 'unchanged'")
    old = {c: F.col(f"_o{i}") for i, c in enumerate(existing.columns)}
    own, keep = F.col("category") == "new", (F.col("category") == "updated") & F.col("alike") & old["cluster_id"].isNotNull()
    column = lambda i, c: F.when(own, F.col(f"_n{i}")).when(keep, old[c]) if c in ("cluster_id", "cluster_confidence") else F.col(f"_n{i}")
    return x.select(*[column(i, c).alias(c) for i, c in enumerate(incoming.columns)], "category")


def preserve_clustering(new: str = "_new", old: str = "_old") -> Column:
    """Both summary and cleaned description are alike enough to keep the cluster."""
    like = lambda c: set_jaccard(F.col(f"{new}_{c}"), F.col(f"{old}_{c}")) >= PRESERVE_SIMILARITY
    return like("summary") & like("cleaned_description")


def merge_delta(categorized: DataFrame) -> DataFrame:
    """New and updated rows with their cluster: updated ones keep it if alike, others have null and wait for clustering."""
    x = categorized.where("category <> 'unchanged'")
    keep = (F.col("category") == "updated") & F.col("alike") & F.col("old.cluster_id").isNotNull()
    fields = categorized.schema["new"].dataType.fieldNames()
    own = F.col("category") == "new"
    kept = lambda c: F.when(own, F.col(f"new.{c}")).when(keep, F.col(f"old.{c}"))
    return x.select(*[kept(c).alias(c) if c in ("cluster_id", "cluster_confidence") else F.col(f"new.{c}").alias(c) for c in fields], "category")


def upsert(existing: DataFrame, delta: DataFrame, order: str) -> DataFrame:
    """The full snapshot: the delta's last row of an id replaces the old one. Both are grouped once, so the delta is made once."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(delta.select(*existing.columns, F.lit(1).alias("_v")))
    return keep_last(both, "issue_id", "_v", order).drop("_v")


def upsert_changed(existing: DataFrame, incoming: DataFrame, order: str, bucket: Column, partitions: int) -> DataFrame:
    """As upsert(existing, delta(incoming, existing), order), with the bucket of each row: both sides are shuffled once, by bucket, and
    compared and merged where they lie."""
    columns = existing.columns
    both = existing.withColumn("_v", F.lit(0)).unionByName(incoming.select(*columns, F.lit(1).alias("_v"))).withColumn("bucket", bucket).repartition(partitions, "bucket")
    marks = _marks(both, "new")
    names = ["at", "fingerprint", "summary", "cleaned_description"]
    x = both.select(*both.columns, *marks)
    w = Window.partitionBy("bucket", "issue_id").orderBy(F.desc("_v"), F.desc(order))
    before = F.struct(*[F.col(f"_new_{c}").alias(c) for c in names], "cluster_id", "cluster_confidence")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("_old", F.when(F.col("issue_id").isNotNull(), F.first(F.when(F.col("_v") == 0, before), ignorenulls=True).over(whole)))
    x = x.withColumns({f"_old_{c}": F.col(f"_old.{c}") for c in names})
    own = F.col("_old").isNull()
    x = x.where((F.col("_v") == 0) | own | meaningful_update()).withColumn("_rank", F.row_number().over(w)).where("_rank = 1")
    keep = preserve_clustering() & F.col("_old.cluster_id").isNotNull()
    column = lambda c: F.when((F.col("_v") == 0) | own, F.col(c)).when(keep, F.col(f"_old.{c}")).alias(c) if c in ("cluster_id", "cluster_confidence") else F.col(c)
    return x.select(*[column(c) for c in columns], "bucket")


def statistics(categorized: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row of counters."""
    n = lambda c: F.count_if(F.col("category") == c)
    out = categorized.agg(F.count(F.lit(1)).alias("total_comparisons"), n("new").alias("new_tasks"), n("updated").alias("updated_tasks"), n("unchanged").alias("unchanged_tasks"))
    if existing is not None:
        total = existing.agg(F.count(F.lit(1)).alias("total_existing"))
        out = out.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return out
