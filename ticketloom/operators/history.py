"""The history of tickets: versions as intervals of time, and what held at any moment.

A version (key, at, seq, columns...) holds from `at` until the key's next one; of versions at one time the one with the largest seq
holds. Both functions work by bins of time: rows meet within (key, bin), and one narrow row for each bin of a key carries what
came before or comes after. So a ticket with very many versions is as many groups as it has bins, not one. Keys, times and
seqs are not null (such rows are left out); empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY = 86_400_000_000


def _bin(at: Column, width: int) -> Column:
    return F.floor(F.unix_micros(at) / F.lit(width)).cast("long")


def _versions(versions: DataFrame, key: str, at: str, seq: str, width: int) -> DataFrame:
    """One row for each key and time, with the others' columns in _v."""
    x = versions.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(seq).isNotNull())
    x = x.groupBy(F.col(key).alias("_k"), F.col(at).cast("timestamp").alias("_at")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in versions.columns]), seq).alias("_v"))
    return x.withColumn("_b", _bin(F.col("_at"), width))


def intervals(versions: DataFrame, key: str, at: str, seq: str, width: int = DAY) -> DataFrame:
    """versions with valid_from and valid_to (null for a key's last), without those that a later seq replaced at once."""
    x = _versions(versions, key, at, seq, width)
    first = x.groupBy("_k", "_b").agg(F.min("_at").alias("_first"))
    later = first.withColumn("_next", F.lead("_first").over(Window.partitionBy("_k").orderBy("_b"))).drop("_first")
    x = x.withColumn("_to", F.lead("_at").over(Window.partitionBy("_k", "_b").orderBy("_at")))
    x = x.join(later.withColumnsRenamed({"_k": "_lk", "_b": "_lb"}), (F.col("_k") == F.col("_lk")) & (F.col("_b") == F.col("_lb")))
    return x.select("_v.*", F.col("_at").alias("valid_from"), F.coalesce("_to", "_next").alias("valid_to"))


def as_of(moments: DataFrame, versions: DataFrame, key: str, at: str, seq: str, moment: str = "moment", width: int = DAY) -> DataFrame:
    """moments (key, moment, ...) with `version`: a struct of the version that held then, null before a key's first."""
    kind = versions.schema
    v = _versions(versions, key, at, seq, width)
    m = moments.select(F.struct(*[F.col(f"`{c}`") for c in moments.columns]).alias("_m"), F.col(key).alias("_k"), F.col(moment).cast("timestamp").alias("_at"))
    m = m.withColumn("_b", _bin(F.col("_at"), width))
    none = F.lit(None).cast(kind)
    # Within a bin: the last version up to each moment.
    both = v.select("_k", "_b", "_at", "_v", F.lit(None).cast(m.schema["_m"].dataType).alias("_m")).unionByName(m.select("_k", "_b", "_at", none.alias("_v"), "_m"))
    upto = Window.partitionBy("_k", "_b").orderBy("_at", F.col("_m").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_own", F.last("_v", ignorenulls=True).over(upto)).where("_m is not null")
    # Before it: the last version of the nearest earlier bin, from a row for each bin.
    bins = both.groupBy("_k", "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_at"))).alias("_last"))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("_k").alias("_bk"), F.col("_b").alias("_bb"), F.last("_last", ignorenulls=True).over(before).alias("_before"))
    x = found.join(bins, F.col("_k").eqNullSafe(F.col("_bk")) & F.col("_b").eqNullSafe(F.col("_bb")), "left")
    return x.select("_m.*", F.coalesce("_own", "_before").alias("version"))
