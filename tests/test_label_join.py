"""Keyword tables by automaton against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from ticketloom.functions import labels

TABLE = "label string, label_ord int, keyword string"


def brute(docs, table):
    return list({(n, i, label, o) for n, (i, t) in enumerate(docs) for label, o, k in table if t and k and k.lower() in t.lower()})


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000, 600])
def test_brute(spark, shard_bytes):
    random.seed(shard_bytes)
    letters = ["a", "b", "ab", "ba", "É", "é", " ", "中", "😀", "I", "i", "ß"]
    table = [(f"L{random.randint(0, 30)}", random.randint(0, 3), "".join(random.choices(letters, k=random.randint(1, 4)))) for _ in range(200)]
    table += [("empty", 1, ""), ("none", 1, None), ("L1", 1, "aab"), ("L2", 1, "aab"), (None, 2, "zz")]
    docs = [(i // 2, "".join(random.choices(letters, k=random.randint(0, 40)))) for i in range(200)] + [(500, None), (501, ""), (502, "zz " * 1000)]
    x = spark.createDataFrame(docs, "i int, t string").repartition(3)
    got = labels.label_join(x, spark.createDataFrame(table, TABLE), "t", "i", shard_bytes)
    want = brute(docs, table)
    assert sorted(((r.i, r.label or "", r.label_ord) for r in got.collect())) == sorted((i, label or "", o) for _, i, label, o in want)


def test_many_keywords(spark):
    """A hundred thousand keywords in one pass: no join, no shuffle, nothing taken from the texts but matches."""
    table = spark.range(100_000).select(F.concat(F.lit("label "), F.col("id") % 1000).alias("label"), (F.col("id") % 1000).cast("int").alias("label_ord"), F.concat(F.lit("key"), F.col("id"), F.lit(";")).alias("keyword"))
    docs = spark.range(500).select(F.col("id").alias("i"), F.concat_ws(" ", *[F.concat(F.lit("KEY"), F.col("id") * 7 + n, F.lit("; and key12")) for n in (0, 1000, 5)], F.lit(" text")).alias("t"))
    got = labels.label_join(docs, table, "t", "i")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Generate" not in plan
    n = {r.i: r.n for r in got.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {i: len({(i * 7) % 1000, (i * 7 + 5) % 1000}) for i in range(500)}


def test_no_keywords(spark):
    x = spark.createDataFrame([(1, "t")], "i int, t string")
    got = labels.label_join(x, spark.createDataFrame([], TABLE), "t", "i")
    assert got.columns == ["i", "label", "label_ord"] and got.count() == 0
