"""What both jobs share: configuration, tickets from any table, and tables that runs of a job write again."""

from __future__ import annotations

import json
import logging
from dataclasses import fields

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def load_config(spark: SparkSession, path: str, kind):
    """A dataclass of settings from a JSON file: one beside the program, or by a path with a scheme any that Spark reads. Unknown names
    are an error."""
    if "://" in path:
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    got = json.loads(text)
    unknown = set(got) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**got)


def selected(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns that a configuration names, each an SQL expression over df."""
    return df.select(*[F.expr(e).alias(name) for name, e in columns.items()])


def write_partitions(df: DataFrame, path: str, by: tuple[str, ...], form: str = "parquet", order: str | None = None, options: dict | None = None) -> None:
    """Replace the partitions that df has rows of, and no others. Partitions are evened out, so a large one is several files; order: a
    column that each file is sorted by."""
    even = df.hint("rebalance", *by)
    even = even.sortWithinPartitions(*by, order) if order else even
    even.write.mode("overwrite").options(**(options or {})).option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(form).save(path)


def start_table(spark: SparkSession, schema, path: str, by: tuple[str, ...], form: str = "parquet") -> None:
    """An empty table where there is none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).format(form).save(path)


def observed(observation: Observation, *names: str) -> dict[str, int]:
    """What an observation counted; zeros if the optimizer left its rows out of the plan because there are none."""
    try:
        return {n: v or 0 for n, v in observation.get.items()}
    except Py4JJavaError:
        return dict.fromkeys(names, 0)


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{name}")


def log_to_console() -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
