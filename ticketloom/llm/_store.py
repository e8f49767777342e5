"""Intermediate tables in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.session import work_dir

#: The session's spark.checkpoint.dir; only a local session without one gets a folder of its own.
shared_dir = work_dir


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Jobs inside move n rows at a time to Python: whole texts and sets are large rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, rows: int = 10_000) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with arrow_rows(df.sparkSession, rows):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    remember(path, lambda: remove_path(df.sparkSession, path))
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_table_path", None)
    if path:
        for scope in _SCOPES:
            scope.pop(path, None)
        remove_path(df.sparkSession, path)


_SCOPES: list[dict] = []


def remember(name: str, drop) -> None:
    """drop() takes away the table of that name when the innermost temporary() ends."""
    if _SCOPES:
        _SCOPES[-1][name] = drop


@contextmanager
def temporary():
    """Tables written inside are deleted at the end, but for those given to the function that this yields: they pass to the
    scope outside. What is returned lazily must read kept tables only."""
    depth = len(_SCOPES)
    _SCOPES.append({})

    def keep(df: DataFrame) -> DataFrame:
        drop = _SCOPES[depth].pop(df._table_path, None)
        if drop and depth:
            _SCOPES[depth - 1][df._table_path] = drop
        return df

    try:
        yield keep
    finally:
        for drop in _SCOPES.pop().values():
            drop()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(col):
    return F.sha2(col, 256)
