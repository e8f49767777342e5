"""Ticket sources. Files are read with explicit schemas; nothing is inferred."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ticketloom.operators.prepare import decode_tasks, keep_last, missing_to_null
from ticketloom.schema import PROCESSED, RESULT, TASK_COLUMNS
from ticketloom.sources.workbooks import read_workbooks


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, by its header; quoted cells may span lines."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    return missing_to_null(raw)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of .xlsx workbooks, every cell as text."""
    return missing_to_null(read_workbooks(spark, path))


def read_old_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of an .xls file. Such files have 65,536 rows at most, so the driver reads them."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, dtype=str)
    except ImportError as e:
        raise ImportError("reading .xls files needs xlrd") from e
    frame = frame.astype(object).where(frame.notna(), None)
    return missing_to_null(spark.createDataFrame(frame, ", ".join(f"`{c}` string" for c in frame.columns)))


READERS = {".csv": read_csv, ".xlsx": read_excel, ".xls": read_old_excel}


def load_tickets(spark: SparkSession, path: str, as_of: Column | None = None, compat_nan_label: bool = False) -> DataFrame:
    """Tasks from a file, by its suffix (case counts); other suffixes are refused before the file is looked at."""
    suffix = os.path.splitext(path)[1]
    if suffix not in READERS:
        raise ValueError(f"Unsupported file format: {suffix}")
    return decode_tasks(READERS[suffix](spark, path), as_of, compat_nan_label)


def tasks_from_dataframe(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Any frame with some of the columns of tasks."""
    return decode_tasks(missing_to_null(df), as_of)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Processed tasks: a JSON array, a folder of arrays (.json) or of JSON lines, or Parquet. Fields that a file lacks are null."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(PROCESSED).parquet(path)
    array = not _is_folder(spark, path) or _holds_arrays(spark, path)
    return spark.read.schema(PROCESSED).option("multiLine", array).json(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def _holds_arrays(spark: SparkSession, path: str) -> bool:
    """Whether the first line of a folder of JSON files opens an array, as no line of an object does."""
    line = spark.read.text(path).where(F.length(F.trim("value")) > 0).first()
    return line is not None and line.value.strip() == "["


def read_issues(spark: SparkSession, path: str, as_of: Column | None = None) -> DataFrame:
    """Tasks of a document {"issues": [...]}."""
    item = "struct<" + ",".join(f"{c}:string" for c in TASK_COLUMNS) + ">"
    x = spark.read.schema(f"issues array<{item}>").option("multiLine", True).json(path)
    return decode_tasks(missing_to_null(x.select(F.explode("issues").alias("i")).select("i.*")), as_of)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """The one row of a clustering result."""
    return spark.read.schema(RESULT).option("multiLine", True).json(path)


def result_rows(result: DataFrame) -> DataFrame:
    """A result's clusters, one row each."""
    return result.select(F.explode("cluster_details").alias("id", "d")).select(F.col("id").cast("int").alias("cluster_id"), "d.*")


def lenient_tasks(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The demonstration's loader: any columns may be missing; defaults stand in, the ordinal names the task."""
    now = F.date_format(F.current_timestamp() if as_of is None else as_of, "yyyy-MM-dd'T'HH:mm:ss")
    x = df.withColumn("_ord", F.monotonically_increasing_id()) if "ord" not in df.columns else df.withColumn("_ord", F.col("ord"))
    c = lambda n, default: F.coalesce(F.col(n).cast("string"), default) if n in df.columns else default
    return x.select(
        c("issue_id", F.format_string("TASK-%03d", F.col("_ord") + 1)).alias("issue_id"), c("summary", F.lit("No summary")).alias("summary"), c("description", F.lit("")).alias("description"),
        c("created_at", now).alias("created_at"), c("updated_at", now).alias("updated_at"), c("status", F.lit("To Do")).alias("status"), F.substring(c("description", F.lit("")), 1, 200).alias("cleaned_description"),
        F.col("_ord").alias("ord"),
    )


def existing_state(tasks: DataFrame, *order: str) -> DataFrame:
    """A snapshot by id: the last duplicate counts."""
    return keep_last(tasks, "issue_id", *order)
