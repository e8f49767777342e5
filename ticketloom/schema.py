"""Row types of tickets and reports."""

from __future__ import annotations

from pyspark.sql import types as T

#: Cells that mean "missing" in ticket files.
NA_VALUES = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

TASK_COLUMNS = ("issue_id", "summary", "description", "created_at", "updated_at", "cluster_label")
#: Input files: every column as text; casts are explicit and never fail the job.
RAW_TASK = T.StructType([T.StructField(c, T.StringType()) for c in TASK_COLUMNS])
TASK = T.StructType([
    T.StructField("issue_id", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()), T.StructField("cluster_label", T.StringType()),
])
PROCESSED = T.StructType([
    *TASK.fields, T.StructField("processed_at", T.TimestampType()), T.StructField("cleaned_description", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("cluster_id", T.IntegerType()), T.StructField("cluster_confidence", T.DoubleType()),
])
SAMPLE = "array<struct<issue_id:string,summary:string>>"
DETAIL = f"struct<size:bigint,avg_confidence:double,centroid_distance:double,is_noise:boolean,description:string,sample_tasks:{SAMPLE}>"
RESULT = f"total_tasks bigint, clusters_found int, cluster_details map<string,{DETAIL}>, processing_time double, generated_at string"
MESSAGE = "array<struct<turn:bigint,role:string,content:string>>"
