"""Table functions for SQL: JSON documents to rows of any schema.

    spark.sql(f"SELECT t.* FROM docs, LATERAL json_entries(body, 'cluster_details', '{schema_json('cluster_id int, size long')}') t")

json_entries gives a row for each entry of an object (its key first) or of an array (its number first) at a path of a document;
the columns are those of the schema in the call, a constant in Spark's JSON form. Missing and unreadable values are null,
a null or broken document, or one without the path, gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_WHOLE, _REAL = (ByteType, ShortType, IntegerType, LongType), (FloatType, DoubleType)
_BITS = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}


def converted(value: Any, kind: DataType) -> Any:
    """A JSON value as a column's value; null if it isn't one."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(kind, (*_WHOLE, *_REAL)):
        try:
            x = None if isinstance(value, bool) else float(value) if isinstance(kind, _REAL) else int(str(value)) if not isinstance(value, float) else int(value) if value.is_integer() else None
        except (TypeError, ValueError, OverflowError):
            return None
        if x is not None and isinstance(kind, _WHOLE) and not -(2 ** (_BITS[type(kind)] - 1)) <= x < 2 ** (_BITS[type(kind)] - 1):
            return None
        return x
    if isinstance(kind, ArrayType):
        return [converted(v, kind.elementType) for v in value] if isinstance(value, list) else None
    if isinstance(kind, StructType):
        return tuple(converted(value.get(f.name), f.dataType) for f in kind) if isinstance(value, dict) else None
    if isinstance(kind, MapType):
        return {k: converted(v, kind.valueType) for k, v in value.items()} if isinstance(value, dict) else None
    return None


class JsonEntries:
    """Rows of a document's entries; the first column is the key or number, the others are fields of the entry (the last one may be
    named `entry` for the whole of it)."""

    @staticmethod
    def analyze(document: AnalyzeArgument, path: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not (path.isConstantExpression and schema.isConstantExpression) or path.value is None or schema.value is None:
            raise Exception("path and schema must be constants")
        return AnalyzeResult(StructType.fromJson(json.loads(schema.value)))

    def eval(self, document: str, path: str, schema: str) -> Iterator[tuple]:
        if getattr(self, "_named", None) != schema:
            self._named, self._kind = schema, StructType.fromJson(json.loads(schema))
        try:
            x = json.loads(document) if document is not None else None
        except ValueError:
            return
        for name in filter(None, path.split(".")):
            x = x.get(name) if isinstance(x, dict) else None
        entries = x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ()
        first, *rest = self._kind
        for key, entry in entries:
            field = lambda f: entry if f.name == "entry" else entry.get(f.name) if isinstance(entry, dict) else None  # noqa: B023, E731
            yield (converted(key, first.dataType), *(converted(field(f), f.dataType) for f in rest))


json_entries = udtf(JsonEntries)


def schema_json(ddl: str) -> str:
    """A schema as the table function takes it, from "name type, ..."."""
    return StructType.fromDDL(ddl).json()


def register(spark: SparkSession) -> None:
    """json_entries for this session's SQL."""
    spark.udtf.register("json_entries", json_entries)
