"""Texts written once, in chunks of a few MB, as a table bucketed by chunk: later passes read it without a shuffle."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm._store import arrow_rows, remember, remove_path, shared_dir

CHUNK_BYTES = 4 << 20


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of n that Spark puts a bigint in (murmur3, 32 bits, seed 42)."""
    u = np.uint32

    def turn(x, r):
        return (x << u(r)) | (x >> u(32 - r))

    h = np.full(len(keys), 42, dtype=u)
    for half in (keys & 0xFFFFFFFF, keys >> 32 & 0xFFFFFFFF):
        h = turn(h ^ turn(half.astype(u) * u(0xCC9E2D51), 15) * u(0x1B873593), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    for shift, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> u(shift))) * u(m)
    h ^= h >> u(16)
    return np.mod(h.view(np.int32).astype(np.int64), n)


def chunk_ids(task: int, n: int, spread: int = 2):
    """Numbers for the chunks of a task, in turn from `spread` buckets: so a task writes that many files, not one for
    each chunk."""
    wanted = [(task * spread + i) % n for i in range(min(spread, n))]
    found, low, turn = [[] for _ in wanted], 0, 0
    while True:
        while not found[turn]:
            keys = (task << 32) + low + np.arange(1 << 14)
            b = bucket_of(keys, n)
            for own, w in zip(found, wanted):
                own += keys[b == w].tolist()
            low += len(keys)
        yield found[turn].pop(0)
        turn = (turn + 1) % len(wanted)


class Chunks:
    """table: _rest (struct of the other columns), _text, _chunk, _no (row within the chunk).

    What is known about a chunk's rows goes to them by a cogroup on _chunk, for which only the other side moves.
    """

    def __init__(self, docs: DataFrame, text_col: str, chunk_bytes: int | None = None):
        spark = docs.sparkSession
        self.chunk_bytes = chunk_bytes = chunk_bytes or CHUNK_BYTES
        rest = [c for c in docs.columns if c != text_col]
        x = docs.select((F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.struct(F.lit(0).alias("_none"))).alias("_rest"), F.col(text_col).cast("string").alias("_text"))
        schema = x.select("*", F.lit(0).cast("long").alias("_chunk"), F.lit(0).alias("_no")).schema

        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size >> 26 if size < 1 << 60 else 0  # a plan of unknown size claims the largest number
        self.n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), known), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        buckets = self.n

        def number(batches):
            ids = chunk_ids(TaskContext.get().partitionId(), buckets)
            chunk, size, row = next(ids), 0, 0
            for b in batches:
                if not b.num_rows:
                    continue
                texts = b.column(1).cast(pa.large_string())
                n = np.diff(np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :])
                own, no = np.empty(len(n), np.int64), np.empty(len(n), np.int32)
                for i, k in enumerate(n.tolist()):
                    if size >= chunk_bytes:
                        chunk, size, row = next(ids), 0, 0
                    own[i], no[i] = chunk, row
                    size, row = size + k, row + 1
                yield pa.record_batch([*b.columns, pa.array(own), pa.array(no)], names=["_rest", "_text", "_chunk", "_no"])

        self.name = f"chunks_{uuid.uuid4().hex}"
        with arrow_rows(spark, 1000):
            x.mapInArrow(number, schema).write.bucketBy(self.n, "_chunk").option("path", f"{shared_dir(spark)}/{self.name}").option("compression", "zstd").saveAsTable(self.name)
        self.table, self.rest, self.text_col, self.columns = spark.table(self.name), rest, text_col, docs.columns
        remember(self.name, self.discard)

    def discard(self) -> None:
        """Drop the table and its files, once nothing reads them any more."""
        spark = self.table.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(spark, f"{shared_dir(spark)}/{self.name}")

    def original(self, text=None) -> list:
        """The columns as they came, for a select; text: what takes the text's place."""
        text = F.col("_text") if text is None else text
        return [text.alias(c) if c == self.text_col else F.col(f"_rest.`{c}`").alias(c) for c in self.columns]

    def schema(self) -> str:
        return ", ".join(f"{c} {self.table.schema[c].dataType.simpleString()}" for c in ("_rest", "_text"))
