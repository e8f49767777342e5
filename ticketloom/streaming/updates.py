"""Micro-batch upserts: the batch operators of incremental updates behind foreachBatch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom.operators.incremental import delta as changed_rows, upsert_changed
from ticketloom.operators.prepare import keep_last


class SnapshotStore:
    """A snapshot by key in hash buckets; each batch writes the buckets that it touches and a list of where every bucket
    now lies. Writing a batch again gives the same folders. Of old versions the last `keep` stay.

    root/data/v=N/bucket=B/: rows; root/list/v=N: (bucket, version). A version counts once its list is written.
    """

    def __init__(self, spark: SparkSession, root: str, schema, key: str = "issue_id", buckets: int = 64, keep: int = 3):
        self.spark, self.root, self.schema, self.key, self.buckets, self.keep = spark, root.rstrip("/"), schema, key, buckets, keep

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._path("list")
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v=")) for p in done)

    def _list(self, version: int) -> dict[int, int]:
        return {r.bucket: r.version for r in self.spark.read.schema("bucket int, version int").json(f"{self.root}/list/v={version}").collect()}  # a row for each bucket

    def _at(self, before: int | None) -> dict[int, int]:
        v = [x for x in self._versions() if before is None or x < before]
        return self._list(v[-1]) if v else {}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def tasks(self, only: list[int] | None = None) -> int:
        return max(1, min(self.buckets, len(only) if only is not None else self.buckets))

    def touched(self, df: DataFrame) -> list[int]:
        return [r.b for r in df.select(self.bucket().alias("b")).distinct().collect()]  # `buckets` rows at most

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The latest version, or the latest before a batch; `only`: the buckets to read."""
        paths = [f"{self.root}/data/v={v}/bucket={b}" for b, v in sorted(self._at(before).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int, only: list[int] | None = None) -> None:
        """df: the rows of the buckets `only` (all: the whole snapshot) as they are from this batch on; rows that have their bucket
        lie by it already."""
        at = self._at(batch) if only is not None else {}
        x = df if "bucket" in df.columns else df.withColumn("bucket", self.bucket()).repartition(self.tasks(only), "bucket")
        x.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={batch}")
        fs, path = self._path("data", f"v={batch}")
        new = [int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(path) if s.getPath().getName().startswith("bucket=")]
        at = {b: v for b, v in at.items() if b not in (only or [])} | dict.fromkeys(new, batch)
        self.spark.createDataFrame(sorted(at.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").json(f"{self.root}/list/v={batch}")
        self._forget(batch)

    def _forget(self, batch: int) -> None:
        """Delete lists before the last `keep`, and data that no list left names."""
        known = [v for v in self._versions() if v <= batch]
        gone = known[: -self.keep]
        if not gone:
            return
        needed = {(v, b) for k in known[-self.keep :] for b, v in self._list(k).items()}
        for v in gone:
            fs, path = self._path("list", f"v={v}")
            fs.delete(path, True)
        fs, path = self._path("data")
        for folder in fs.listStatus(path):
            v = int(folder.getPath().getName().removeprefix("v="))
            if v > batch:
                continue
            for s in fs.listStatus(folder.getPath()):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (v, int(name.removeprefix("bucket="))) not in needed:
                    fs.delete(s.getPath(), True)


def apply_batch(store: SnapshotStore, batch: DataFrame, number: int, order: str) -> DataFrame:
    """Categorize and merge one batch into the buckets that it touches; returns the delta."""
    only = store.touched(batch)
    old = store.read(before=number, only=only)
    store.write(upsert_changed(old, batch, order, store.bucket(), store.tasks(only)), number, only)
    return changed_rows(batch, old)


def start_updates(stream: DataFrame, store: SnapshotStore, order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of processed tasks into versions of the snapshot."""
    w = stream.writeStream.foreachBatch(lambda df, n: apply_batch(store, df, n, order) and None).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def start_last_by_key(stream: DataFrame, store: SnapshotStore, order: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The last row so far of each of the store's keys, one version for each batch."""

    def step(df: DataFrame, n: int) -> None:
        only = store.touched(df)
        store.write(keep_last(store.read(before=n, only=only).unionByName(df), store.key, order), n, only)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def window_counts(events: DataFrame, time: str, width: str, slide: str | None = None, late: str | None = None, by: tuple = ()) -> DataFrame:
    """Tumbling or sliding counts; `late` sets the watermark, which only matters to streams."""
    x = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zone
    x = x.withWatermark(time, late) if late else x
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return x.groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def session_counts(events: DataFrame, time: str, gap: str, by: tuple) -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *by, "n")


#: Most centroids that travel to every task; beyond, search in operators.vector_index.
MAX_CENTROIDS = 65_536


def route(stream: DataFrame, centroids: DataFrame, threshold: float = 0.8, vector: str = "embedding") -> DataFrame:
    """Each row to the most similar centroid if its cosine exceeds the threshold, else to none ("new category"); ties go to the lower
    number. Rows without a vector, and vectors without length or of another dimension, have neither.

    The centroids, MAX_CENTROIDS at most, travel with the tasks as a matrix; works on streams.
    """
    rows = centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(MAX_CENTROIDS + 1).collect()
    if len(rows) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    ids, c = np.array([r.cluster_id for r in rows], dtype=np.int32), np.array([r.centroid for r in rows], dtype=np.float64)
    size = np.sqrt((c * c).sum(axis=1)) if len(rows) else np.zeros(0)
    ids, c = ids[size > 0], (c[size > 0] / size[size > 0, None] if len(rows) else c)
    names = [f"c{i}" for i in range(len(stream.columns))]
    at = stream.columns.index(vector)

    def run(batches):
        for b in batches:
            lists = b.column(at)
            n = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            there = np.flatnonzero(n == c.shape[1]) if len(ids) else np.zeros(0, np.int64)
            v = np.asarray(lists.take(pa.array(there)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(there), -1 if len(there) else 1)
            long = np.sqrt((v * v).sum(axis=1))
            there, v = there[long > 0], v[long > 0] / long[long > 0, None]
            best, cosine, none = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows), np.ones(b.num_rows, dtype=bool)
            for lo in range(0, len(there), 1024):
                s = v[lo : lo + 1024] @ c.T
                near = s.argmax(axis=1)
                best[there[lo : lo + 1024]], cosine[there[lo : lo + 1024]] = ids[near], s[np.arange(len(near)), near]
            none[there] = False
            yield pa.record_batch([*b.columns, pa.array(cosine, mask=none), pa.array(best, mask=none | ~(cosine > threshold))], [*names, "similarity", "cluster_id"])

    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, stream.schema))
    got = stream.toDF(*names).mapInArrow(run, f"{kinds}, similarity double, cluster_id int")
    return got.toDF(*stream.columns, "similarity", "cluster_id")
