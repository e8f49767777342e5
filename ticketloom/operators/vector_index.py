"""An inverted-file index with product-quantised codes over vectors, for nearest neighbours by cosine.

Building: cells (centroids) and code books are fitted on a bounded uniform sample; every row is then put into its nearest
cell and coded: for each part of its difference from the centroid the number of the nearest book entry, a byte each. Cells
are split into slots of at most about `slot_rows` rows, so that equal vectors don't make one group of their own; small cells near
each other share a slot, some SHELVES of them in all, so that what queries send and get grows with queries, not with cells. Codes and vectors
are two Parquet tables bucketed by slot at the index's path; rows never move again.

Searching: a query's probes go to the slots of its nearest cells, once to each, where products with the decoded rows rank them; the best few of
each query are compared exactly. Only probes and candidates are shuffled, codes and vectors are read where they lie. A slot that very
many queries probe is searched in blocks of them. exact=True goes on to every cell that, by its radius and the k-th
best found so far, may still hold a neighbour, so that the result is that of comparing all rows.

Vectors that are null, without length or of another dimension are neither found nor searched for.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: Most sampled rows the model is fitted on, and most cells.
SAMPLE = 65_536
MAX_CELLS = 4096
#: Slots, about, that small cells are put together in.
SHELVES = 48


@dataclass(frozen=True)
class IndexConfig:
    #: None: the square root of the rows, MAX_CELLS at most.
    cells: int | None = None
    parts: int = 16
    codes: int = 256
    sample: int = SAMPLE
    slot_rows: int = 65_536
    #: Queries that a slot is searched for at once.
    slot_queries: int = 16_384
    rounds: int = 12


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    codes: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    #: (parts, codes, components of a part), zeros beyond the last component.
    books: np.ndarray
    #: By cell: first slot, slots, rows, radius.
    first: np.ndarray
    slots: np.ndarray
    rows: np.ndarray
    radius: np.ndarray
    config: IndexConfig


def _rows(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors of a length, those at length 1)."""
    n = np.array([len(v) if v.is_valid else -1 for v in column]) if column.null_count else np.diff(column.offsets.to_numpy())
    dims = dims if dims is not None else int(np.bincount(np.maximum(n, 0), minlength=1).argmax())  # the most usual one
    keep = np.flatnonzero((n == dims) & (n > 0))
    x = column.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keep), -1 if len(keep) else max(dims, 1))
    size = np.sqrt((x * x).sum(axis=1))
    fine = np.isfinite(size) & (size > 0)
    return keep[fine], x[fine] / size[fine, None]


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + block] @ centres.T).argmin(axis=1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means on a sample; one that nothing is near to takes a sampled row."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        order = np.argsort(own, kind="stable")
        there, at = np.unique(own[order], return_index=True)
        c[there] = np.add.reduceat(x[order], at) / np.diff(np.append(at, len(x)))[:, None]
        empty = np.setdiff1d(np.arange(k), there)
        c[empty] = x[rng.choice(len(x), len(empty))]
    return c


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, components of a part)."""
    width = -(-x.shape[1] // parts)
    wide = np.zeros((len(x), parts * width))
    wide[:, : x.shape[1]] = x
    return wide.reshape(len(x), parts, width).transpose(1, 0, 2)


def _encode(centroids: np.ndarray, books: np.ndarray):
    def run(batches):
        for b in batches:
            at, x = _rows(b.column(1), centroids.shape[1])
            cell = _nearest(x, centroids)
            rest = x - centroids[cell]
            code = np.stack([_nearest(p, book) for p, book in zip(_split(rest, len(books)), books)], axis=1).astype(np.uint8)
            own = b.take(pa.array(at))
            yield pa.record_batch([own.column(0), pa.array(cell, pa.int32()), pa.array(np.sqrt((rest * rest).sum(axis=1))), pa.array([c.tobytes() for c in code], pa.binary()), own.column(1)], ["id", "cell", "away", "code", "vector"])

    return run


def _shelved(centroids: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of each cell: more than one for large cells; small ones, neighbours beside each other, share."""
    slots, first = np.maximum(1, -(-rows // most)), np.zeros(len(rows), np.int64)
    shelf, held, at = min(most, max(1, int(rows.sum()) // SHELVES)), 0, -1
    for c in np.argsort(_nearest(centroids, _lloyd(centroids, max(1, int(np.sqrt(len(centroids)))), 8, 3)), kind="stable"):
        if slots[c] > 1 or at < 0 or held + rows[c] > shelf:
            at, held = at + 1, 0
        first[c], held = at, held + rows[c]
        if slots[c] > 1:
            at, held = at + slots[c] - 1, most
    return first, slots


def _bucketed(df: DataFrame, path: str, buckets: int) -> None:
    name = f"vector_index_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "slot").sortBy("slot").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def build(vectors: DataFrame, path: str, cfg: IndexConfig = IndexConfig(), id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Index every row of vectors in the folder `path`, which is new."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(F.size("vector") > 0)
    sample = x.orderBy(F.xxhash64("id")).limit(cfg.sample).select("vector").toArrow()["vector"].combine_chunks()  # bounded
    _, points = _rows(sample if isinstance(sample, pa.Array) else sample.combine_chunks())
    if not len(points):
        raise ValueError("no vectors")
    cells = cfg.cells or max(1, min(MAX_CELLS, int(np.sqrt(x.count()))))
    centroids = _lloyd(points, cells, cfg.rounds, 1)
    rest = _split(points - centroids[_nearest(points, centroids)], min(cfg.parts, points.shape[1]))
    books = np.stack([_lloyd(p, cfg.codes, cfg.rounds, 2 + i) for i, p in enumerate(rest)])
    x.mapInArrow(_encode(centroids, books), "id long, cell int, away double, code binary, vector array<float>").write.parquet(f"{path}/coded")
    coded = spark.read.parquet(f"{path}/coded")
    sizes = coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()  # a row for each cell
    rows, radius = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in sizes:
        rows[r.cell], radius[r.cell] = r.n, r.r
    first, slots = _shelved(centroids, rows, cfg.slot_rows)
    total = int((first + slots).max())
    cell = [(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, slots))]
    placed = coded.join(F.broadcast(spark.createDataFrame(cell, "cell int, first int, slots int")), "cell")  # MAX_CELLS rows at most
    placed = placed.withColumn("slot", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("slots"))).cast("int"))
    buckets = int(max(1, min(total, max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.sum() // 1_000_000), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))))
    # One task writes each bucket: slots are small, and a task has few of them.
    placed = placed.repartition(buckets, "slot")
    _bucketed(placed.select("slot", "cell", "id", "code"), f"{path}/codes", buckets)
    _bucketed(placed.select("slot", "id", "vector"), f"{path}/vectors", buckets)
    model = [(buckets, i, c.tolist(), int(a), int(s), int(n), float(r)) for i, (c, a, s, n, r) in enumerate(zip(centroids, first, slots, rows, radius))]
    spark.createDataFrame(model, "buckets int, cell int, centroid array<double>, first int, slots int, rows long, radius double").coalesce(1).write.parquet(f"{path}/cells")
    entries = [(p, k, e.tolist()) for p, book in enumerate(books) for k, e in enumerate(book)]
    spark.createDataFrame(entries, "part int, code int, entry array<double>").coalesce(1).write.parquet(f"{path}/books")
    return open_index(spark, path, cfg)


def open_index(spark: SparkSession, path: str, cfg: IndexConfig = IndexConfig()) -> VectorIndex:
    """An index that lies at `path`."""
    path = path.rstrip("/")
    cells = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)  # MAX_CELLS rows at most
    entries = sorted(spark.read.parquet(f"{path}/books").collect(), key=lambda r: (r.part, r.code))  # parts x codes rows
    books = np.array([r.entry for r in entries]).reshape(entries[-1].part + 1, entries[-1].code + 1, -1)

    def table(name: str, columns: str) -> DataFrame:
        view = f"vector_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {view} ({columns}) USING parquet CLUSTERED BY (slot) SORTED BY (slot) INTO {cells[0].buckets} BUCKETS LOCATION '{path}/{name}'")
        return spark.table(view)

    column = lambda name: np.array([r[name] for r in cells])
    return VectorIndex(
        spark, path, table("codes", "slot INT, cell INT, id BIGINT, code BINARY"), table("vectors", "slot INT, id BIGINT, vector ARRAY<FLOAT>"), column("centroid"), books,
        column("first"), column("slots"), column("rows"), column("radius"), cfg,
    )


def _probes(index: VectorIndex, probes: int):
    """Each query's nearest cells with rows, by slot."""
    full = np.flatnonzero(index.rows)
    c, first, slots = index.centroids[full], index.first[full], index.slots[full]
    half = (c * c).sum(axis=1) / 2

    def run(batches):
        for b in batches:
            at, q = _rows(b.column(1), c.shape[1])
            for lo in range(0, len(q), 1024):
                x, own = q[lo : lo + 1024], b.column(0).take(pa.array(at[lo : lo + 1024]))
                near = np.argpartition(half - x @ c.T, min(probes, len(c)) - 1, axis=1)[:, :probes]
                row, slot = _slots_of(np.repeat(np.arange(len(x)), near.shape[1]), first[near].ravel(), slots[near].ravel())
                yield _query_batch(own.take(pa.array(row)), x[row], slot)

    return run


def _slots_of(row: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of rows' cells, each once."""
    slot = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    pairs = np.unique(np.stack([np.repeat(row, n), slot], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _query_batch(ids: pa.Array, x: np.ndarray, slot: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
    return pa.record_batch([ids, pa.array(slot, pa.int32()), lists], ["query_id", "slot", "q"])


PROBE = "query_id long, slot int, q array<double>"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where (row, column) the k best of each row are; ties to the lower id, none that isn't finite."""
    if scores.shape[1] > 4 * k:
        row, column = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k][:, None])
    else:
        row, column = np.divmod(np.arange(scores.size), max(1, scores.shape[1]))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (rank < k) & np.isfinite(scores[row, column])
    return row[keep], column[keep]


def _best_products(who: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, id, product) of the k best other rows, by blocks of queries."""
    out = []
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ x.T
        s[who[lo : lo + 256, None] == own[None, :]] = -np.inf
        row, column = _best(own, s, k)
        out.append((who[lo + row], own[column], s[row, column]))
    return out


def _scan_codes(index: VectorIndex, keep: int):
    """A slot's decoded rows by their products with each query: the `keep` best."""
    books, centroids = index.books, index.centroids

    def run(key, queries: pa.Table, codes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and codes.num_rows:
            own = codes["id"].to_numpy()
            code = np.frombuffer(b"".join(codes["code"].to_pylist()), dtype=np.uint8).reshape(len(own), -1)
            x = np.concatenate([book[code[:, p]] for p, book in enumerate(books)], axis=1)[:, : centroids.shape[1]] + centroids[codes["cell"].to_numpy()]
            out = _best_products(queries["query_id"].to_numpy(), _matrix(queries["q"]), own, x, keep)
        who, ids, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": who, "slot": pa.array(np.full(len(who), key[0].as_py()), pa.int32()), "id": ids, "score": s})

    return run


def _compare(k: int):
    """Exact cosines of a slot's vectors: of all of them, or of the named ids."""

    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        named = "id" in queries.column_names
        out: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            own = vectors["id"].to_numpy()
            x = _matrix(vectors["vector"])
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            q, who = _matrix(queries["q"]), queries["query_id"].to_numpy()
            if named:
                order = np.argsort(own, kind="stable")
                at = order[np.searchsorted(own[order], queries["id"].to_numpy())]
                out.append((who, own[at], np.einsum("ij,ij->i", q, x[at])))
            else:
                out = _best_products(who, q, own, x, k)
        who, ids, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": who, "id": ids, "cosine": s})

    return run


def _by_slot(index: VectorIndex, queries: DataFrame, table: DataFrame, run, schema: str) -> DataFrame:
    """run(slot, its queries, its rows): rows stay in their buckets. A slot that more than `slot_queries` ask for is dealt out in
    blocks of queries, each with the slot's rows."""
    hot = queries.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > index.config.slot_queries)
    hot = hot.select("slot", F.ceil(F.col("n") / index.config.slot_queries).cast("int").alias("_blocks"))
    many = {r.slot: r._blocks for r in hot.collect()}  # a row for each slot_queries probes at most
    asked = lambda q, t, *by: q.groupBy("slot", *by).cogroup(t.groupBy("slot", *by)).applyInArrow(run, schema)
    if not many:
        return asked(queries, table)
    cold = ~F.col("slot").isin(list(many))
    hot = F.broadcast(index.spark.createDataFrame(list(many.items()), "slot int, _blocks int"))
    q = queries.join(hot, "slot").withColumn("_block", F.pmod(F.xxhash64("query_id"), "_blocks").cast("int")).drop("_blocks")
    t = table.join(hot, "slot").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    return asked(queries.where(cold), table.where(cold)).unionByName(asked(q, t, "_block"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    x = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")))
    return x.where(F.col("rank") <= k).select("query_id", "id", "cosine", "rank")


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 16, rerank: int = 64, exact: bool = False, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, cosine, rank): each query's k nearest other rows."""
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))
    asked = q.mapInArrow(_probes(index, probes), PROBE)
    codes = _by_slot(index, asked, index.codes, _scan_codes(index, rerank), "query_id long, slot int, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    few = codes.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= rerank).drop("_n", "score")
    units = q.mapInArrow(_units(index.centroids.shape[1]), "query_id long, q array<double>")
    near = _by_slot(index, few.join(units, "query_id"), index.vectors, _compare(k), "query_id long, id long, cosine double")
    found = _ranked(near, k)
    if not exact:
        return found
    far = units.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")), "query_id", "left")
    rest = far.select("query_id", "q", F.when(F.col("n") >= k, F.col("least")).alias("least")).mapInArrow(_unseen(index), PROBE)
    return _ranked(_by_slot(index, rest, index.vectors, _compare(k), "query_id long, id long, cosine double"), k)


def _units(dims: int):
    def run(batches):
        for b in batches:
            at, x = _rows(b.column(1), dims)
            yield pa.record_batch([b.column(0).take(pa.array(at)), _query_batch(b.column(0).take(pa.array(at)), x, np.zeros(len(x), np.int32)).column(2)], ["query_id", "q"])

    return run


def _unseen(index: VectorIndex):
    """The slots of every cell that may hold a row nearer than the k-th found: |q - row| >= |q - centroid| - radius."""
    full = np.flatnonzero(index.rows)
    c, first, slots, radius = (x[full] for x in (index.centroids, index.first, index.slots, index.radius))
    square = (c * c).sum(axis=1)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, c.shape[1])
            least = b.column(2).to_numpy(zero_copy_only=False)
            reach = np.sqrt(np.maximum(0, 2 - 2 * np.where(np.isnan(least), -1, least)))  # distance of the k-th, 2 where there are fewer
            for lo in range(0, len(x), 1024):
                d = np.sqrt(np.maximum(0, 1 + square[None, :] - 2 * x[lo : lo + 1024] @ c.T))
                row, cell = np.nonzero(d - radius[None, :] <= reach[lo : lo + 1024, None] + 1e-6)
                row, slot = _slots_of(row, first[cell], slots[cell])
                yield _query_batch(b.column(0).take(pa.array(lo + row)), x[lo + row], slot)

    return run


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(queries, recall): which part of the true neighbours was found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return true.join(hit, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count(F.lit(1))).alias("recall"))


def tuned_probes(index: VectorIndex, queries: DataFrame, k: int, target: float = 0.95, rerank: int = 64, sample: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> int:
    """The fewest probes, doubling from 4, with which a bounded sample of the queries finds `target` of its true neighbours."""
    few = queries.select(id_col, vector).orderBy(F.xxhash64(id_col)).limit(sample).persist()
    try:
        true = search(index, few, k, rerank=rerank, exact=True, id_col=id_col, vector=vector).persist()
        probes, cells = 4, int((index.rows > 0).sum())
        while probes < cells and (recall(search(index, few, k, probes, rerank, id_col=id_col, vector=vector), true).first().recall or 0) < target:
            probes *= 2
        true.unpersist()
        return min(probes, cells)
    finally:
        few.unpersist()
