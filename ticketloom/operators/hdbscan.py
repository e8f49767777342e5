"""HDBSCAN (Campello, Moulavi, Sander 2013) with the epsilon threshold of Malzer and Baum (2020).

cluster() takes every row into account at every size. Up to MAX_EXACT rows distances are taken in blocks on the executors
against the matrix of all rows, which is broadcast; core distances are one pass, the minimum spanning tree a pass for
each of Boruvka's rounds (as many as the logarithm of the rows). Beyond that the tree is made from pairs of blocks
(hdbscan_blocks); it is the same tree, as ties are broken by (weight, row, row) in both. Tree condensing and selection run on
the driver over the tree's edges, one for each row (24 bytes).

fit() makes a model that assign() gives other rows by, of at most `max_exact` rows: of more it takes a uniform sample by hash,
and every other row takes the cluster of its nearest fitted row if it lies within that row's reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.operators import hdbscan_blocks

MAX_EXACT = 20_000
_BLOCK = 256


@dataclass(frozen=True)
class Fitted:
    ids: list
    points: np.ndarray
    labels: np.ndarray
    probabilities: np.ndarray
    core: np.ndarray


def _distances(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    # By differences, not by products: equal rows are at distance 0 exactly.
    out = np.empty((len(q), len(points)))
    for i, x in enumerate(q):
        d = points - x
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def core_distances(spark, points: np.ndarray, k: int) -> np.ndarray:
    """Distance to the k-th nearest row, itself counted."""
    n = len(points)
    shared = spark.sparkContext.broadcast(points)
    k = min(k, n)

    def run(batches):
        p = shared.value
        for b in batches:
            for i in b.column(0).to_pylist():
                rows = np.arange(i * _BLOCK, min(n, (i + 1) * _BLOCK))
                d = _distances(p[rows], p)
                yield pa.record_batch([pa.array(rows), pa.array(np.partition(d, k - 1, axis=1)[:, k - 1])], ["i", "core"])

    out = np.zeros(n)
    for r in _blocks(spark, n).mapInArrow(run, "i long, core double").collect():  # n <= MAX_EXACT rows
        out[r.i] = r.core
    return out


def _blocks(spark, n: int) -> DataFrame:
    m = -(-n // _BLOCK)
    return spark.range(0, m, 1, min(m, 4 * spark.sparkContext.defaultParallelism))


def spanning_tree(spark, points: np.ndarray, core: np.ndarray) -> np.ndarray:
    """(n - 1) x 3: row, row, mutual reachability, sorted by (weight, row, row)."""
    n = len(points)
    base = spark.sparkContext.broadcast((points, core))
    root = np.arange(n)
    edges = []
    while len(set(root)) > 1:
        comp = spark.sparkContext.broadcast(root)

        def run(batches):
            p, c = base.value
            r = comp.value
            for b in batches:
                for i in b.column(0).to_pylist():
                    rows = np.arange(i * _BLOCK, min(n, (i + 1) * _BLOCK))
                    d = np.maximum(_distances(p[rows], p), np.maximum(c[rows][:, None], c[None, :]))
                    d[r[rows][:, None] == r[None, :]] = np.inf
                    j = d.argmin(axis=1)
                    yield pa.record_batch([pa.array(rows), pa.array(j), pa.array(d[np.arange(len(rows)), j])], ["u", "v", "w"])

        best: dict = {}
        for e in _blocks(spark, n).mapInArrow(run, "u long, v long, w double").collect():  # n rows
            key = (e.w, min(e.u, e.v), max(e.u, e.v))
            c = root[e.u]
            if c not in best or key < best[c]:
                best[c] = key
        parent = {int(x): int(x) for x in set(root)}

        def find(a):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for w, u, v in sorted(set(best.values())):
            a, b = find(int(root[u])), find(int(root[v]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((u, v, w))
        root = np.array([find(int(x)) for x in root])
    return np.array(sorted(edges, key=lambda e: (e[2], e[0], e[1]))).reshape(-1, 3)


def select_clusters(tree: np.ndarray, n: int, min_cluster_size: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(label, probability) of each row from a spanning tree: condensed tree, excess of mass, epsilon. Noise is -1, 0."""
    labels, probabilities = np.full(n, -1), np.zeros(n)
    if n < 2:
        return labels, probabilities
    # Single linkage: node n + i joins two nodes at a distance.
    group, left, right, height, size = list(range(n)), {}, {}, {}, {i: 1 for i in range(n)}

    def find(a):
        while group[a] != a:
            group[a] = group[group[a]]
            a = group[a]
        return a

    for i, (u, v, w) in enumerate(zip(tree[:, 0].astype(int).tolist(), tree[:, 1].astype(int).tolist(), tree[:, 2].tolist())):
        a, b, new = find(u), find(v), n + i
        group += [new]
        group[a] = group[b] = new
        left[new], right[new], height[new], size[new] = a, b, w, size[a] + size[b]
    top = n + len(tree) - 1

    def leaves(node):
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < n:
                out.append(x)
            else:
                todo += [left[x], right[x]]
        return out

    inv = lambda d: 1 / d if d > 0 else np.inf
    # Condensed: clusters with their birth, the rows that fall out and when, and their children.
    birth, parent, rows, children = {0: 0.0}, {0: None}, {0: []}, {0: []}
    todo = [(top, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            rows[c].append((node, inv(0.0)))
            continue
        lam, a, b = inv(height[node]), left[node], right[node]
        big = [x for x in (a, b) if size[x] >= min_cluster_size]
        if len(big) == 2:
            for x in (a, b):
                k = len(birth)
                birth[k], parent[k], rows[k], children[k] = lam, c, [], []
                children[c].append(k)
                todo.append((x, k))
        else:
            for x in (a, b):
                if x in big:
                    todo.append((x, c))
                else:
                    rows[c] += [(leaf, lam) for leaf in leaves(x)]
    members = {c: len(rows[c]) for c in birth}
    for c in sorted(birth, reverse=True):
        if parent[c] is not None:
            members[parent[c]] += members[c]
    finite = [lam for r in rows.values() for _, lam in r if np.isfinite(lam)] + [x for x in birth.values() if np.isfinite(x)]
    most = 2 * max(finite, default=1.0) + 1  # stands for infinity: rows at distance 0
    cap = lambda lam: min(lam, most)
    stability = {c: sum(cap(lam) - cap(birth[c]) for _, lam in rows[c]) + sum(members[k] * (cap(birth[k]) - cap(birth[c])) for k in children[c]) for c in birth}
    better, total = set(), {}
    for c in sorted(birth, reverse=True):
        below = sum(total[k] for k in children[c])
        if c == 0:
            continue  # the root is no cluster
        if children[c] and below > stability[c]:
            total[c] = below
        else:
            total[c] = stability[c]
            better.add(c)
    chosen = _topmost(better, parent)
    if epsilon > 0:
        merged = set()
        for c in sorted(chosen):
            while inv(birth[c]) < epsilon and parent[c] not in (0, None):
                c = parent[c]
            merged.add(c)
        chosen = _topmost(merged, parent)
    for number, c in enumerate(sorted(chosen)):
        own, todo = [], [c]
        while todo:
            k = todo.pop()
            own += rows[k]
            todo += children[k]
        peak = max(cap(lam) for _, lam in own)
        for i, lam in own:
            labels[i], probabilities[i] = number, (cap(lam) / peak if peak > 0 else 1.0)
    return labels, np.clip(probabilities, 0, 1)


def _topmost(some: set, parent: dict) -> set:
    """Those of some clusters that no other of them is above; parents have lower numbers."""
    under, out = {}, set()
    for c in sorted(parent):
        under[c] = parent[c] is not None and (parent[c] in some or under[parent[c]])
        if c in some and not under[c]:
            out.add(c)
    return out


def fit(df: DataFrame, min_cluster_size: int = 10, epsilon: float = 0.5, min_samples: int | None = None, id_col: str = "issue_id", vector: str = "embedding", max_exact: int = MAX_EXACT) -> Fitted:
    spark = df.sparkSession
    x = df.select(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = x.orderBy(F.xxhash64("i"), "i").limit(max_exact).collect()  # max_exact rows
    rows.sort(key=lambda r: r.i)
    points = np.array([r.v for r in rows], dtype=np.float64)
    n = len(rows)
    if n < 2:
        return Fitted([r.i for r in rows], points, np.full(n, -1), np.zeros(n), np.zeros(n))
    core = core_distances(spark, points, min_samples or min_cluster_size)
    labels, p = select_clusters(spanning_tree(spark, points, core), n, min_cluster_size, epsilon)
    return Fitted([r.i for r in rows], points, labels, p, core)


def cluster(df: DataFrame, min_cluster_size: int = 10, epsilon: float = 0.5, min_samples: int | None = None, id_col: str = "issue_id", vector: str = "embedding", max_exact: int = MAX_EXACT, block: int = hdbscan_blocks.BLOCK) -> DataFrame:
    """df with _label and _probability, of all its rows; rows without a vector are noise."""
    there = df.where(F.col(vector).isNotNull())
    if there.limit(max_exact + 1).count() <= max_exact:
        return assign(df, fit(df, min_cluster_size, epsilon, min_samples, id_col, vector, max_exact), id_col, vector)
    spark, folder = df.sparkSession, hdbscan_blocks.fresh_path(df.sparkSession)
    df.withColumn("_r", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    own = rows.where(F.col(vector).isNotNull())
    own.select("_r", F.col(id_col).alias("_i")).orderBy("_i", "_r").select("_r", F.monotonically_increasing_id().alias("_n")).write.parquet(f"{folder}/numbers")  # in the order of ids
    numbers = spark.read.parquet(f"{folder}/numbers")
    tree = hdbscan_blocks.spanning_tree(own.select("_r", F.col(vector).alias("v")).join(numbers, "_r").select(F.col("_n").alias("n"), "v"), min_samples or min_cluster_size, block)
    labels, p = select_clusters(tree.edges, len(tree.numbers), min_cluster_size, epsilon)
    # The driver made the labels: they go to the rows, three numbers each, not the rows with their texts to them.
    known = spark.createDataFrame(pa.table({"_n": tree.numbers, "_label": pa.array(labels, pa.int32()), "_probability": p})).join(numbers, "_n").drop("_n")
    x = rows.join(F.broadcast(known), "_r", "left").withColumns({"_label": F.coalesce("_label", F.lit(-1)), "_probability": F.coalesce("_probability", F.lit(0.0))})
    return x.select(*[F.col(f"`{c}`") for c in df.columns], "_label", "_probability")


def assign(df: DataFrame, model: Fitted, id_col: str = "issue_id", vector: str = "embedding") -> DataFrame:
    """df with _label and _probability: of its own for fitted rows, of the nearest fitted row within reach for others."""
    shared = df.sparkSession.sparkContext.broadcast((model, {x: i for i, x in enumerate(model.ids)}))
    at, vec = df.columns.index(id_col), df.columns.index(vector)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "_label int, _probability double"])

    def nearest(q: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and distance of each row's nearest point: by products first, then the closest few by differences."""
        near = (points * points).sum(axis=1)[None, :] - 2 * q @ points.T
        few = min(8, len(points))
        some = np.sort(np.argpartition(near, few - 1, axis=1)[:, :few], axis=1)
        d = np.sqrt(((q[:, None, :] - points[some]) ** 2).sum(axis=2))
        at = d.argmin(axis=1)
        return some[np.arange(len(q)), at], d[np.arange(len(q)), at]

    def run(batches):
        m, number = shared.value
        for b in batches:
            k = np.array([number.get(i, -1) for i in b.column(at).to_pylist()], dtype=np.int64)
            vectors = b.column(vec).to_pylist()
            rest = [i for i in np.flatnonzero(k < 0).tolist() if vectors[i] is not None] if len(m.points) else []
            for lo in range(0, len(rest), _BLOCK):
                rows = rest[lo : lo + _BLOCK]
                j, d = nearest(np.array([vectors[i] for i in rows], dtype=np.float64), m.points)
                k[rows] = np.where(d <= m.core[j], j, -1)
            found = k >= 0
            label, p = np.full(len(k), -1), np.zeros(len(k))
            label[found], p[found] = m.labels[k[found]], m.probabilities[k[found]]
            yield pa.record_batch([*b.columns, pa.array(label, pa.int32()), pa.array(p)], names=[*b.schema.names, "_label", "_probability"])

    return df.mapInArrow(run, schema)
