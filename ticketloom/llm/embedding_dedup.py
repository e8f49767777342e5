"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of length 1 with cosine >= c are at most D = 2 (1 - c) apart in squared distance. After a fixed random rotation
the space is split into blocks of `block_dims` dimensions; some block then holds at most its proportional share of D.
So each block is joined on its own: vectors within sqrt(share) of each other in the block's leading coordinates meet
in a grid cell of that width (home in one cell, guest in those of half of its neighbours whose walls are that near, so
each pair meets once), block distances within the share are candidates, and candidates are verified by their cosine in
double precision. Of random unit vectors of 64 dimensions about one pair in six million is a candidate in a block of
16 (one in four thousand in a block of 8), so verification costs next to nothing beside the distances. A
pair counts only in the first block that yields it, so links are counted without gathering pairs: a task sends each
vector's number of links and a spanning tree.

Copies (equal label and components) are one class with a weight. The number of grid coordinates follows the size of
a label; cells that are still crowded are split into pairs of parts, which are tasks of their own. The width of a cell is
about the spread of a coordinate, so the grid saves a constant share of the distances: they grow with the square of a
label's classes, as matrix products.

Defined results: null labels, null vectors, vectors of zeros or with null or non-finite components link with nothing;
vectors of different lengths don't either. Every row of the input gives a row; rows of the same id are separate
vectors. Ties at the threshold are links. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm import _text
from ticketloom.llm._components import connected_components
from ticketloom.llm._groups import runs, spanning
from ticketloom.llm._store import materialise, temporary
from ticketloom.llm._text import U


@dataclass(frozen=True)
class EmbeddingConfig:
    cosine: float = 0.93
    block_dims: int = 16
    #: Classes of a label from which the grid has two, three coordinates.
    finer: tuple = (20_000, 400_000)
    #: Vectors of a cell that one task compares.
    crowd: int = 2048
    seed: int = 7


def rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_edges(dims: int, cfg: EmbeddingConfig) -> np.ndarray:
    n = max(1, dims // cfg.block_dims)
    return np.linspace(0, dims, n + 1).astype(int)


def budgets(dims: int, cfg: EmbeddingConfig) -> np.ndarray:
    return 2 * (1 - cfg.cosine) * np.diff(block_edges(dims, cfg)) / dims * (1 + 1e-9)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """n x d doubles of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither vanish nor overflow.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _places(cfg: EmbeddingConfig):
    """Each class's home cell and guest cells in each block."""

    def run(batches):
        for b in batches:
            sizes = np.diff(np.asarray(b.column(1).offsets))
            for d in np.unique(sizes).tolist():
                rows = pa.array(np.flatnonzero(sizes == d))
                cls, label, many = (b.column(i).take(rows).to_numpy() for i in (0, 2, 3))
                x = _unit(_matrix(b.column(1).take(rows))) @ rotation(d, cfg.seed)
                edges, share = block_edges(d, cfg), budgets(d, cfg)
                for k in range(len(share)):
                    width = np.sqrt(share[k]) * (1 + 1e-6)
                    for g in (1, 2, 3):
                        own = np.flatnonzero(np.searchsorted(cfg.finer, many, side="right") + 1 == g)
                        if not len(own):
                            continue
                        coords = min(g, int(edges[k + 1] - edges[k]))
                        at = x[own, edges[k] : edges[k] + coords] / width
                        cell = np.floor(at).astype(np.int64)
                        # In widths: how far the next cells' walls are, squared.
                        wall = np.stack([(at - cell) ** 2, np.zeros(at.shape), (cell + 1 - at) ** 2])
                        for n, step in enumerate(np.ndindex(*(3,) * coords)):
                            if n < 3**coords // 2:
                                continue  # the other half of the neighbours
                            near = np.flatnonzero(sum(wall[s, :, c] for c, s in enumerate(step)) <= 1)
                            key = _text.mix(label[own[near]].astype(np.int64).view(U) ^ U(d * 1_000_003 + k * 31 + g))
                            for c, s in enumerate(step):
                                key = _text.mix(key ^ (cell[near, c] + (s - 1)).view(U) * U(0x9E3779B97F4A7C15))
                            home = n == 3**coords // 2
                            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(np.full(len(near), home)), pa.array(np.full(len(near), k, np.int32)), pa.array(cls[own[near]])], ["cell", "home", "block", "cls"])

    return run


def _compare(cfg: EmbeddingConfig):
    """Tasks of (part a, part b) of a cell: homes of a against homes of b, and of a against guests where a is b."""

    def pairs(x: np.ndarray, y: np.ndarray, k: int, share: float, edges: np.ndarray, same: bool):
        a, b = x[:, edges[k] : edges[k + 1]], y[:, edges[k] : edges[k + 1]]
        step = max(1, (1 << 22) // max(1, len(y)))
        for i in range(0, len(x), step):
            d = (a[i : i + step] ** 2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a[i : i + step] @ b.T
            p, q = np.nonzero(d <= share * (1 + 1e-6) + 1e-12)
            p += i
            if same:
                p, q = p[p < q], q[p < q]
            yield p, q

    def run(batches):
        for t, bounds in runs(batches):
            cls, w = t.column("cls").to_numpy(), t.column("w").to_numpy()
            home, part, a_part, b_part, block = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "part", "a", "b", "block"))
            vectors = t.column("embedding").combine_chunks()
            vectors = vectors if isinstance(vectors, pa.Array) else vectors.chunk(0)
            u, v, links = [], [], []
            for lo, hi in zip(bounds.tolist(), np.append(bounds[1:], len(cls)).tolist()):
                at = np.arange(lo, hi)
                h1 = at[home[lo:hi] & (part[lo:hi] == a_part[lo])]
                h2 = at[home[lo:hi] & (part[lo:hi] == b_part[lo])]
                guests = at[~home[lo:hi]]
                if not len(h1):
                    continue
                k = int(block[lo])
                raw = _matrix(vectors.slice(lo, hi - lo))
                dims = raw.shape[1]
                x = _unit(raw) @ rotation(dims, cfg.seed)
                edges, share = block_edges(dims, cfg), budgets(dims, cfg)
                one = a_part[lo] == b_part[lo]
                sides = [(h1, h1, True), (h1, guests, False)] if one else [(h1, h2, False)]
                got = np.zeros(hi - lo, np.int64)
                near_p, near_q = [], []
                for l, r, same in sides:
                    if not len(r):
                        continue
                    for p, q in pairs(x[l - lo], x[r - lo], k, share[k], edges, same):
                        p, q = l[p] - lo, r[q] - lo
                        for c in range(0, len(p), 1 << 16):
                            pp, qq = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
                            cos = (raw[pp] * raw[qq]).sum(axis=1) / (np.sqrt((raw[pp] ** 2).sum(axis=1)) * np.sqrt((raw[qq] ** 2).sum(axis=1)))
                            ok = cos >= cfg.cosine
                            pp, qq = pp[ok], qq[ok]
                            within = np.add.reduceat((x[pp] - x[qq]) ** 2, edges[:-1], axis=1) <= share
                            ok = within.argmax(axis=1) == k  # at most this block is the first
                            pp, qq = pp[ok], qq[ok]
                            np.add.at(got, pp, w[lo + qq])
                            np.add.at(got, qq, w[lo + pp])
                            near_p.append(pp)
                            near_q.append(qq)
                if near_p and (p := np.concatenate(near_p)).size:
                    q = np.concatenate(near_q)
                    own, both = np.unique(np.concatenate([p, q]), return_inverse=True)
                    m = np.zeros((len(own), len(own)), dtype=bool)
                    m[both[: len(p)], both[len(p) :]] = True
                    root = spanning(m | m.T)
                    far = np.flatnonzero(root != np.arange(len(root)))
                    u += [cls[lo + own[far]], cls[lo + own]]
                    v += [cls[lo + own[root[far]]], cls[lo + own]]
                    links += [np.zeros(len(far), np.int64), got[own]]
            if u:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (u, v, links)], ["u", "v", "links"])

    return run


def embedding_duplicates(vectors: DataFrame, cfg: EmbeddingConfig = EmbeddingConfig(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component: one row for each row of vectors."""
    with temporary() as keep:
        return _duplicates(vectors, cfg, id_col, vector_col, label_col, keep)


def _duplicates(vectors: DataFrame, cfg: EmbeddingConfig, id_col: str, vector_col: str, label_col: str, keep) -> DataFrame:
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = F.coalesce(F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(e, lambda c: c != 0), F.lit(False))
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    x = x.withColumn("cls", F.when(fine, F.xxhash64("label", F.size(e), "embedding")))
    classes = x.where("cls is not null").groupBy("cls", "label").agg(F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("w"), F.min("id").alias("least"))
    classes = materialise(classes, "classes")
    many = classes.groupBy("label").agg(F.count(F.lit(1)).alias("many"))
    places = classes.join(many, "label").select("cls", "embedding", "label", "many").mapInArrow(_places(cfg), "cell long, home boolean, block int, cls long")
    places = materialise(places, "places")
    sizes = places.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("all")).where("homes > 0 and all > 1")
    parts = F.ceil(F.greatest("homes", F.col("all") - F.col("homes")) / cfg.crowd).cast("int")
    y = places.join(sizes, "cell").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # A home of part i goes to the tasks (i, j) and (j, i), a guest to (i, i) for each part i.
    y = y.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.select("cls", "home", "block", "cell", "part", F.when(F.col("home"), F.least("part", "other")).otherwise(F.col("other")).alias("a"), F.when(F.col("home"), F.greatest("part", "other")).otherwise(F.col("other")).alias("b"))
    y = y.withColumn("task", F.xxhash64("cell", "a", "b")).join(classes.select("cls", "w", F.col("embedding")), "cls")
    y = y.select("task", "cls", "w", "home", "block", "part", "a", "b", "embedding").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "task").sortWithinPartitions("task")
    found = materialise(y.mapInArrow(_compare(cfg), "u long, v long, links long"), "links")
    links = found.where("u = v").groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("u <> v").select("u", "v"))
    c = classes.select("cls", "w", "least").join(links, "cls", "left").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = c.groupBy("root").agg(F.min("least").alias("component"))
    c = c.join(least, "root").select("cls", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = x.select("id", "cls").join(keep(materialise(c, "classes")), "cls", "left")
    return out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))
