"""Near-duplicates by a MinHash LSH forest, confirmed on whole shingle sets.

Texts of equal shingle sets form a class at once. Each class has one signature of `trees * depth` minima. A tree sorts
the classes by its own rotation of the signature, so classes with a long common prefix are neighbours. The
candidates of a class are its neighbours in each tree's order, as far as they share a prefix of `shallow` minima with
it: how far that goes depends on the region, from no neighbour to thousands. In a region (a run of such neighbours) those
that agree in `agree` of all their minima are tied into candidate groups: what the first reaches goes on, and
nothing is compared again that has been reached, so a region of copies with small changes takes a few passes over it.
A region of more than `crowd` classes is split into parts, and every pair of parts meets in a task of its own.

The whole sets of a candidate group then meet in one task, where they are tied by exact comparison in the same way; groups
beyond the size of a task (`crowd` classes or `crowd_shingles` shingles) are split into parts that meet in pairs
likewise. The links found make the components.

What isn't linked: a pair at the threshold shares no region with probability (1 - 0.85**3)**10, about 7e-5, and agrees in
too few minima with probability 9e-6 (binomial), in regions of every size. Pairs of parts grow with the square of a
region's classes, as does the work where they are not alike; both are spread over as many tasks.

Texts are written once, bucketed by chunk, and never shuffled; sets of candidates only are. Classes, keys and edges
move by their hashes; copies never do.

Defined results: null and empty texts, or texts of white space, have no shingles and are linked with nothing, not even
with each other. Fewer than five words make one shingle. Rows of the same id are one document: each gets its row.
A null id is no candidate for the smallest id; a component of null ids only has a null id and keeps nothing. Empty tables give
empty results. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm import _text
from ticketloom.llm._chunks import Chunks
from ticketloom.llm._components import connected_components
from ticketloom.llm._groups import reached, runs
from ticketloom.llm._store import materialise, temporary
from ticketloom.llm._text import U


@dataclass(frozen=True)
class MinHashConfig:
    words: int = 5
    percent: int = 85
    trees: int = 10
    depth: int = 12
    shallow: int = 3
    agree: float = 0.7
    crowd: int = 2048
    crowd_shingles: int = 4_000_000


def _multipliers(n: int) -> np.ndarray:
    return (_text.mix(np.arange(1000, 1000 + n, dtype=U)) | U(1)).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, and where each text's begin (n + 1)."""
    h, _, _, first = _text.word_hashes(data, offsets, lower=True)
    n = np.diff(first)
    k, w = 1, h
    while k < words:
        to = min(2 * k, words)
        w, k = _text.double(w, k, to) if len(w) > to - k else w[:0], to
    at = _text.valid_windows(first, words) if len(h) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    few = np.flatnonzero((n > 0) & (n < words))
    short = np.zeros(len(few), dtype=U)
    for j in range(words - 1):
        there = n[few] > j
        short[there] = _text.mix(short[there] * U(0x9E3779B97F4A7C15) + h[first[few[there]] + j] + U(1))
    owner = np.concatenate([doc[at], few])
    value = np.concatenate([w[at], short])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def _class_ids(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set: two sums of scrambled members and the size, scrambled. Empty sets have 0."""
    sums = []
    for salt in (0x1234567, 0x89ABCDEF01):
        c = np.concatenate([np.zeros(1, dtype=U), np.cumsum(_text.mix(value ^ U(salt)), dtype=U)])
        sums.append(c[at[1:]] - c[at[:-1]])
    n = np.diff(at).astype(U)
    out = _text.mix(_text.mix(sums[0]) ^ (sums[1] * U(0x9E3779B97F4A7C15)) ^ n)
    out[n == 0] = 0
    return out.view(np.int64)


def _signatures(cfg: MinHashConfig):
    def run(batches):
        a = _multipliers(cfg.trees * cfg.depth)
        for b in batches:
            for lo, data, offsets in _text.chunks(b.column(0)):
                value, at = shingle_sets(data, offsets, cfg.words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sig = np.zeros((len(n), len(a)), dtype=np.uint32)
                x = (value >> U(32)).astype(np.uint32)
                for j, m in enumerate(a):
                    if len(full):
                        sig[full, j] = np.minimum.reduceat(x * m, at[:-1][full])
                raw = pa.array([r.tobytes() if k else None for r, k in zip(sig.astype(">u4"), n)], pa.binary())
                rows = slice(lo, lo + len(n))
                yield pa.record_batch([*(b.column(i).slice(lo, rows.stop - rows.start) for i in (1, 2, 3)), pa.array(n), pa.array(_class_ids(value, at)), raw], ["id", "chunk", "no", "n", "cls", "sig"])

    return run


def _edges_of_regions(cfg: MinHashConfig):
    least = cfg.agree * cfg.trees * cfg.depth

    def run(batches):
        for t, bounds in runs(batches):
            cls = t.column("cls").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint32).reshape(len(cls), -1)
            ends = np.append(bounds[1:], len(cls))
            u, v = [], []
            two = bounds[ends - bounds == 2]
            hit = (sig[two] == sig[two + 1]).sum(axis=1) >= least
            u.append(cls[two[hit]])
            v.append(cls[two[hit] + 1])
            for a, z in zip(bounds[ends - bounds > 2].tolist(), ends[ends - bounds > 2].tolist()):
                # In the order of the tree, so that neighbours of the longest common prefix come first.
                order = a + np.lexsort(sig[a:z].T[::-1])
                own, s = cls[order], sig[order]
                root = reached(len(own), lambda i, rest: (s[rest] == s[i]).sum(axis=1) >= least)
                at = np.flatnonzero(root != np.arange(len(root)))
                u.append(own[at])
                v.append(own[root[at]])
            yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share; the shorter one is looked up in blocks, nothing is copied whole."""
    a, b = sorted((a, b), key=len)
    n = 0
    for lo in range(0, len(a), 1 << 20):
        x = a[lo : lo + (1 << 20)]
        n += int((b[np.minimum(np.searchsorted(b, x), len(b) - 1)] == x).sum())
    return n


def exact_roots(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Each set's first set reachable by links of 100 * intersection >= percent * union. Elements of a set differ."""
    m = len(sets)
    n = np.array(list(map(len, sets)))
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(n)])
    held = np.zeros(int(col.max()) + 1 if len(col) else 0, dtype=np.int32)
    # Rows that are left, one after another; taken together anew whenever half of them are gone.
    rows, flat, at = np.arange(m), col, first[:-1]

    def linked(i: int, rest: np.ndarray) -> np.ndarray:
        nonlocal rows, flat, at
        if 2 * len(rest) < len(rows):
            rows, flat = rest, np.concatenate([col[first[k] : first[k + 1]] for k in rest])
            at = np.concatenate([[0], np.cumsum(n[rest])[:-1]])
        own = col[first[i] : first[i + 1]]
        held[own] = 1
        both = np.add.reduceat(held[flat], at)[np.searchsorted(rows, rest)]
        held[own] = 0
        return 100 * both.astype(np.int64) >= percent * (n[i] + n[rest] - both)

    return reached(m, linked)


def _verified(cfg: MinHashConfig):
    def run(batches):
        for t, bounds in runs(batches):
            cls, raw = t.column("cls").to_numpy(), t.column("hashes")
            u, v = [], []
            for a, z in zip(bounds.tolist(), np.append(bounds[1:], len(cls)).tolist()):
                own, first = np.unique(cls[a:z], return_index=True)  # a row may come more than once
                if len(own) < 2:
                    continue
                sets = [np.frombuffer(raw[a + int(i)].as_buffer(), dtype=U) for i in first]
                if len(own) == 2:
                    both = common(*sets)
                    if 100 * both >= cfg.percent * (len(sets[0]) + len(sets[1]) - both):
                        u.append(own[1:])
                        v.append(own[:1])
                    continue
                root = exact_roots(sets, cfg.percent)
                at = np.flatnonzero(root != np.arange(len(root)))
                u.append(own[at])
                v.append(own[root[at]])
            if u:
                yield pa.record_batch([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def _in_pairs(df: DataFrame, key: str, cls: str, parts) -> DataFrame:
    """df with `key` for the task: rows of a key with several parts go to the task of each pair that has their part."""
    x = df.withColumn("_parts", parts.cast("int")).withColumn("_part", F.pmod(F.xxhash64(cls), "_parts").cast("int"))
    x = x.withColumn("_other", F.explode(F.filter(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: (p != F.col("_part")) | (F.col("_parts") == 1))))
    task = F.xxhash64(key, F.least("_part", "_other"), F.greatest("_part", "_other"))
    return x.withColumn(key, F.when(F.col("_parts") == 1, F.col(key)).otherwise(task)).drop("_parts", "_part", "_other")


def _regions(reps: DataFrame, cfg: MinHashConfig) -> DataFrame:
    """(region, cls): classes that share a prefix of `shallow` minima in a tree, crowded regions as pairs of parts."""
    width, total = 4 * cfg.depth, 4 * cfg.depth * cfg.trees
    turned = F.concat(F.substring("sig", F.col("tree") * width + 1, total), F.substring("sig", F.lit(1), F.col("tree") * width))
    rows = reps.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))).alias("tree"))
    rows = rows.select("cls", F.xxhash64("tree", F.lit(cfg.shallow), F.substring(turned, F.lit(1), F.lit(4 * cfg.shallow))).alias("region"))
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    placed = materialise(rows.join(sizes, "region"), "regions")
    # Two parts together have `crowd` classes.
    return _in_pairs(placed, "region", "cls", F.when(F.col("c") <= cfg.crowd, 1).otherwise(F.ceil(2 * F.col("c") / cfg.crowd))).select("region", "cls")


def _by(df: DataFrame, key: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key)


def _components(chunks: Chunks, id_col: str, cfg: MinHashConfig) -> tuple[DataFrame, DataFrame]:
    """(rows: id, chunk, no, n, cls; roots: cls, root for classes that are linked)."""
    source = chunks.table.select("_text", F.col(f"_rest.`{id_col}`").cast("long").alias("id"), F.col("_chunk").alias("chunk"), F.col("_no").alias("no"))
    rows = materialise(source.mapInArrow(_signatures(cfg), "id long, chunk long, no int, n long, cls long, sig binary"), "signatures", rows=1000)
    # One row of each class: its least row; copies are combined before the shuffle.
    reps = rows.where("n > 0").groupBy("cls").agg(F.min(F.struct("chunk", "no")).alias("at"))
    reps = rows.join(reps.select("cls", "at.chunk", "at.no"), ["cls", "chunk", "no"]).select("cls", "n", "chunk", "no", "sig")
    reps = materialise(reps, "classes")
    regions = _regions(reps, cfg)
    near = _by(regions.join(reps.select("cls", "sig"), "cls").select("region", "cls", "sig"), "region")
    groups = connected_components(near.mapInArrow(_edges_of_regions(cfg), "u long, v long"))
    groups = groups.join(reps.select(F.col("cls").alias("node"), "n", "chunk", "no"), "node")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    groups = materialise(groups.join(sizes, "root"), "groups")
    fits = (F.col("c") <= cfg.crowd) & (F.col("s") <= cfg.crowd_shingles)
    parts = F.when(fits, 1).otherwise(F.least("c", F.ceil(F.greatest(2 * F.col("c") / cfg.crowd, 2 * F.col("s") / cfg.crowd_shingles))))
    some_large = not groups.where(~fits).isEmpty()
    wanted = _in_pairs(groups.withColumnRenamed("root", "key"), "key", "node", parts).select("key", F.col("node").alias("cls"), "chunk", "no")

    def fetch(t: pa.Table, w: pa.Table) -> pa.Table:
        w = w.combine_chunks()
        no = t["_no"].to_numpy()
        wanted_no = w["no"].to_numpy()
        rows_of, at_w = np.unique(wanted_no, return_inverse=True)
        place = np.argsort(no, kind="stable")
        where = place[np.searchsorted(no[place], rows_of)] if len(rows_of) else np.zeros(0, np.int64)
        sets = []
        if len(where):
            for _, data, offsets in _text.chunks(t["_text"].take(pa.array(where))):
                value, at = shingle_sets(data, offsets, cfg.words)
                sets += [value[a:z].tobytes() for a, z in zip(at.tolist(), at[1:].tolist())]
        return pa.table({"key": w["key"], "cls": w["cls"], "hashes": pa.array([sets[i] for i in at_w], pa.binary())})

    sets = chunks.table.select("_text", "_no", "_chunk").groupBy("_chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(fetch, "key long, cls long, hashes binary")
    links = materialise(_by(sets, "key").mapInArrow(_verified(cfg), "u long, v long"), "links", rows=500)
    if some_large:
        found = connected_components(links)
    else:  # a class is in one group, so the links are stars already
        found = links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return rows, materialise(found.select(F.col("node").alias("cls"), "root"), "roots")


def _labelled(rows: DataFrame, roots: DataFrame, keep=lambda table: table) -> DataFrame:
    """rows with component (least id of all linked classes). Ids are combined by class before the shuffle; one join of
    rows with classes, whose skewed partitions Spark can split."""
    least = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"))
    classes = least.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    components = classes.groupBy("root").agg(F.min("least").alias("least"))
    classes = keep(materialise(classes.select("cls", "root").join(components, "root").select("cls", "least"), "components"))
    x = keep(rows).drop("sig").join(classes, "cls", "left")
    return x.withColumn("component", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))).drop("least")


def near_duplicates(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n (shingles), component, one row for each row of docs."""
    with temporary() as keep:  # the copy of the texts goes with the tables in between
        chunks = Chunks(docs.select(id_col, text_col), text_col)
        return _labelled(*_components(chunks, id_col, cfg), keep).select("id", "n", "component")


def keep_one(docs: DataFrame, cfg: MinHashConfig = MinHashConfig(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without near-duplicates: of each component the smallest id stays. Columns as they came."""
    chunks = Chunks(docs, text_col)
    gone = _labelled(*_components(chunks, id_col, cfg)).where("not (id <=> component)").select("chunk", "no")

    def drop(t: pa.Table, g: pa.Table) -> pa.Table:
        keep = ~np.isin(t["_no"].to_numpy(), g["no"].to_numpy())
        return t.select(["_rest", "_text"]).filter(pa.array(keep))

    kept = chunks.table.groupBy("_chunk").cogroup(gone.groupBy("chunk")).applyInArrow(drop, chunks.schema())
    return kept.select(*chunks.original())
