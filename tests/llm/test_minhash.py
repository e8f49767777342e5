"""MinHash forest against all pairs."""

import random
import re

import numpy as np
import pytest

from conftest import SF
from ticketloom.llm import _chunks, minhash_dedup, queries
from ticketloom.llm._components import connected_components

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        w = W.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(s), find(i)) for i, s in sets.items()}


def some_texts(seed):
    random.seed(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    for _ in range(25):
        base = [random.choice(words) for _ in range(random.randint(3, 120))]
        out.append(" ".join(base))
        for _ in range(random.randint(0, 6)):
            t = list(base)
            for _ in range(random.randint(0, 3)):
                t[random.randrange(len(t))] = random.choice(words)
            out.append("  ".join(t).upper() if random.random() < 0.2 else " ".join(t))
    return out + [None, "", " \n", None, "one two", "ONE\ttwo", "two one", "Ünï ünï", "long " + " ".join(f"x{i}" for i in range(20000))]


@pytest.mark.parametrize("crowd", [2048, 4])
def test_brute(spark, crowd, monkeypatch):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 5000)
    rows = list(enumerate(some_texts(crowd)))
    x = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component string, _chunk int").repartition(3)
    cfg = minhash_dedup.MinHashConfig(crowd=crowd)
    got = minhash_dedup.near_duplicates(x, cfg).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    wrong = [r for r in got if (r.n, r.component) != want[r.id]]
    assert not wrong
    kept = minhash_dedup.keep_one(x, cfg)
    assert kept.columns == x.columns
    assert {r.doc_id for r in kept.collect()} == {r.id for r in got if r.id == r.component}


@pytest.mark.parametrize("limits", [{"crowd": 4}, {"crowd": 3, "crowd_shingles": 300}, {"crowd_shingles": 150}])
def test_crowded_is_exact(spark, limits, monkeypatch):
    """Regions and groups beyond the size of a task lose no pair."""
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 5000)
    rows = list(enumerate(some_texts(4)))
    x = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = minhash_dedup.near_duplicates(x, minhash_dedup.MinHashConfig(**limits)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and [r for r in got if (r.n, r.component) != want[r.id]] == []


def test_common():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 5_000_000, n)).astype(np.uint64) for n in (1_500_000, 3_000_000))
    assert minhash_dedup.common(a, b) == minhash_dedup.common(b, a) == len(np.intersect1d(a, b))


def test_ids_and_empty(spark):
    text = "a b c d e f g h"
    x = spark.createDataFrame([(7, text), (7, text), (3, text + " i"), (None, text), (None, None)], "doc_id long, text string")
    got = minhash_dedup.near_duplicates(x, minhash_dedup.MinHashConfig(percent=70)).collect()
    assert sorted((r.id or -1, r.n, r.component) for r in got if r.n) == [(-1, 4, 3), (3, 5, 3), (7, 4, 3), (7, 4, 3)]
    assert minhash_dedup.near_duplicates(x.limit(0)).count() == 0
    assert [r.doc_id for r in minhash_dedup.keep_one(x, minhash_dedup.MinHashConfig(percent=70)).where("doc_id is not null").collect()] == [3]


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2400)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_exact_roots():
    rng = np.random.default_rng(0)
    for m, top in ((80, 60), (200, 400)):
        sets = [np.unique(rng.integers(0, top, rng.integers(1, 50))).astype(np.uint64) for _ in range(m)]
        sets += [np.unique(np.concatenate([sets[i % 20][2:], [np.uint64(top + i)]])) for i in range(m)]
        root = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= 80 * (len(a) + len(b) - both):
                        root[i] = root[j] = min(root[i], root[j])
            if all(root[r] == r for r in root):
                break
        assert minhash_dedup.exact_roots(sets, 80).tolist() == root


@pytest.mark.parametrize("crowd", [300, 40])
def test_hub(spark, crowd):
    """Copies of one text, each changed so far that only the text itself is near enough: one component at any crowd."""
    random.seed(8)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for n in range(600):
        t = list(base)
        for at in random.sample(range(10, 290, 10), 4):  # 20 of 296 shingles
            t[at] = f"x{n}_{at}"
        texts.append(" ".join(t))
    texts += [" ".join(f"y{random.randint(0, 10**9)}" for _ in range(40)) for _ in range(50)]
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.id: r.component for r in minhash_dedup.near_duplicates(x, minhash_dedup.MinHashConfig(crowd=crowd)).collect()}
    missed = [i for i in range(601) if got[i]]
    assert len(missed) <= 1 and all(got[i] == i for i in range(601, 651))  # at 0.87 a pair is missed once in 50,000


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash_forest(spark, SF).collect()}
    assert got == brute(rows)


def test_chunk_numbers(spark):
    """Each task's chunks fall into two of Spark's buckets."""
    from itertools import islice

    for task, n in ((0, 8), (5, 51), (70_000, 211)):
        ids = list(islice(_chunks.chunk_ids(task, n), 30))
        assert len(set(ids)) == 30
        spark_says = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "c long").selectExpr(f"pmod(hash(c), {n})").collect()]
        assert spark_says == _chunks.bucket_of(np.array(ids), n).tolist() and len(set(spark_says)) == 2


@pytest.mark.parametrize("n", [1024, 65536])
def test_structured_words(spark, n):
    """A word over two letters and its complement, which polynomial hashes take for one, are two texts."""
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    u = t.translate({97: 98, 98: 97})
    rows = [(1, f"q{t}q"), (2, f"q{u}q"), (3, t), (4, u), (5, f"one two three four {t}"), (6, f"one two three four {u}")]
    got = {r.id: r.component for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(1, 7)}
