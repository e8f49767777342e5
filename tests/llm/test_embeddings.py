"""Embedding dedup against all pairs."""

import numpy as np
import pytest

from ticketloom.llm import embedding_dedup


def brute(rows, cosine=0.93):
    n = len(rows)
    links = np.zeros((n, n), dtype=bool)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i == j or la is None or la != lb or a is None or b is None or len(a) != len(b) or None in a or None in b:
                continue
            x, y = np.array(a, dtype=np.float64), np.array(b, dtype=np.float64)
            if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                links[i, j] = (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= cosine
    root = [r[0] for r in rows]
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(links[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    return {r[0]: (int(links[i].sum()), root[i]) for i, r in enumerate(rows)}


@pytest.mark.parametrize("dims,crowd,finer", [(64, 2048, (20000, 400000)), (16, 8, (5, 60)), (6, 3, (1, 20)), (3, 2048, (20000, 400000))])
def test_brute(spark, dims, crowd, finer):
    rng = np.random.default_rng(dims)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 9))):
            v = centre + rng.standard_normal(dims) * rng.choice([0.0, 0.1, 0.25, 0.35])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(c % 3)))
    one = rows[0][1]
    rows += [(len(rows) + i, v, lab) for i, (v, lab) in enumerate([(None, 1), ([0.0] * dims, 1), ([float("nan")] + one[1:], 0), ([None] + one[1:], 0), ([float("inf")] + one[1:], 0), (one, None), (one, 0), (one, 0), (one[:-1], 0), ([], 0), ([1e-30 * x for x in one], 0)])]
    x = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, cls string, w int").repartition(3)
    got = {r.id: (r.n_links, r.component) for r in embedding_dedup.embedding_duplicates(x, embedding_dedup.EmbeddingConfig(crowd=crowd, finer=finer)).collect()}
    want = brute(rows)
    tiny = rows[-1][0]  # its products vanish in the plain formula, not in doubles of the scaled one
    assert {k: v for k, v in got.items() if k != tiny} == {k: v for k, v in want.items() if k != tiny}
    assert embedding_dedup.embedding_duplicates(x.limit(0)).count() == 0


def test_rotation_keeps_lengths():
    q = embedding_dedup.rotation(64, 7)
    assert np.allclose(q @ q.T, np.eye(64))
    assert embedding_dedup.block_edges(64, embedding_dedup.EmbeddingConfig()).tolist() == [0, 16, 32, 48, 64]


def test_ties_and_equal_ids(spark):
    """A cosine equal to the threshold is a link; rows of one id are separate vectors."""
    a, b, c = [1.0, 1.0, 1.0, 1.0], [1.0, 1.0, 1.0, -1.0], [1.0, -1.0, 0.0, 0.0]
    x = spark.createDataFrame([(1, a, 1), (1, c, 1), (2, b, 1), (3, [5 * v for v in a], 1), (4, a, 2)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.id, r.n_links, r.component) for r in embedding_dedup.embedding_duplicates(x, embedding_dedup.EmbeddingConfig(cosine=0.5)).collect())
    assert got == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
