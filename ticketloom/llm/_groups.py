"""Runs of equal keys in Arrow batches that are sorted by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def runs(batches, key: int = 0):
    """(table, where each run starts): whole runs of equal values of column `key`, a batch or more of them at a time."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if not t.num_rows:
            continue
        k = t.column(key).to_numpy()
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if not len(cuts):
            rest = t
            continue
        yield t.slice(0, cuts[-1]), np.concatenate([[0], cuts[:-1]])
        rest = t.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest, np.zeros(1, np.int64)


def spanning(links: np.ndarray) -> np.ndarray:
    """Each member's least connected member, from a symmetric boolean matrix."""
    n = len(links)
    root = np.full(n, -1)
    for i in range(n):
        if root[i] >= 0:
            continue
        inside = np.zeros(n, dtype=bool)
        front = np.array([i])
        while len(front):
            inside[front] = True
            front = np.flatnonzero(links[front].any(axis=0) & ~inside)
        root[inside] = i
    return root


def reached(n: int, linked) -> np.ndarray:
    """Each of n members' first member that it is connected to. linked(i, rest): which of `rest`, in order, i has a link to;
    it is asked for each member once, about those that nothing has reached yet."""
    root, left = np.arange(n), np.ones(n, dtype=bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start], todo = False, [start]
        while todo:
            rest = np.flatnonzero(left)
            if not len(rest):
                return root
            hit = rest[linked(todo.pop(), rest)]
            left[hit] = False
            root[hit] = start
            todo += hit.tolist()
    return root
