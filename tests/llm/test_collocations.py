"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter

import pytest

from ticketloom.llm import collocations

LOW = {c: c + 32 for c in range(65, 91)}


def brute(rows, cfg):
    total, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, cfg.longest + 1):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    f = {k: a for k, a in f.items() if a >= cfg.least}
    out = {}
    for (lang, *p), a in f.items():
        if len(p) < 2:
            continue
        inside = lambda q: any(tuple(q[i : i + len(p)]) == tuple(p) for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
        if any(k[0] == lang and len(k) - 1 > len(p) and 100 * b >= cfg.cover_percent * a and inside(list(k[1:])) for k, b in f.items()):
            continue
        cuts = [(cfg.scale * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p))]
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[: cfg.top]))


def corpus(seed):
    random.seed(seed)
    words = ["the", "of", "a", "New", "york", "city", "ÉTÉ", "été", "x", "y", "ha", "\x1cz", "w" * 1500]
    weights = [30, 20, 15, 8, 8, 6, 3, 3, 4, 4, 10, 2, 1]
    rows = []
    for i in range(300):
        text = "".join(w + random.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ! ", "\r"]) for w in random.choices(words, weights, k=random.randint(0, 60)))
        rows.append((random.choice(["en", "en", "en", "fr", None, "und"]), text))
    rows += [("en", "ha ha ha ha ha")] * 40 + [("fr", None), ("de", ""), ("xx", "  . , \t "), ("en", "new york city hall " * 3000), ("en", "single"), ("it", "the the"), ("en", "the of " * 500)]
    return rows


SMALL = {"least": 5, "top": 40}


@pytest.mark.parametrize("extra", [{}, {"flush": 64, "bucket_words": 2000, "dictionary": 4}, {"dictionary": 0, "flush": 100}, {"bucket_words": 1000, "longest": 3, "cover_percent": 100, "top": 3}])
def test_brute(spark, extra):
    """Whole ranking, dealt by pivot, by phrase, and with words beyond the dictionary."""
    cfg = collocations.CollocationConfig(**SMALL | extra)
    rows = corpus(len(extra))
    x = spark.createDataFrame([(*r, 1, "b") for r in rows], "lang string, text string, gram int, word string").repartition(5)
    got = collocations.collocations(x, cfg)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, cfg)


def test_equal_row_hashes(spark, monkeypatch):
    """Phrases whose hashes are equal are counted apart."""
    import numpy as np

    monkeypatch.setattr(collocations, "_row_hash", lambda rows: np.zeros(len(rows), np.uint64))
    rows = np.array([[1, 2], [2, 1], [1, 2], [3, 3]] * 5, np.uint32)
    cfg = collocations.CollocationConfig(longest=2, least=3)
    import pyarrow as pa

    sent = [pa.record_batch([pa.array([0]), pa.array([2]), pa.array([rows.tobytes()]), pa.array([np.ones(20, np.int64).tobytes()])], ["bucket", "length", "ids", "counts"])]
    got = {tuple(g): a for b in collocations._mine(cfg, np.uint32)(sent) for g, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == {(1, 2): 10, (2, 1): 5, (3, 3): 5}


def test_wide_products(spark):
    """Counts whose products pass 64 bits."""
    huge = 4 * 10**17
    monkey = spark.createDataFrame([([1, 2], huge)], "gram array<long>, a long")
    named = spark.createDataFrame([(1, "en", "p", huge + 1), (2, "en", "q", 2 * huge)], "id long, lang string, word string, n long")
    totals = spark.createDataFrame([("en", 9 * 10**18)], "lang string, n long")
    r = collocations.ranked(monkey, named, totals, collocations.CollocationConfig()).first()
    assert r.score == 2_000_000 * huge // (3 * huge + 1) and r.n == 9 * 10**18


def test_empty(spark):
    x = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(x).count() == 0
