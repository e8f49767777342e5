"""Substring dedup against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import pytest

from conftest import SF
from ticketloom.llm import _chunks, queries, substring_dedup

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [W.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((len(w), keep.count(False), " ".join(x for x, k in zip(w, keep) if k)))
    return out


@pytest.mark.parametrize("window", [35, 4, 10])
def test_brute(spark, window, monkeypatch):
    monkeypatch.setattr(_chunks, "CHUNK_BYTES", 20000)
    random.seed(window)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [None, "", " \n ", "few words", passage, f"a b {passage} c", passage.replace(" ", "\n\t"), "x " * 200, "é中 " * 50]
    for _ in range(200):
        t = [random.choice("abcdefg") * random.randint(1, 2) for _ in range(random.randint(1, 80))]
        if random.random() < 0.3:
            t[random.randint(0, len(t)) : 0] = passage.split()[random.randint(0, 4) :]
        texts.append(" ".join(t))
    texts += [texts[-1], texts[20], " ".join(f"long{i}" for i in range(9000))]
    rows = [(i, t, "n", 5, "w", None, 3, "row") for i, t in enumerate(texts)]
    x = spark.createDataFrame(rows, "doc_id long, text string, _kept string, _chunk int, _n_words string, _n_removed int, bucket int, _row string").repartition(3)
    want = brute(texts, window)
    got = substring_dedup.remove_repeats(x, window).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r._n_words, r._n_removed, r._kept) == want[r._row.doc_id] and r._row.text == texts[r._row.doc_id] and r._row._chunk == 5 and r._row._kept == "n"
    kept = substring_dedup.drop_repeats(x, window)
    assert kept.columns == x.columns
    clean = {r.doc_id: r for r in kept.collect()}
    assert all(tuple(r)[2:] == rows[r.doc_id][2:] for r in clean.values())
    assert clean[0].text is None and clean[2].text == " \n "
    assert all(clean[i].text == (want[i][2] if want[i][1] else t) for i, t in enumerate(texts))


def test_nothing_to_find(spark):
    x = spark.createDataFrame([(1, "only one"), (2, "another")], "doc_id long, text string")
    assert {r._n_removed for r in substring_dedup.remove_repeats(x).collect()} == {0}
    assert substring_dedup.remove_repeats(x.limit(0)).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: w for r, w in zip(rows, brute([r.text for r in rows], 35))}
    got = queries.op6_substring_dedup(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        n, cut, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, cut, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("n", [1024, 65536])
def test_structured_words(spark, n):
    """Windows that differ in one word that polynomial hashes take for its complement don't repeat."""
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    u = t.translate({97: 98, 98: 97})
    head = " ".join(f"w{i}" for i in range(34))
    x = spark.createDataFrame([(1, f"{head} q{t}q"), (2, f"{head} q{u}q"), (3, f"{head} {t}"), (4, f"{head} {u}")], "doc_id long, text string")
    assert {r._n_removed for r in substring_dedup.remove_repeats(x).collect()} == {0}
