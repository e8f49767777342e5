"""Ticket search against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from ticketloom.operators import ticket_search as ts

W = re.compile(r"[^\W_]+")


def brute(docs, queries, k, cfg):
    texts = {i: W.findall((t or "").lower()) for i, t in docs}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for t in texts.values() for w in set(t))
    out = []
    for q, text in queries:
        phrases = [p for p in (W.findall(p.lower()) for p in re.findall('"([^"]*)"', text or "")) if p]
        found = []
        for i, t in texts.items():
            if not all(any(t[a : a + len(p)] == p for a in range(len(t))) for p in phrases):
                continue
            tf = Counter(t)
            own = [w for w in set(W.findall((text or "").lower())) if tf[w]]
            if own:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (cfg.k1 + 1) / (tf[w] + cfg.k1 * (1 - cfg.b + cfg.b * len(t) / mean)) for w in own)
                found.append((-round(s, 6), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus():
    random.seed(3)
    vocabulary = ["the", "of", "printer", "fails", "login", "Ärger", "ärger", "page", "ha", "x1", "中文", "über", "café"]
    weights = [30, 20, 5, 5, 5, 2, 2, 4, 6, 2, 1, 1, 1]
    docs = [(i, " ".join(w + random.choice(["", "", ",", "_", "\n", "-"]) for w in random.choices(vocabulary, weights, k=random.randint(0, 50)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "!?"), (403, "the printer fails " * 3000), (404, "ha ha ha"), (405, "ha the ha")]
    queries = [(1, "printer"), (2, "printer fails login"), (3, '"printer fails"'), (4, '"ha ha ha" the'), (5, '"fails printer" "the of" page'), (6, "ÄRGER"), (7, "unknown"), (8, '"the unknown"'), (9, None), (10, ""), (11, '"" the'), (12, 'the the "the"'), (13, "中文 CAFÉ"), (14, '"unclosed the'), (15, '"ha the ha"')]
    return docs, queries


@pytest.mark.parametrize("cfg, named, broadcast", [(ts.SearchConfig(), 500, 50_000), (ts.SearchConfig(slot_postings=30, slots=7), 500, 50_000), (ts.SearchConfig(slot_postings=50, slots=16, k1=2.0, b=0.3), 3, 2)])
def test_brute(spark, tmp_path, monkeypatch, cfg, named, broadcast):
    """Ranks and phrases, with words spread over slots, and with more query words than are named or broadcast."""
    monkeypatch.setattr(ts, "NAMED", named)
    monkeypatch.setattr(ts, "BROADCAST", broadcast)
    docs, queries = corpus()
    d, q = spark.createDataFrame(docs, "issue_id int, description string").repartition(4), spark.createDataFrame(queries, "query_id int, query string")
    index = ts.build(d, str(tmp_path / "index"), cfg)
    want = brute(docs, queries, 5, cfg)
    assert {q for q, _, _ in want} >= {1, 2, 3, 4, 5, 6, 11, 12, 13, 14, 15} and not {q for q, _, _ in want} & {7, 8, 9, 10}
    for ix in (index, ts.open_index(spark, str(tmp_path / "index"), cfg, "int")):
        assert sorted((r.query_id, r.id, r["rank"]) for r in ts.search(ix, q, 5).collect()) == want


def test_scan_is_pruned(spark, tmp_path):
    """A query's words and buckets reach the scan."""
    docs, _ = corpus()
    index = ts.build(spark.createDataFrame(docs, "issue_id int, description string"), str(tmp_path / "index"), ts.SearchConfig(slots=32))
    plan = ts.search(index, spark.createDataFrame([(1, "café")], "query_id int, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 32" in plan and re.search(r"PushedFilters: \[[^\]]*term", plan)


def test_nothing(spark, tmp_path):
    x = spark.createDataFrame([], "issue_id string, description string")
    index = ts.build(x, str(tmp_path / "index"))
    assert ts.search(index, spark.createDataFrame([(1, "a")], "query_id int, query string")).count() == 0


def test_rows_of_postings_are_shared(spark, tmp_path):
    """A term of many tickets is a row for each batch of texts, with all their positions, not a row for each ticket."""
    docs, _ = corpus()
    index = ts.build(spark.createDataFrame(docs, "issue_id int, description string").coalesce(2), str(tmp_path / "index"))
    tickets = sum("the" in W.findall((t or "").lower()) for _, t in docs)
    got = index.postings.where("term = 'the'").selectExpr("sum(size(ids)) AS tickets", "count(*) AS rows", "sum(size(positions)) AS places").first()
    assert got.tickets == tickets and got.rows <= 2 and got.places == sum(W.findall((t or "").lower()).count("the") for _, t in docs)
