"""WARC archives written, read back and indexed."""

import base64
import datetime
import gzip
import hashlib
import random

import pytest

from ticketloom.llm import queries, warc

SCHEMA = "k long, url string, at timestamp, body string, size int, last string, value int"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def captures(spark, rows):
    return spark.createDataFrame([(k, u, None if t is None else datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=t), b, 1, "x", 2) for k, u, t, b in rows], SCHEMA)


ODD = [
    "", None, "\r\n\r\n", "\r\n", "\r\r\n\r\n\r", "a\r\n\r\nb\r\n\r\n", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n", "é" * 3000, "x" * 3_000_000, "\0\x01 ", "\n\n", "tail\r\n\r", "dup", "dup", "dup",
]


def test_round_trip(spark, tmp_path):
    """Payloads full of separators, empty, null and long ones; repeated rows; null ids, times and URLs."""
    rows = [(i, f"http://H{i % 3}.Example.com:80/p?q={i}#f", i * 7 % 5, t) for i, t in enumerate(ODD)]
    rows += [(99, None, None, "null url"), (None, "http://x/ y\r\n", 3, "null id"), (None, "http://x/", 3, "dup"), (None, "u", 1, "none"), (None, "u", 2, "none"), (14, "http://again/", 9, "dup"), (0, "http://user@[::1]:8080/?a", 1, "")]
    path = str(tmp_path / "a")
    cfg = warc.WarcConfig(records=4, run=5, block=2, range_entries=3, keys=2)
    warc.write_archives(captures(spark, rows).repartition(3), path, "k", "url", "at", "body", cfg)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    last = {}
    for k, _, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if k is None else k)
    last = {t: None if k < 0 else k for t, k in last.items()}
    want = sorted((str(k), digest((t or "").encode()), k == last[t or ""] or last[t or ""] is None) for k, _, _, t in rows)
    name = lambda u: u.removeprefix("urn:capture:") or "None"
    assert sorted((name(r.record_id), r.payload_digest, r.type == "response") for r in got) == want
    assert {bytes(r.payload) for r in got if r.type == "response"} == {(t or "").encode() for _, _, _, t in rows}
    assert all(name(r.refers_to) == "14" for r in got if r.payload_digest == digest(b"dup") and r.type == "revisit")
    assert {r.uri for r in got if name(r.record_id) == "99"} == {None} and "http://x/%20y%0D%0A" in {r.uri for r in got}
    index = warc.with_position(warc.capture_index(spark, path, cfg)).collect()
    assert sorted(r.position for r in index) == list(range(len(rows)))
    order = [(r.url_key, r.at, r.record_id) for r in sorted(index, key=lambda r: r.position)]
    assert order == sorted(order) and len({r.range for r in index}) > 3
    assert {r.url_key for r in index} >= {"", "com,example,h0)/p?q=0", "[::1]:8080)/?a", "again)/", "u"}
    full = warc.resolved(warc.capture_index(spark, path, cfg)).collect()
    assert sorted((name(r.record_id), r.payload_bytes) for r in full) == sorted((str(k), len((t or "").encode())) for k, _, _, t in rows)
    for f in (tmp_path / "a").glob("*.gz"):  # offsets and lengths lead to the records
        raw = gzip.decompress(f.read_bytes())
        for r in got:
            if r.file == f.name:
                assert raw[r.offset :].startswith(b"WARC/1.1\r\n") and raw[r.offset + r.length : r.offset + r.length + 4] == b"\r\n\r\n"


def test_least_size(spark, tmp_path):
    rows = [(1, "http://a/", 1, "ab"), (2, "http://a/", 2, "ab"), (3, "http://a/", 3, "abc"), (4, "http://a/", 4, "abc")]
    warc.write_archives(captures(spark, rows), str(tmp_path / "a"), "k", "url", "at", "body", warc.WarcConfig(revisits_from=3))
    assert {r.record_id[-1]: r.type for r in warc.read_archives(spark, str(tmp_path / "a")).collect()} == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_other_archives(spark, tmp_path):
    """Records of other writers: a gzip member each, no HTTP, names in <>, more line ends; plain files; damaged ones."""
    def rec(kind, body, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": "<urn:uuid:1>", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(body))} | {k.replace("_", "-"): v for k, v in more.items()}
        return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"

    every = [rec("warcinfo", b"software: x\r\n"), rec("resource", b"\xff\x00 raw", WARC_Target_URI="<http://b.org>"), rec("response", b"HTTP/1.0 200 OK\r\n\r\nhi", WARC_Target_URI="http://b.org/x", Content_Type="application/http", WARC_Payload_Digest="sha1:WRONG")]
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "one.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n") for r in every))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "one.warc").write_bytes(b"".join(every)[:-4])
    for folder, packed in (("z", True), ("p", False)):
        got = {r.type: r for r in warc.read_archives(spark, str(tmp_path / folder), packed).collect()}
        assert bytes(got["resource"].payload) == b"\xff\x00 raw" and got["resource"].url_key == "org,b)/" and bytes(got["response"].payload) == b"hi"
        assert not got["response"].intact and got["warcinfo"].intact and got["warcinfo"].url_key == ""
    for damage in (b"no archive", b"".join(every)[:-30]):
        (tmp_path / "p" / "one.warc").write_bytes(damage)
        with pytest.raises(Exception, match="one.warc"):
            warc.read_archives(spark, str(tmp_path / "p"), False).collect()


def test_empty(spark, tmp_path):
    warc.write_archives(captures(spark, []), str(tmp_path / "a"), "k", "url", "at", "body")
    assert warc.capture_index(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_loser_tree(seed):
    """Blocks that come by their first key, of runs with ties, merge into sorted order; only open blocks are held."""
    random.seed(seed)
    runs = [sorted(random.choices(range(random.choice([3, 50, 10_000])), k=random.randint(1, 60))) for _ in range(random.randint(1, 40))]
    blocks = sorted(([(x, None) for x in r[i : i + 7]] for r in runs for i in range(0, len(r), 7)), key=lambda b: b[0][0])
    assert [k for k, _ in warc.merged(iter(blocks))] == sorted(x for r in runs for x in r)


def test_a_run_after_another():
    """Runs that don't overlap take one place in the tree."""
    tree = []

    class Seen(warc.LoserTree):
        def __init__(self):
            super().__init__()
            tree.append(self)

    whole, warc.LoserTree = warc.LoserTree, Seen
    try:
        assert [k for k, _ in warc.merged([(i * 10 + j, None) for j in range(10)] for i in range(1000))] == list(range(10_000))
    finally:
        warc.LoserTree = whole
    assert tree[0].size == 2


def test_hot_url(spark, tmp_path):
    """Captures of one URL are spread over ranges by time; copies of one payload refer to one record."""
    rows = [(i, "http://hot.org/" if i % 3 else f"http://c{i}.org/", i, "same" if i % 2 else f"p{i}") for i in range(900)]
    warc.write_archives(captures(spark, rows).repartition(4), str(tmp_path / "a"), "k", "url", "at", "body")
    cfg = warc.WarcConfig(run=50, block=10, range_entries=60)
    index = warc.capture_index(spark, str(tmp_path / "a"), cfg).collect()
    by = {}
    for r in index:
        by.setdefault(r.range, []).append(r.url_key)
    assert len(index) == 900 and max(map(len, by.values())) < 200 and sum("org,hot)/" in x for x in by.values()) > 5
    assert {r.refers_to for r in index if r.type == "revisit"} == {"urn:capture:899"}


def test_query_on_no_rows(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert queries.op12_warc_index(spark, str(tmp_path)).count() == 0
