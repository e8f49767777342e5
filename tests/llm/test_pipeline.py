"""The pipeline's stages against plain Python, each on its own input."""

import re

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from conftest import SF  # noqa: E402
from test_minhash import brute as brute_near  # noqa: E402
from test_native import slow_spans  # noqa: E402
from test_substring import brute as brute_repeats  # noqa: E402
from test_tokens import check_packing  # noqa: E402
from ticketloom.llm import queries  # noqa: E402
from ticketloom.llm._store import materialise  # noqa: E402


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    texts = [{r.doc_id: r.text for r in x.collect()} for x in out[:-1]]
    assert all(x.columns == columns for x in out[:-1])
    bad = {r.doc_id for r in queries.op4_toxicity(spark, SF).where("predicted = 1").collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if i not in bad}
    near = brute_near(list(texts[1].items()))
    assert texts[2] == {i: t for i, t in texts[1].items() if near[i][1] == i}
    ids = list(texts[2])
    want = brute_repeats([texts[2][i] for i in ids], 35)
    assert texts[3] == {i: (kept if cut else texts[2][i]) for i, (_, cut, kept) in zip(ids, want)}
    for i, t in texts[3].items():
        if not slow_spans(t):
            assert texts[4][i] == t
        else:
            assert not slow_spans(texts[4][i].replace("[secret]", " ")) and len(re.findall(r"\[secret\]", texts[4][i])) >= 1
    assert all(r.n_chars == len(r.text) for r in out[4].collect())
    check_packing(out[5].collect(), texts[4])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


EXTRA = "_text string, _row string, _rest string, id long, cls string, _kept int, _chunk string, n int, _toxicity double, _evidence string, _rules string, _spans int, _no string"


def odd_rows():
    long = " ".join(f"w{i}" for i in range(30000))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["plain words of one text", None, "", " \n\t", long, long + " more", f"one {passage} two", f"three {passage} four", "password=hunter2secret in a text", "ünï 中文 é"]
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], rows[6], (None, "a text without an id", "en", "src", 20), (None, None, None, None, None)]
    return [(*r, f"x{k}", None, "r", k, "c", 1, "k", None, 0.5, "e", None, 2, "z") for k, r in enumerate(rows)]


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns, through each stage on its own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
    rows = odd_rows()
    docs = spark.createDataFrame(rows, schema).repartition(3)
    key = lambda x: sorted(map(repr, map(tuple, x)))
    for name, stage in corpus_pipeline.STAGES:
        x = materialise(stage(spark, docs, SF), name)
        got = x.collect()
        if name == "toxicity":
            assert x.columns == docs.columns and key(got) == key(rows)
        elif name == "minhash_near_dedup":  # rows of one id stay together, near copies go
            assert x.columns == docs.columns and key(got) == key([r for r in rows if r[0] not in (5, 7)])
        elif name == "substring_dedup":
            assert len(got) == len(rows) and all(tuple(g)[5:] == r[5:] for g, r in zip(sorted(got, key=lambda g: g.id), rows))
            by = {r.id: r for r in got}
            assert by[1].text is None and by[2].text == "" and by[3].text == " \n\t" and by[9].text == rows[9][1] and by[12].text == rows[12][1]
            assert by[4].text == "" and by[5].text == "more" and by[6].text == by[11].text == "" and by[7].text == "three four"
            assert all((r.n_chars is None) == (r.text is None) and r.n_chars in (None, len(r.text or "")) for r in got)
        elif name == "secret_scan":
            by = {r.id: r for r in got}
            assert len(got) == len(rows) and by[8].text == "[secret] in a text" and by[4].text == rows[4][1] and by[13].text is None
        else:
            assert [r.length for r in got if r.doc_id in (1, 2)] == [1, 1] and {r.doc_id for r in got} == {r[0] for r in rows}
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0 and (name == "best_fit_packing" or empty.columns == docs.columns)
