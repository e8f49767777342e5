"""Language ID: held-out accuracy, evidence fusion against plain Python, edge cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SF
from ticketloom.llm import language_id, queries

ROWS = "id long, text string, url string, declared string"


def model(spark):
    texts = [("the cat and the dog were there with this", "en")] * 5 + [("der hund und die katze sind nicht hier", "de")] * 5 + [("no language", None)]
    return language_id.learn_text_model(spark.createDataFrame(texts, "text string, lang string"))


def test_evidence(spark):
    m = model(spark)
    assert m[0] == ["de", "en"]
    rows = [(i, "the dog and the cat with this", "http://a.example.uk/x", "en") for i in range(30)] + [(100 + i, "die katze und der hund sind", "http://b.example.de/", "de") for i in range(30)]
    rows += [(200, None, "http://b.example.de/y", None), (201, "", "http://new.example.de/", None), (202, None, None, "de"), (203, None, "http://a.example.uk", None), (204, "xx", None, None), (205, "the cat and the dog with this " * 3, "http://b.example.de", "de"), (205, None, None, None), (None, "und die", "no url", "zz")]
    x = spark.createDataFrame([(*r, "clash") for r in rows], ROWS + ", _ll string")
    got = language_id.identify(x, m).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert {by[i].language for i in (200, 201, 202, 100)} == {"de"} and {by[i].language for i in (203, 0)} == {"en"}
    assert by[200].probability > by[201].probability > 0.5  # the host itself says more than its domain
    assert by[None].language == "de"
    assert [r for r in got if r.id == 205 and r.probability > 0.5 and r.language == "en"]
    assert all(0 < r.probability <= 1 for r in got)


def cells(text, bits):
    """Cells of byte trigrams: lower-cased, runs of ASCII other than letters as one space."""
    out = bytearray()
    for c in (text or "").encode().lower():
        blank = c < 128 and not chr(c).isalpha()
        if not (blank and out and out[-1] == 32):
            out.append(32 if blank else c)
    return [((out[i] << 16 | out[i + 1] << 8 | out[i + 2]) * 0x9E3779B1 % (1 << 32)) >> (32 - bits) for i in range(len(out) - 2)]


def fused(labelled, rows, cfg):
    """(language, probability, text's own verdict) of each row, in plain Python."""
    languages = sorted({lang for _, lang in labelled if lang})
    counts = {lang: Counter() for lang in languages}
    for t, lang in labelled:
        if lang:
            counts[lang].update(cells(t, cfg.bits))
    size = {lang: sum(c.values()) + cfg.smoothing * (1 << cfg.bits) for lang, c in counts.items()}
    ll, verdicts = [], []
    for _, t, _, _ in rows:
        ll.append({x: cfg.text_power * sum(math.log((counts[x][c] + cfg.smoothing) / size[x]) for c in cells(t, cfg.bits)) for x in languages})
        verdicts.append(max(languages, key=lambda x: ll[-1][x]) if cells(t, cfg.bits) else None)
    host = [u.split("://", 1)[1].split("/")[0].lower() if u and "://" in u else None for _, _, u, _ in rows]
    domain = [h and ".".join(h.split(".")[-3 if h.endswith(".co.uk") else -2 :]) for h in host]
    suffix = [h and ("co.uk" if h.endswith(".co.uk") else h.split(".")[-1]) for h in host]
    declared = [d for *_, d in rows]
    kinds = max(1, len({d for d in declared if d}))
    out = []
    for i in range(len(rows)):
        rest = [j for j in range(len(rows)) if j != i and verdicts[j]]
        n = Counter(verdicts[j] for j in rest)
        p = {x: (n[x] + 1) / (len(rest) + len(languages)) for x in languages}
        for level in (suffix, domain, host) if host[i] else ():
            n = Counter(verdicts[j] for j in rest if level[j] == level[i])
            p = {x: (n[x] + cfg.strength * p[x]) / (sum(n.values()) + cfg.strength) for x in languages}
        s = {x: ll[i][x] + math.log(p[x]) for x in languages}
        if declared[i]:
            said = Counter(verdicts[j] for j in rest if declared[j] == declared[i])
            every = Counter(verdicts[j] for j in rest if declared[j])
            s = {x: s[x] + math.log((said[x] + cfg.declared_noise) / (every[x] + cfg.declared_noise * kinds)) for x in languages}
        best = max(languages, key=lambda x: s[x])
        out.append((best, 1 / sum(math.exp(s[x] - s[best]) for x in languages), verdicts[i]))
    return out


def test_by_brute_force(spark):
    random.seed(5)
    stems = {"en": ["the", "and", "this", "with"], "de": ["der", "und", "nicht", "über"], "fr": ["les", "dans", "être", "pas"]}
    sentence = lambda lang, k: " ".join(random.choice(stems[lang] if random.random() < 0.8 else sum(stems.values(), [])) for _ in range(k))
    labelled = [(sentence(lang, 12), lang) for lang in stems for _ in range(8)] + [("nothing", None), (None, "en"), ("", "de")]
    rows = []
    for i in range(120):
        lang = random.choice(list(stems))
        url = random.choice([None, "no url", f"https://h{random.randint(0, 5)}.{lang}site.{random.choice(('com', 'co.uk', lang))}/p"])
        rows.append((i, random.choice([None, "", "12", *[sentence(lang, random.randint(1, 6))] * 9]), url, random.choice([None, lang, lang, "zz"])))
    rows += [rows[0], rows[1]]
    cfg = language_id.LanguageConfig()
    m = language_id.learn_text_model(spark.createDataFrame(labelled, "text string, lang string"), cfg)
    got = {}
    for r in language_id.identify(spark.createDataFrame(rows, ROWS), m, cfg).collect():
        got.setdefault(r.id, []).append(r)
    for (i, *_), (language, probability, by_text) in zip(rows, fused(labelled, rows, cfg)):
        for r in got[i]:
            assert (r.language, r.text_language) == (language, by_text) and r.probability == pytest.approx(probability, rel=1e-9)


def test_held_out(spark):
    """Learned from two thirds of the documents, by crc32 of the id; measured on the others."""
    docs = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    m = language_id.learn_text_model(docs.where(~held))
    none = F.lit(None).cast("string")
    x = language_id.identify(docs.where(held).select("doc_id", "lang", "text", none.alias("url"), none.alias("declared")), m, keep=("doc_id", "lang")).toPandas()
    assert len(x) > 250 and (x.language == x.lang).mean() > 0.98


def test_empty(spark):
    x = spark.createDataFrame([(1, "some text", None, None)], ROWS)
    assert language_id.identify(x.limit(0), model(spark)).count() == 0
    none = language_id.learn_text_model(spark.createDataFrame([], "text string, lang string"))
    assert [tuple(r) for r in language_id.identify(x, none).collect()] == [(1, None, None, None)]


def test_markup(spark):
    html = "<!DOCTYPE html><HTML class=a lang='EN-us'><script>var t=\"</p>\";</script><!-- no --><p>one</p><style>p{}</style>two"
    r = spark.createDataFrame([(html,), (None,), ("plain",)], "html string").select(language_id.visible_text(spark_col("html")).alias("t"), language_id.declared_language(spark_col("html")).alias("d")).collect()
    assert r[0].t.split() == ["one", "two"] and r[0].d == "en" and r[1].t is None and r[1].d is None and r[2].d is None


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_query(spark):
    docs, pages = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "pages"))
    got = queries.op7_language_id(spark, SF)
    assert got.count() == docs.count() + pages.count()
    x = got.join(docs, "doc_id").select("language", "lang").toPandas()
    assert (x.language == x.lang).mean() > 0.98
    declared = pages.select("page_id", language_id.declared_language(pages.html).alias("d"))
    y = got.join(declared, "page_id").select("language", "d").toPandas()
    assert (y.language == y.d).mean() > 0.98
