"""The dealt queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ticketloom.llm import bpe, collocations, embedding_dedup, language_id, minhash_dedup, packing, quality_rules, secret_scan, substring_dedup, toxicity, url_filter, warc
from ticketloom.llm._store import fresh_path, read_table, remove_path


def vocabulary(kind: str = "tiktoken") -> str:
    """The installed rank file (tiktoken) or tokenizer file (json) of the byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("json"), end_id=2, capacity=1024, with_ids=False)


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cfg = toxicity.ToxicityConfig()
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), cfg)
    x = toxicity.score_texts(docs, model)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return x.select("doc_id", held_out.alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= cfg.threshold).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the labels whose doc_id is a page's id; bad if of low quality or toxic, unknown if a null leaves it open."""
    pages = read_table(spark, sf_dir, "pages")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")).groupBy("doc_id").agg(F.max("bad").alias("bad"))
    outcomes = pages.select("page_id", url_filter.url_host(F.col("url")).alias("host")).join(labels, F.col("page_id") == F.col("doc_id")).select("host", "bad")
    x = url_filter.judge_urls(pages, outcomes, keep=("page_id",))
    return x.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), "level")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return x.select("_row.doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all their evidence, and documents, which only have text; the text model learns from all documents."""
    docs, pages = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages")
    model = language_id.learn_text_model(docs)
    none = F.lit(None).cast("string")
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("url"), none.alias("declared"))
    html = F.col("html")
    rows = rows.unionByName(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", language_id.visible_text(html).alias("text"), "url", language_id.declared_language(html).alias("declared")))
    x = language_id.identify(rows, model, keep=("doc_id", "page_id"))
    return x.select("doc_id", "page_id", "language", F.round("probability", 6).alias("probability"), "text_language")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = embedding_dedup.embedding_duplicates(read_table(spark, sf_dir, "embeddings"))
    return x.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op9_quality_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = secret_scan.secret_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    n = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return x.select(
        "_row.doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"), secret_scan.joined(F.col("_spans")).alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no capture times: a page's is its id in seconds."""
    pages = read_table(spark, sf_dir, "pages").withColumn("at", F.timestamp_seconds(F.col("page_id") + 1_700_000_000))
    path = fresh_path(spark, "archives")
    warc.write_archives(pages, path, "page_id", "url", "at", "html")
    index = warc.capture_index(spark, path)
    remove_path(spark, path)
    x = warc.resolved(warc.with_position(index))
    number = lambda c: F.expr(f"try_cast({c} as long)")
    x = x.withColumns({"page": warc.row_id(F.col("record_id")), "other": warc.row_id(F.col("refers_to"))})
    return x.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("other").alias("refers_to"), "url_key", "position")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_reputation, op3_minhash_forest, op4_toxicity, op5_byte_bpe, op6_substring_dedup, op7_language_id, op8_embedding_dedup, op9_quality_thresholds, op10_secret_scan, op11_collocations, op12_warc_index)}


# ---- the same in DuckDB's SQL, where it can say it ----

_WORDS = r"[^\x20\x09-\x0D]+"


def _url_sql() -> str:
    cfg = url_filter.ReputationConfig()
    low, high = 1 / (cfg.max_strength + 1), 1 / (cfg.min_strength + 1)

    def strength(groups: str, above: str) -> str:
        d, v = f"(bad / n - {above})", f"({above} * (1 - {above}))"
        return f"(SELECT 1 / least(greatest(coalesce((sum(n * {d} * {d}) - sum({v})) / nullif(sum((n - 1) * {v}), 0), 0), {low}), {high}) - 1 FROM {groups})"

    cases = [(f"(host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{p}')", n + p, v) for n, p, v in sorted(cfg.rules, key=lambda r: -len(r[0] + r[1]))]
    rule, verdict = ("CASE " + " ".join(f"WHEN {t} THEN '{x[i]}'" for t, *x in cases) + " END" for i in (0, 1))
    suffixes = ", ".join(f"'{x}'" for x in url_filter.SUFFIXES)
    return rf"""WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 b AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':\d*$', '') AS h FROM p),
 k AS (SELECT *, regexp_matches(h, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') OR contains(h, ':') AS ip, array_to_string(string_split(h, '.')[-2:], '.') IN ({suffixes}) AS two FROM b),
 q AS (SELECT *, CASE WHEN ip THEN h WHEN two THEN array_to_string(string_split(h, '.')[-3:], '.') ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS dom, CASE WHEN ip THEN '' WHEN two THEN array_to_string(string_split(h, '.')[-2:], '.') ELSE string_split(h, '.')[-1] END AS suf FROM k),
 lab AS (SELECT doc_id, max((quality = 0 OR toxic = 1)::INT) AS y FROM labels GROUP BY doc_id HAVING y IS NOT NULL),
 o AS (SELECT h, dom, suf, sum(y)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM q JOIN lab ON page_id = doc_id GROUP BY h, dom, suf),
 od AS (SELECT dom, suf, sum(bad) AS bad, sum(n) AS n FROM o GROUP BY dom, suf), os AS (SELECT suf, sum(bad) AS bad, sum(n) AS n FROM o GROUP BY suf),
 t AS (SELECT (coalesce(sum(bad), 0) + 0.5) AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 0.5 AS z, (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS m FROM o),
 s0 AS (SELECT os.*, t.m AS up FROM os, t), s1 AS (SELECT *, up * k + bad AS a, (1 - up) * k + n - bad AS z FROM s0, (SELECT {strength("s0", "up")} AS k)),
 d0 AS (SELECT od.*, s1.a / (s1.a + s1.z) AS up FROM od JOIN s1 USING (suf)), d1 AS (SELECT *, up * k + bad AS a, (1 - up) * k + n - bad AS z FROM d0, (SELECT {strength("d0", "up")} AS k)),
 h0 AS (SELECT o.*, d1.a / (d1.a + d1.z) AS up FROM o JOIN d1 USING (dom)), h1 AS (SELECT *, up * k + bad AS a, (1 - up) * k + n - bad AS z FROM h0, (SELECT {strength("h0", "up")} AS k)),
 r AS (SELECT q.page_id, q.host, q.path, coalesce(h1.a, d1.a, s1.a, t.a) AS a, coalesce(h1.z, d1.z, s1.z, t.z) AS z, CASE WHEN h1.a IS NOT NULL THEN 'host' WHEN d1.a IS NOT NULL THEN 'domain' WHEN s1.a IS NOT NULL THEN 'suffix' ELSE 'all' END AS level FROM q LEFT JOIN h1 ON q.h = h1.h LEFT JOIN d1 ON q.dom = d1.dom LEFT JOIN s1 ON q.suf = s1.suf, t)
 SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN a / (a + z) - {cfg.z} * sqrt(a / (a + z) * (z / (a + z)) / (a + z + 1)) > {cfg.max_bad_rate} THEN 'block' ELSE 'allow' END) AS verdict, round(a / (a + z), 6) AS bad_rate, level FROM r"""


def _spans_sql() -> str:
    def of(i: int, r) -> str:
        p = r.java.replace("'", "''")
        m, g, part = f"regexp_extract_all(t, '{p}')", f"regexp_split_to_array(t, '{p}')", f"regexp_extract_all(t, '{p}', {r.group})"
        length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
        row = f"struct_pack(s := ({length('x.g[1:k]')} + {length('x.m[1:k-1]')})::BIGINT, o := {i}, k := '{r.kind}', e := ({length('x.g[1:k]')} + {length('x.m[1:k]')})::BIGINT, n := length(x.p[k]))"
        return f"(SELECT list_filter(list_transform(range(1, len(x.m) + 1), lambda k: {row}), lambda y: y.n >= {r.least}) FROM (SELECT {m} AS m, {g} AS g, {part} AS p) x)"

    every = "list_sort(list_concat(" + ", ".join(of(i, r) for i, r in enumerate(secret_scan.RULES)) + "))"
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda y: y.k || ':' || y.s || ':' || y.e), ','), '')"
    n = lambda kind: f"len(list_filter(a, lambda y: y.k = '{kind}'))::BIGINT AS n_{kind}"
    base = "list_filter(a, lambda y: y.k IN ('assign', 'access', 'hex'))"
    return f"SELECT doc_id, {n('assign')}, {n('access')}, {n('hex')}, sha256({text(base)}) AS base_sha256, {text('a')} AS spans FROM (SELECT doc_id, {every} AS a FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


def _quality_sql() -> str:
    cfg = quality_rules.QualityConfig()
    rates = quality_rules.RATES
    per_rate = lambda i: "CASE rate " + " ".join(f"WHEN '{r}' THEN {cfg.fences[r][i]}::DOUBLE" for r in rates) + " END"

    at = lambda q: f"min(edge) FILTER (upto >= {q} * total - 1e-6)"
    fence = f"greatest({at(per_rate(0))} + {per_rate(1)} * ({at(per_rate(0))} - {at('0.5')}), {cfg.margin} * {at(per_rate(0))})"
    beyond = " OR ".join(f"coalesce(r.{x} > t.t_{x}, FALSE)" for x in rates)
    return rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
 x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)), f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x),
 v AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f, range(3) u(k) WHERE c > 1 GROUP BY doc_id),
 m AS (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '{_WORDS}')) AS l, coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN v USING (doc_id)),
 c AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < {cfg.min_words} OR 100 * n_repeat_words > {cfg.max_repeat_percent} * n_words AS base_failed FROM m),
 r AS (SELECT *, (n_symbols + {cfg.symbol_prior}::DOUBLE) / (word_chars + {2 * cfg.symbol_prior}::DOUBLE) AS symbol_rate, n_dup_lines::DOUBLE / greatest(len(l), 1) AS dup_line_rate, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_rate, word_chars::DOUBLE / greatest(n_words, 1) AS long_word FROM c),
 e AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS rate, {x} AS v FROM r WHERE NOT base_failed" for x in rates)}),
 s AS (SELECT lang, source, rate, CASE WHEN v > 0 THEN floor(ln(v) / {math.log1p(cfg.accuracy)!r}::DOUBLE + 1e-9)::INT END AS bucket, count(*) AS n FROM e GROUP BY ALL),
 sa AS (SELECT rate, bucket, sum(n) / sum(sum(n)) OVER (PARTITION BY rate) AS share FROM s GROUP BY rate, bucket),
 ml AS (SELECT lang, rate, bucket, sum(w) AS w FROM (SELECT lang, rate, bucket, n::DOUBLE AS w FROM s UNION ALL SELECT lang, rate, bucket, {cfg.prior_rows} * share FROM (SELECT DISTINCT lang, rate FROM s) JOIN sa USING (rate)) GROUP BY ALL),
 sl AS (SELECT lang, rate, bucket, w / sum(w) OVER (PARTITION BY lang, rate) AS share FROM ml),
 ms AS (SELECT lang, source, rate, bucket, sum(w) AS w FROM (SELECT lang, source, rate, bucket, n::DOUBLE AS w FROM s UNION ALL SELECT g.lang, source, g.rate, bucket, {cfg.prior_rows} * share FROM (SELECT DISTINCT lang, source, rate FROM s) g JOIN sl ON g.lang IS NOT DISTINCT FROM sl.lang AND g.rate = sl.rate) GROUP BY ALL),
 u AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY bucket NULLS FIRST) AS upto, sum(w) OVER (PARTITION BY lang, source, rate) AS total, CASE WHEN bucket IS NULL THEN 0 ELSE pow({1 + cfg.accuracy}::DOUBLE, bucket + 1) END AS edge FROM ms),
 o AS (SELECT lang, source, rate, {fence} AS f FROM u GROUP BY lang, source, rate), t AS (SELECT lang, source, {", ".join(f"max(f) FILTER (rate = '{x}') AS t_{x}" for x in rates)} FROM o GROUP BY lang, source)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({beyond}) AS kept
 FROM r LEFT JOIN t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source"""


def _collocation_sql() -> str:
    cfg = collocations.CollocationConfig()
    cut = lambda k: f"SELECT g.lang, g.phrase, g.a, {k} AS k, h.a AS l, t.a AS r, ({cfg.scale}::HUGEINT * g.a // (h.a::HUGEINT + t.a))::BIGINT AS score FROM f g JOIN f h ON h.lang = g.lang AND h.phrase = array_to_string(g.w[1:{k}], ' ') JOIN f t ON t.lang = g.lang AND t.phrase = array_to_string(g.w[{k + 1}:], ' ') WHERE len(g.w) > {k}"
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
 q AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p), tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM q GROUP BY lang),
 x AS (SELECT lang, w[i : i + m] AS w FROM q, range({cfg.longest}) b(m), unnest(range(1, len(q.w) - m + 1)) s(i)),
 f AS (SELECT lang, w, array_to_string(w, ' ') AS phrase, count(*) AS a FROM x GROUP BY lang, w HAVING a >= {cfg.least}),
 c AS ({" UNION ALL ".join(map(cut, range(1, cfg.longest)))}), worst AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 o AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM f, range(2, {cfg.longest}) b(m), unnest(range(1, len(f.w) - m + 2)) s(i) WHERE len(f.w) > m GROUP BY ALL)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM worst JOIN tot USING (lang) LEFT JOIN o USING (lang, phrase) WHERE NOT coalesce(100 * longer >= {cfg.cover_percent} * a, FALSE) QUALIFY rank <= {cfg.top}"""


def _warc_sql() -> str:
    cfg = warc.WarcConfig()
    digits = " || ".join(f"list_extract(string_split('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ''), (('0x' || substr(h, {1 + 5 * i}, 5))::INT >> {5 * k} & 31) + 1)" for i in range(8) for k in (3, 2, 1, 0))
    whole = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#]*)([^#]*).*$"
    host = f"regexp_replace(regexp_extract(u, '{whole}', 1), '(:|:80|:443)$', '')"
    key = f"CASE WHEN regexp_matches(u, '{whole}') THEN array_to_string(list_reverse(string_split(lower({host}), '.')), ',') || ')' || coalesce(nullif(regexp_extract(u, '{whole}', 2), ''), '/') ELSE u END"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, replace(coalesce(url, ''), ' ', '%20') AS u FROM pages), d AS (SELECT *, strlen(t) AS size, max(page_id) OVER (PARTITION BY t) AS last, sha1(t) AS h FROM p),
 k AS (SELECT *, {key} AS url_key, {digits} AS digest, size >= {cfg.revisits_from} AND page_id IS DISTINCT FROM last AS again FROM d)
 SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position FROM k"""


_REACH = """, reach AS (SELECT id AS a, id AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a), root AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""
ORACLE_SQL: dict[str, str] = {
    "op2_url_reputation": _url_sql(),
    "op3_minhash_forest": rf"""WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
 s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 3))) t(i) WHERE len(w) > 0), c AS (SELECT id, count(*) AS n FROM s GROUP BY id), node AS (SELECT id FROM d),
 pair AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2), link AS (SELECT a, b FROM pair JOIN c p ON p.id = a JOIN c q ON q.id = b WHERE 100 * k >= 85 * (p.n + q.n - k)){_REACH}
 SELECT node.id AS doc_id, coalesce(c.n, 0) AS n_shingles, component_id, node.id = component_id AS kept FROM node LEFT JOIN c ON c.id = node.id JOIN root ON root.id = node.id""",
    "op6_substring_dedup": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents), x AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM d, unnest(range(1, len(w) - 33)) t(i)),
 r AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1), c AS (SELECT DISTINCT doc_id, i + k AS j FROM x JOIN r USING (g), range(35) t(k)), u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
 z AS (SELECT u.doc_id, count(*) AS n, count(c.j) AS cut, string_agg(word, ' ' ORDER BY u.j) FILTER (WHERE c.j IS NULL) AS kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.j = c.j GROUP BY u.doc_id)
 SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(cut, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)""",
    "op8_embedding_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), node AS (SELECT id FROM e), link AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.93){_REACH}
 SELECT node.id AS vec_id, (SELECT count(*) FROM link WHERE a = node.id) AS n_links, component_id, node.id = component_id AS kept FROM node JOIN root USING (id)""",
    "op9_quality_thresholds": _quality_sql(),
    "op10_secret_scan": _spans_sql(),
    "op11_collocations": _collocation_sql(),
    "op12_warc_index": _warc_sql(),
}
