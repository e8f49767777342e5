"""Language ID by Bayesian evidence fusion.

For each row four kinds of evidence are multiplied, as log odds over the languages:
- the text: hashed byte trigrams of lower-cased text under a multinomial model with additive smoothing, tempered by
  `text_power`, since neighbouring trigrams repeat each other;
- the language that the markup declares (lang attribute), by how often rows of a language declare which;
- the address suffix and the host, by a prior smoothed from all rows to suffix, from suffix to registered domain, from
  domain to host.

All tables come from grouped aggregation: trigram counts by language over all labelled texts, and counts of the texts'
own verdicts by declaration, host, domain and suffix over all rows. A row's own verdict is taken out of the counts that
judge it, so it doesn't confirm itself: a host's only page is judged by its domain, a domain's by its suffix. Counts are
partially aggregated by task, so a host with a third of the rows costs a row from each task.

Defined results: null or empty texts have flat text evidence, count in no table and are decided by the rest; without any
evidence the largest prior wins, ties by name. Very long texts count whole. Languages are those of the labelled texts,
by frequency at most `max_languages`, which bounds the model. Null languages are not learned from. Rows without url or
markup just lack that evidence. Repeated rows are judged alike; empty tables give empty results; extra columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm import _text
from ticketloom.llm._store import materialise
from ticketloom.llm.url_filter import bare_host, site_of, url_host


@dataclass(frozen=True)
class LanguageConfig:
    #: Hashed trigrams are counted in so many cells.
    bits: int = 15
    smoothing: float = 0.5
    text_power: float = 0.25
    max_languages: int = 256
    #: Pseudo-rows of the level above.
    strength: float = 10.0
    #: Pseudo-rows that spread a declaration over all languages.
    declared_noise: float = 2.0


def visible_text(html: Column) -> Column:
    """Markup without scripts, styles, comments and tags."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(x, r"<[^>]*>", " ")


def declared_language(html: Column) -> Column:
    """The primary tag of the html element's lang attribute, lower-cased; null if there is none."""
    tag = F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})\b""", 1)
    return F.nullif(F.lower(tag), F.lit(""))


def _cells(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, cell) of each byte trigram inside a text; runs of ASCII other than letters count as one space."""
    x = _text._LOWER[data]
    blank = _text.NOT_ALNUM[x] | ((x >= 48) & (x <= 57))
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (doc[1:] == doc[:-1]))
    x, doc = np.where(blank[keep], 32, x[keep]).astype(np.uint32), doc[keep]
    if len(x) < 3:
        return doc[:0], doc[:0]
    code = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    inside = doc[:-2] == doc[2:]
    return doc[:-2][inside], ((code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


def _count_cells(languages: list[str], bits: int):
    def run(batches):
        at = {x: i for i, x in enumerate(languages)}
        n = np.zeros(len(languages) << bits, np.int64)
        for b in batches:
            lang = np.array([at.get(x, -1) for x in b.column(0).to_pylist()])
            for lo, data, offsets in _text.chunks(b.column(1)):
                doc, cell = _cells(data, offsets, bits)
                own = lang[lo + doc]
                n += np.bincount((own[own >= 0] << bits) + cell[own >= 0], minlength=len(n))
        i = np.flatnonzero(n)
        yield pa.record_batch([pa.array(i), pa.array(n[i])], ["cell", "n"])

    return run


def learn_text_model(texts: DataFrame, cfg: LanguageConfig = LanguageConfig(), text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities languages x cells) from every labelled text."""
    x = texts.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t")).where("l is not null")
    top = x.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(cfg.max_languages).collect()  # max_languages rows
    languages = sorted(r.l for r in top)
    n = np.zeros(len(languages) << cfg.bits)
    counts = x.mapInArrow(_count_cells(languages, cfg.bits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # max_languages * 2**bits rows at most
        n[r.cell] = r.n
    n = n.reshape(len(languages), 1 << cfg.bits) + cfg.smoothing
    return languages, np.log(n / n.sum(axis=1, keepdims=True)) if len(languages) else n


def text_likelihoods(rows: DataFrame, model: tuple[list[str], np.ndarray], cfg: LanguageConfig = LanguageConfig(), text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """keep columns and _ll (array<double>): tempered log likelihoods by language."""
    languages, logp = model
    shared = rows.sparkSession.sparkContext.broadcast(logp)  # bounded by max_languages and bits
    names = [f"_k{i}" for i in range(len(keep))]
    x = rows.select(*keep, F.col(text_col).cast("string").alias("_t")).toDF(*names, "_t")
    schema = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, x.schema)), "_ll array<double>"])

    def run(batches):
        p = shared.value
        for b in batches:
            out = np.zeros((b.num_rows, len(languages)))
            for lo, data, offsets in _text.chunks(b.column(b.num_columns - 1)):
                doc, cell = _cells(data, offsets, cfg.bits)
                n = len(offsets) - 1
                for i in range(len(languages)):
                    out[lo : lo + n, i] = np.bincount(doc, weights=p[i][cell], minlength=n)
            at = pa.array(np.arange(b.num_rows + 1) * len(languages), pa.int32())
            yield pa.record_batch([*b.columns[:-1], pa.ListArray.from_arrays(at, pa.array((out * cfg.text_power).ravel()))], [*names, "_ll"])

    return x.mapInArrow(run, schema).toDF(*keep, "_ll")


def _verdict(languages: list[str], score: Column) -> Column:
    """The language of the largest score; of equal ones the first by name."""
    return F.element_at(F.array(*map(F.lit, languages)), F.array_position(score, F.array_max(score)).cast("int"))


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], cfg: LanguageConfig = LanguageConfig(), keep: tuple = ("id",)) -> DataFrame:
    """rows (keep columns, text, url, declared) with language, probability and text_language.

    Null url or declared: no such evidence.
    """
    languages = model[0]
    if not languages:
        return rows.select(*keep, F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_language"))
    host = F.when(F.col("url").isNotNull(), F.nullif(bare_host(url_host(F.col("url"))), F.lit("")))
    x = rows.select(F.struct(*keep).alias("_keep"), "text", host.alias("host"), F.col("declared").cast("string").alias("declared"))
    x = text_likelihoods(x, model, cfg, keep=("_keep", "host", "declared"))
    says = F.when(F.exists("_ll", lambda v: v != 0), _verdict(languages, F.col("_ll")))  # no trigram: no verdict
    x = materialise(x.withColumn("by_text", says), "likelihoods", rows=2000)
    n = len(languages)
    votes = lambda: F.array(*[F.coalesce(F.sum((F.col("by_text") == l).cast("double")), F.lit(0.0)) for l in languages])
    total = lambda v="v": F.array(*[F.sum(F.get(v, F.lit(i))) for i in range(n)])
    own = F.array(*[(F.col("by_text").eqNullSafe(l)).cast("double") for l in languages])
    others = lambda v: F.zip_with(v, own, lambda a, b: a - b)

    one = F.col("by_text").isNotNull().cast("double")

    def smooth(level: str, above: Column) -> Column:
        size = F.col(f"n{level}") - one
        return F.zip_with(others(F.col(f"v{level}")), above, lambda c, p: (c + cfg.strength * p) / (size + cfg.strength))

    every = x.agg(votes().alias("v")).first()["v"]  # one row
    flat = F.transform(others(F.array(*map(F.lit, every))), lambda v: (v + 1) / (sum(every) + n - one))
    hosts = materialise(x.where("host is not null").groupBy("host").agg(votes().alias("vh")), "hosts")
    domain, suffix = site_of(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(total("vh").alias("vd"))
    suffixes = domains.groupBy("suffix").agg(total("vd").alias("vs"))
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, c: a + c).alias("n" + v[1:])
    levels = hosts.join(domains.join(suffixes, "suffix").drop("suffix"), "domain").select("host", *(c for v in ("vh", "vd", "vs") for c in (v, size(v))))
    # P(declared | language), by language: spread by pseudo-rows over the declarations that occur.
    said = x.where("declared is not null").groupBy("declared").agg(votes().alias("v"))
    sums = said.agg(total().alias("s"), F.count(F.lit(1)).alias("m")).first()  # one row
    sums, kinds = [v or 0.0 for v in sums["s"]], max(1, sums["m"])
    y = x.join(levels, "host", "left").join(said.withColumnRenamed("v", "said"), "declared", "left")
    prior = F.when(F.col("vh").isNull(), flat).otherwise(smooth("h", smooth("d", smooth("s", flat))))
    y = y.withColumn("prior", prior)
    spread = F.zip_with(others(F.col("said")), others(F.array(*map(F.lit, sums))), lambda c, s: (c + cfg.declared_noise) / (s + cfg.declared_noise * kinds))
    y = y.withColumn("said", F.when(F.col("said").isNotNull(), spread))
    logs = lambda a: F.transform(a, lambda p: F.ln(p))
    plus = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    score = plus(F.col("_ll"), logs(F.col("prior")))
    score = F.when(F.col("said").isNull(), score).otherwise(plus(score, logs(F.col("said"))))
    y = y.withColumn("_s", score)
    top = F.array_max("_s")
    share = 1 / F.aggregate(F.transform("_s", lambda s: F.exp(s - F.array_max("_s"))), F.lit(0.0), lambda a, v: a + v)
    return y.select("_keep.*", _verdict(languages, F.col("_s")).alias("language"), F.when(top.isNotNull(), share).alias("probability"), F.col("by_text").alias("text_language"))
