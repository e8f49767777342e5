"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Base counts of each text (words, symbols, repeated lines, repeated three-word windows) become rates. For each (lang,
source) each rate has a mergeable quantile sketch: counts of rows by logarithmic bucket, with which every quantile is
known to `accuracy` of its value. Sketches are exact counts, so merging them in any order gives the same, and so do two runs.
A group's sketch is mixed with `prior_rows` rows spread like its language's, and a language's with as many spread like the whole
table's, so small groups are shrunk towards wider ones and there is no size at which anything switches. A threshold lies
beyond an upper quantile of the mixture by `reach` times the spread from the median to that quantile, and a tenth of the
quantile at least; there is no fixed cutoff. The thresholds are joined to the counts and rows beyond any of them go.

Defined results:
- null or empty text: all counts 0, base_failed true (fewer than 50 words).
- null lang or source form groups of their own (null-safe join); ties at a threshold stay.
- repeated rows are judged alike; an empty table gives an empty result; extra columns are not read.
- very long texts are counted whole; windows are told apart by 64-bit hashes and then by their words.

Texts are never shuffled: only one row of counts for each text is written, and sketches are added up before the shuffle, so a
source with a third of the rows costs a few hundred counts from each task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ticketloom.llm._store import materialise

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
#: The symbols that count.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Rate -> (upper quantile, reach): the fence is the quantile plus `reach` times its distance from the median. Quantiles are such
    #: that the usual share of junk doesn't move them; the symbol rate of texts without symbols only tells their lengths.
    fences: dict = field(default_factory=lambda: {"symbol_rate": (0.75, 25.0), "dup_line_rate": (0.99, 0.25), "repeat_rate": (0.99, 0.5), "long_word": (0.9, 1.5)})
    #: A fence is so many times its quantile at least.
    margin: float = 1.1
    #: Rows spread like the wider kind's (language, whole table) that a sketch counts beside its own.
    prior_rows: int = 10
    #: A quantile is known within so much of its value.
    accuracy: float = 0.02
    #: Symbols and characters that each text counts beside its own, so that a long text without symbols has a lower rate than a short one.
    symbol_prior: float = 0.5


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. words: an array column or lambda variable."""
    hashes = F.when(
        F.size(words) >= 4,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def same(x: Column, y: Column) -> Column:
        p, q = x["at"], y["at"]
        return (x["h"] == y["h"]) & (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))

    def found(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        some = let(pairs, lambda s: let(F.sort_array(F.transform(found(s), lambda x: x["at"])), covered))
        # Most texts repeat nothing; for them the hashes need no sorting.
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    return let(hashes, count)


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words (long each)."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    n_lines = let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("dup")))
    from_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("rep")))
    return F.struct(
        from_words.alias("w"), n_lines.alias("l"),
        F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "long_word")


def quality_counts(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text", keep: tuple = ("doc_id", "lang", "source")) -> DataFrame:
    """One row of counts and rates for each text; no shuffle."""
    x = docs.select(*keep, base_counts(F.col(text_col)).alias("_c"))
    x = x.select(
        *keep, F.col("_c.w.n").alias("n_words"), F.col("_c.word_chars").alias("word_chars"), F.col("_c.n_symbols").alias("n_symbols"),
        F.col("_c.l.dup").alias("n_dup_lines"), F.col("_c.l.n").alias("n_lines"), F.col("_c.w.rep").alias("n_repeat_words"),
    )
    one = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return x.withColumns({
        "base_failed": (F.col("n_words") < cfg.min_words) | (100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words")),
        "symbol_rate": (F.col("n_symbols") + cfg.symbol_prior) / (F.col("word_chars") + 2 * cfg.symbol_prior),
        "dup_line_rate": F.col("n_dup_lines") / one("n_lines"),
        "repeat_rate": F.col("n_repeat_words") / one("n_words"),
        "long_word": F.col("word_chars") / one("n_words"),
    })


_ZERO = -(2**31)


def quantile_sketches(counts: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(lang, source, rate, bucket, n): rows that passed the base rules, by the logarithm of each rate."""
    bucket = lambda r: F.when(F.col(r) > 0, F.floor(F.log(F.col(r)) / math.log1p(cfg.accuracy) + 1e-9).cast("int")).otherwise(_ZERO)
    every = F.array(*[F.struct(F.lit(r).alias("rate"), bucket(r).alias("bucket")) for r in RATES])
    x = counts.where("not base_failed").select("lang", "source", F.explode(every).alias("b"))
    return x.groupBy("lang", "source", "b.rate", "b.bucket").agg(F.count(F.lit(1)).alias("n"))


def _shares(cells: DataFrame, *by: str) -> DataFrame:
    """cells (by..., rate, bucket, w) with each bucket's share of its rate."""
    return cells.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*by, "rate")))


def _mixed(cells: DataFrame, wider: DataFrame, by: tuple[str, ...], on: tuple[str, ...], cfg: QualityConfig) -> DataFrame:
    """cells (by..., rate, bucket, w) plus prior_rows rows for each rate, spread as in `wider` (on..., rate, bucket, share)."""
    groups = cells.select(*by, "rate").distinct()
    w = wider.select(*[F.col(c).alias(f"_{c}") for c in (*on, "rate")], "bucket", (cfg.prior_rows * F.col("share")).alias("w"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), (*on, "rate"), F.lit(True))
    return cells.unionByName(groups.join(w, same).select(*by, "rate", "bucket", "w")).groupBy(*by, "rate", "bucket").agg(F.sum("w").alias("w"))


def adaptive_thresholds(counts: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(lang, source, t_<rate>...): one row for each group. A group has as many buckets as the whole table, some hundred for a rate."""
    cells = materialise(quantile_sketches(counts, cfg), "sketches").withColumn("w", F.col("n").cast("double")).drop("n")
    added = lambda *by: cells.groupBy(*by, "rate", "bucket").agg(F.sum("w").alias("w"))
    by_lang = _mixed(added("lang"), _shares(added()), ("lang",), (), cfg)
    x = _mixed(cells, _shares(by_lang, "lang"), ("lang", "source"), ("lang",), cfg)
    w = Window.partitionBy("lang", "source", "rate")
    x = x.withColumns({"upto": F.sum("w").over(w.orderBy("bucket")), "total": F.sum("w").over(w)})
    per_rate = lambda i: reduce(lambda c, r: c.when(F.col("rate") == r, F.lit(cfg.fences[r][i])), RATES, F.when(F.lit(False), F.lit(0.0)))
    edge = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(F.pow(F.lit(1 + cfg.accuracy), F.col("bucket") + 1))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total") - 1e-6, edge))
    x = x.groupBy("lang", "source", "rate").agg(at(F.lit(0.5)).alias("mid"), at(per_rate(0)).alias("high"))
    t = F.greatest(F.col("high") + per_rate(1) * (F.col("high") - F.col("mid")), cfg.margin * F.col("high"))
    return x.groupBy("lang", "source").agg(*[F.max(F.when(F.col("rate") == r, t)).alias(f"t_{r}") for r in RATES])


def quality_verdicts(docs: DataFrame, cfg: QualityConfig = QualityConfig(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts with thresholds joined by group, and kept."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col(text_col).alias("_text"))
    counts = materialise(quality_counts(x, cfg, "_text"), "quality")
    t = adaptive_thresholds(counts, cfg).withColumnsRenamed({"lang": "_l", "source": "_s"})
    y = counts.join(t, counts["lang"].eqNullSafe(t["_l"]) & counts["source"].eqNullSafe(t["_s"]), "left").drop("_l", "_s")
    beyond = F.lit(False)
    for r in RATES:
        beyond = beyond | F.coalesce(F.col(r) > F.col(f"t_{r}"), F.lit(False))
    return y.withColumn("kept", ~F.col("base_failed") & ~beyond)
