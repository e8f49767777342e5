"""Phrase collocations by language, counted by pivot partitioning as in MG-FSM.

1. Words are counted by language. All words that are frequent enough to be in a frequent phrase get a rank; the most
   frequent ones, at most `dictionary` of them, go to every task. Should there be more frequent words than that, the
   others are told apart by 63 bits of their hash and stand behind all ranked ones, so every phrase is still counted.
2. Around each occurrence of a word (the pivot) a fragment is cut: up to three neighbours on each side within the piece,
   as long as they are not rarer than the pivot (to its left: more frequent, so that of equal words the first is the
   pivot). Each occurrence of a phrase lies in the fragment of exactly one occurrence of its rarest word. Equal fragments
   of a task are sent once, with their number, packed by bucket of pivots. The phrases of a pivot that is more frequent
   than a bucket is large are cut out before they are sent and dealt by phrase, so no word makes a bucket of its own.
3. A bucket counts the phrases that its pivots own, whole, and only gives away frequent ones.

Scores, covering phrases and ranks are joins and groupings of the frequent phrases.

Defined results: null text has no words, null lang counts as `und`; empty texts and tables give no rows; very long texts
are counted whole, in pieces of a bounded number of words at a time; repeated rows count each time; ties in score go by
count and phrase. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ticketloom.llm import _text
from ticketloom.llm._store import materialise
from ticketloom.llm._text import U


@dataclass(frozen=True)
class CollocationConfig:
    longest: int = 4
    least: int = 30
    cover_percent: int = 80
    top: int = 2000
    scale: int = 2_000_000
    #: Most words that every task knows (16 bytes each).
    dictionary: int = 1 << 20
    #: Words that a task gathers before it sends fragments, words by bucket, and above which a pivot is dealt by phrase.
    flush: int = 1 << 20
    bucket_words: int = 1 << 20


_PIECE = np.zeros(256, dtype=bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BLANK = _PIECE.copy()
_BLANK[[9, 32]] = True
_UNKNOWN = "und"


def _multipliers(n: int) -> np.ndarray:
    return _text.mix(np.arange(77, 77 + n, dtype=U)) | U(1)


class Words:
    """The words of a run of texts: two hashes of language and word, and the piece each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        self.low = _text._LOWER[data]
        self.starts, self.ends, first = _text.word_bounds(data, offsets, _BLANK)
        names = langs.fill_null(_UNKNOWN).dictionary_encode()
        self.langs, which = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
        raw = [s.encode() for s in self.langs]
        ends = np.cumsum([len(s) for s in raw], dtype=np.int64)
        text, begin = np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(s) for s in raw]
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.lang = which[doc]
        self.hash, self.check = (_text.mix(_text.span_hashes(self.low, self.starts, self.ends, k) + _text.span_hashes(text, begin, ends, k)[self.lang] * U(0xD6E8FEB86659FD93)) for k in (False, True))
        breaks = np.concatenate([[0], np.cumsum(_PIECE[data], dtype=np.int64)])
        new = np.ones(len(doc), dtype=bool)
        if len(doc):
            new[1:] = (doc[1:] != doc[:-1]) | (breaks[self.starts[1:]] != breaks[self.ends[:-1]])
        self.piece = np.cumsum(new)

    def text(self, at: np.ndarray) -> pa.Array:
        n = self.ends[at] - self.starts[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = self.low[np.repeat(self.starts[at] - upto[:-1], n) + np.arange(upto[-1])]
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _runs(batches):
    """The words of each run of texts of (lang, text) batches."""
    for b in batches:
        for lo, data, offsets in _text.chunks(b.column(1)):
            yield Words(data, offsets, b.column(0).slice(lo, len(offsets) - 1))


def _count_words(batches):
    for w in _runs(batches):
        if not len(w.hash):
            continue
        order = np.argsort(w.hash)
        h, c = w.hash[order], w.check[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        at, n = order[first], np.diff(np.append(first, len(order)))
        names = pa.array(w.langs, pa.string())
        totals = np.bincount(w.lang, minlength=len(w.langs))
        none = np.zeros(len(totals), np.int64)
        yield pa.record_batch([
            pa.concat_arrays([names.take(pa.array(w.lang[at])), names]), pa.concat_arrays([w.text(at), pa.nulls(len(totals), pa.string())]),
            *(pa.array(np.concatenate([x[at].view(np.int64), none])) for x in (w.hash, w.check)), pa.array(np.concatenate([n, totals]).astype(np.int64)),
        ], ["lang", "word", "hash", "check", "n"])


def word_counts(docs: DataFrame, cfg: CollocationConfig, text_col: str, lang_col: str) -> DataFrame:
    """(lang, word, hash, check, n): words that are frequent enough; with a null word all of a language."""
    x = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    x = x.mapInArrow(_count_words, "lang string, word string, hash long, check long, n long")
    x = x.groupBy("lang", "word").agg(F.max("hash").alias("hash"), F.max("check").alias("check"), F.sum("n").alias("n"))
    return x.where((F.col("n") >= cfg.least) | F.col("word").isNull())


class Ranks:
    """Ranks of the most frequent words, by two hashes: 1 is the most frequent. Words beyond them: 0 if all frequent words are
    ranked, else a number of their own behind all ranks."""

    def __init__(self, hashes: np.ndarray, checks: np.ndarray, n: np.ndarray, complete: bool):
        order = np.lexsort((hashes, -n))
        by = np.argsort(hashes[order], kind="stable")
        self.hashes, self.checks, self.rank, self.complete = hashes[order][by], checks[order][by], (by + 1).astype(U), complete
        self.kind = np.uint32 if complete else U

    def of(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        other = np.zeros(len(hashes), dtype=U) if self.complete else (hashes >> U(1)) | U(1 << 63)
        if not len(self.hashes):
            return other.astype(self.kind)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.checks[at] == checks), self.rank[at], other).astype(self.kind)


def _ranks(words: DataFrame, cfg: CollocationConfig) -> tuple[Ranks, np.ndarray]:
    """Ranks, and counts by rank. What comes to the driver is at most `dictionary` words' numbers, and a row for each eighth of a doubling."""
    step = F.floor(F.log2("n") * 8)
    sizes = words.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()
    least, held = None, 0
    for r in sorted(sizes, key=lambda r: -r.s):
        if held + r.k > cfg.dictionary:
            break
        least, held = r.s, held + r.k
    t = words.where(step >= least).select("hash", "check", "n").toArrow() if held else pa.table({c: pa.array([], pa.int64()) for c in ("hash", "check", "n")})
    h, c, n = (t.column(i).to_numpy() for i in range(3))
    return Ranks(h.view(U), c.view(U), n, held == sum(r.k for r in sizes)), -np.sort(-n)


def _fragments(ids: np.ndarray, piece: np.ndarray, own: np.ndarray, longest: int) -> np.ndarray:
    """A row for each own word that has a neighbour: it in the middle, and what belongs to it on both sides, 0 elsewhere."""
    mid, n = longest - 1, len(ids)
    out = np.zeros((n, 2 * longest - 1), dtype=ids.dtype)
    out[:, mid] = ids
    for side in (-1, 1):
        there = ids != 0
        for j in range(1, longest):
            if j >= n:
                break
            near, at = (slice(0, n - j), slice(j, n)) if side < 0 else (slice(j, n), slice(0, n - j))
            fits = (ids[near] != 0) & (piece[near] == piece[at]) & ((ids[near] < ids[at]) if side < 0 else (ids[near] <= ids[at]))
            now = np.zeros(n, dtype=bool)
            now[at] = there[at] & fits
            there = now
            out[at, mid + side * j] = np.where(there[at], ids[near], 0)
    return out[own & (out[:, mid] != 0) & ((out[:, mid - 1] != 0) | (out[:, mid + 1] != 0))]


def _phrases(fragments: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of a length around the middle of fragments, and how often each stands there."""
    mid = fragments.shape[1] // 2
    rows, counts = [], []
    for a in range(mid - length + 1, mid + 1):
        there = (fragments[:, a] != 0) & (fragments[:, a + length - 1] != 0)
        rows.append(fragments[there, a : a + length])
        counts.append(n[there])
    return np.concatenate(rows), np.concatenate(counts)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), dtype=U)
    for k, m in enumerate(_multipliers(rows.shape[1])):
        h += rows[:, k].astype(U) * m
    return _text.mix(h)


def _summed(rows: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal neighbours of the ordered rows as one, with the sum of their numbers."""
    rows, n = rows[order], n[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(n, at) if len(at) else n


def _packed(rows: np.ndarray, n: np.ndarray, bucket: np.ndarray, buckets: int, length: int) -> list[tuple]:
    """(bucket, length, rows, numbers) as bytes; equal rows are one where the order brings them together."""
    shift = U(64 - buckets.bit_length())
    order = np.argsort((bucket << shift) | (_row_hash(rows) >> (U(64) - shift)))
    bucket = bucket[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
    at = np.flatnonzero(new)
    rows, n, bucket = rows[order[at]], np.add.reduceat(n[order], at), bucket[at]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
    return [(int(bucket[a]), length, rows[a:z].tobytes(), n[a:z].tobytes()) for a, z in zip(edges, edges[1:])]


SENT = "bucket int, length int, ids binary, counts binary"


def _send(cfg: CollocationConfig, ranks: Ranks, hot: int, buckets: int):
    """Fragments by bucket; the phrases of pivots up to rank `hot` by themselves. length 0: fragments."""

    def dealt(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        n = np.ones(len(x), np.int64)
        mid = x[:, cfg.longest - 1]
        rare = mid > hot
        out = _packed(x[rare], n[rare], _text.mix(mid[rare].astype(U)) % U(buckets), buckets, 0) if rare.any() else []
        if not rare.all():
            for length in range(2, cfg.longest + 1):
                rows, k = _phrases(x[~rare], n[~rare], length)
                if len(rows):
                    out += _packed(rows, k, _row_hash(rows) % U(buckets), buckets, length)
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "length", "ids", "counts"])

    def run(batches):
        parts, held = [], 0
        for w in _runs(batches):
            ids = ranks.of(w.hash, w.check)
            for a in range(0, len(ids), cfg.flush):  # a long text in parts, with the neighbours that its ends need
                lo, hi = max(0, a - cfg.longest + 1), min(len(ids), a + cfg.flush + cfg.longest - 1)
                own = np.zeros(hi - lo, dtype=bool)
                own[a - lo : min(len(ids), a + cfg.flush) - lo] = True
                x = _fragments(ids[lo:hi], w.piece[lo:hi], own, cfg.longest)
                if len(x):
                    parts.append(x)
                    held += len(x)
                if held >= cfg.flush:
                    yield dealt(parts)
                    parts, held = [], 0
        if parts:
            yield dealt(parts)

    return run


def _mine(cfg: CollocationConfig, kind):
    """Frequent phrases of a partition's buckets."""

    def run(batches):
        got: dict[int, list] = {length: [] for length in (0, *range(2, cfg.longest + 1))}
        for b in batches:
            for length, ids, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                got[length].append((np.frombuffer(ids, dtype=kind).reshape(-1, length or 2 * cfg.longest - 1), np.frombuffer(n, dtype=np.int64)))
        if not any(got.values()):
            return
        fragments, n = (np.concatenate(x) for x in zip(*got.pop(0))) if got[0] else (np.zeros((0, 2 * cfg.longest - 1), kind), np.zeros(0, np.int64))
        for length in range(2, cfg.longest + 1):
            own = _phrases(fragments, n, length)
            rows, k = (np.concatenate(x) for x in zip(own, *got.pop(length)))
            h = _row_hash(rows)
            order = np.argsort(h)
            if len(order) and ((h[order[1:]] == h[order[:-1]]) & (rows[order[1:]] != rows[order[:-1]]).any(axis=1)).any():
                order = np.lexsort(rows.T)  # two phrases of one hash
            rows, k = _summed(rows, k, order)
            often = k >= cfg.least
            rows, k = rows[often].astype(U).view(np.int64), k[often]
            if len(k):
                yield pa.record_batch([pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, length), pa.int32()), pa.array(rows.reshape(-1))), pa.array(k)], ["gram", "a"])

    return run


def frequent_phrases(docs: DataFrame, cfg: CollocationConfig = CollocationConfig(), text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gram array<long>, a): frequent phrases of word numbers; (id, lang, word, n): those numbers; (lang, n): all words."""
    spark = docs.sparkSession
    counted = materialise(word_counts(docs, cfg, text_col, lang_col), "words")
    totals = counted.where("word is null").select("lang", "n")
    words = counted.where("word is not null")
    ranks, n = _ranks(words, cfg)

    def number(batches):
        for b in batches:
            ids = ranks.of(*(b.column(i).to_numpy().view(U) for i in (2, 3))).astype(U).view(np.int64)
            yield pa.record_batch([pa.array(ids), b.column(0), b.column(1), b.column(4)], ["id", "lang", "word", "n"])

    named = materialise(words.mapInArrow(number, "id long, lang string, word string, n long"), "numbers")
    size = totals.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // cfg.bucket_words))
    hot = int(np.searchsorted(-n, -cfg.bucket_words, side="left"))  # ranks of more words than a bucket has
    x = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sent = x.mapInArrow(_send(cfg, ranks, hot, buckets), SENT)
    grams = materialise(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_mine(cfg, ranks.kind), "gram array<long>, a long"), "phrases", rows=256)
    return grams, named, totals


def collocations(docs: DataFrame, cfg: CollocationConfig = CollocationConfig(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases. A phrase counts by its worst cut and only if
    no longer phrase around it is nearly as frequent."""
    return ranked(*frequent_phrases(docs, cfg, text_col, lang_col), cfg)


def ranked(grams: DataFrame, named: DataFrame, totals: DataFrame, cfg: CollocationConfig) -> DataFrame:
    """collocations() of what frequent_phrases() gives."""
    often = grams.unionByName(named.select(F.array("id").alias("gram"), F.col("n").alias("a")))
    k, size = F.col("k"), F.size("gram")
    cuts = grams.select("gram", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("gram", F.lit(1), k), "tail": F.slice("gram", k + 1, size - k)})
    cuts = cuts.join(often.select(F.col("gram").alias("head"), F.col("a").alias("l")), "head").join(often.select(F.col("gram").alias("tail"), F.col("a").alias("r")), "tail")
    wide = lambda c: f"cast({c} as decimal(38, 0))"
    score = F.expr(f"({wide(cfg.scale)} * a) div ({wide('l')} + {wide('r')})")
    worst = cuts.withColumn("score", score).groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w")).select("gram", "a", "w.l", "w.r", "w.score")

    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("gram", i, n))))
    around = grams.where(size > 2).select(F.explode(inside).alias("gram"), F.col("a").alias("longer")).groupBy("gram").agg(F.max("longer").alias("longer"))
    covered = F.coalesce(F.expr(f"100 * {wide('longer')} >= {cfg.cover_percent} * {wide('a')}"), F.lit(False))
    left = worst.join(around, "gram", "left").where(~covered).drop("longer")

    spelt = left.select("*", F.posexplode("gram").alias("at", "id")).join(named.select("id", "lang", "word"), "id")
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])  # four at most
    spelt = spelt.groupBy("gram", "a", "l", "r", "score").agg(F.min("lang").alias("lang"), F.array_join(words, " ").alias("phrase"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    # First within 64 parts of a language, so that a large one isn't one task's window.
    some = spelt.withColumn("_p", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(best("lang", "_p"))).where(F.col("rank") <= cfg.top).drop("_p")
    some = some.withColumn("rank", F.row_number().over(best("lang")).cast("long")).where(F.col("rank") <= cfg.top)
    return some.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
