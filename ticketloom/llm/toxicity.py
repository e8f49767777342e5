"""Toxicity by nearest labelled examples in TF-IDF space.

A bounded sample of labelled rows (`max_examples`, a uniform one by hash) gives the examples; copies of a text are
one. Their terms are lower-cased runs of letters and digits, and the first bytes of each, so that inflected forms
share a term; a term that makes up a larger share of a text's words counts again for each step of `rates` reached.
Terms in `min_df` examples or more make the vocabulary by the chi-square of their split over the classes, whichever class
they tell of and however many they are. Two bounds serve, both known from model choice: telling terms have the logarithm
of the number of examples or more (Schwarz) and are `min_lift` times as frequent in one class as in the other, possible
ones have 2 or more (Akaike) and are in no more than `max_df` of all documents. A text with telling terms is compared by these, any other by possible ones. Document
frequencies come from all documents. Vectors are log tf times idf, of length 1 within the terms compared.

The index holds postings by term, cut into blocks of examples, and each block's largest weight of each term it holds.
A query's bound for a block is the dot product with these maxima. Blocks are scored exactly from the largest bound
down, until the k-th best cosine is no less than the next bound: the k nearest are exact. Votes are weighted by
similarity, shrunk to the base rate, and mapped by a monotone fit to a calibrated score. One example in `folds` is
kept from choosing the vocabulary, and the fit is made of these examples' votes, each without itself (of all
examples' votes where those kept lack a class). The evidence lists the nearest examples.

Labels are read only to learn; scores depend on the text alone.

Defined results: a null or empty text, or one without any term of the vocabulary, gets the rate of such examples.
Labels that are null don't count; of several labels for a document the largest counts. Equal cosines are ranked by
the order of the index. Without examples, or without examples of both classes, every score is the base rate. Extra
columns are not read; repeated rows are scored alike; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ticketloom.llm import _text
from ticketloom.llm._store import materialise
from ticketloom.llm._text import U


@dataclass(frozen=True)
class ToxicityConfig:
    """Settings chosen by cross-validation inside the rows that may be learned from (tests/llm/choose_toxicity.py)."""

    #: Bound of the sample of labelled rows that is learned from.
    max_examples: int = 20000
    min_df: int = 5
    #: Of a telling term; chance alone makes common words differ a little.
    min_lift: float = 2.0
    #: Chi-square of a possible term.
    min_chi2: float = 2.0
    #: Possible terms in a larger share of all documents are left out.
    max_df: float = 0.05
    #: One example in so many calibrates and doesn't choose terms.
    folds: int = 4
    prefix_bytes: tuple = (4, 5, 6, 7)
    rates: tuple = (0.004, 0.008, 0.012)
    k: int = 10
    block: int = 512
    #: Pseudo-votes of the base rate.
    prior: float = 0.25
    threshold: float = 0.7
    #: Vectors whose result a worker remembers.
    remembered: int = 20000
    evidence: int = 3


def learn_rows(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is not 1; a null id is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


#: Set apart the steps of a term's rate and the beginnings of words.
_STEPS = tuple(U(x) for x in _text.mix(np.arange(1, 9, dtype=U)))
_BEGINS = U(0x5BD1E9955BD1E995)


def _terms(data: np.ndarray, offsets: np.ndarray, cfg: ToxicityConfig, sieve: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term hash, count), each term of a text once. sieve: which upper 20 bits of hashes matter."""
    h, starts, ends, first = _text.word_hashes(data, offsets, lower=True, blank=_text.NOT_ALNUM)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    low = _text._LOWER[data]
    parts = [(doc, h)]
    for n in cfg.prefix_bytes:
        long = ends - starts > n
        parts.append((doc[long], _text.span_hashes(low, starts[long], starts[long] + n) ^ _BEGINS))
    if sieve is not None:
        parts = [(d[k], x[k]) for d, x in parts for k in [sieve[(x >> U(44)).astype(np.int64)]]]
    doc, h = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    doc, h = doc[at], h[at]
    rate = n / np.maximum(1, n_words[doc])
    out = [(doc, h, n)] + [(doc[rate >= r], h[rate >= r] ^ step, np.ones((rate >= r).sum(), np.int64)) for r, step in zip(cfg.rates, _STEPS)]
    return tuple(np.concatenate(x) for x in zip(*out))


def _term_counts(cfg: ToxicityConfig):
    def run(batches):
        for b in batches:
            toxic = b.column(1).to_numpy(zero_copy_only=False)
            for lo, data, offsets in _text.chunks(b.column(0)):
                doc, h, _ = _terms(data, offsets, cfg)
                own, at = np.unique(h, return_inverse=True)
                y = toxic[lo + doc]
                yield pa.record_batch([pa.array(own.view(np.int64)), pa.array(np.bincount(at, weights=y, minlength=len(own)).astype(np.int64)), pa.array(np.bincount(at, weights=1 - y, minlength=len(own)).astype(np.int64))], ["term", "bad", "good"])

    return run


def _sieve(vocabulary: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, dtype=bool)
    for step in (U(0), *_STEPS):
        out[((vocabulary ^ step) >> U(44)).astype(np.int64)] = True
    return out


def _sparse(vocabulary: np.ndarray, sieve: np.ndarray, data: np.ndarray, offsets: np.ndarray, cfg: ToxicityConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term number, count) of the vocabulary's terms, by text and term."""
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    doc, h, n = _terms(data, offsets, cfg, sieve)
    at = np.searchsorted(vocabulary, h)
    hit = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h
    doc, at, n = doc[hit], at[hit], n[hit]
    order = np.lexsort((at, doc))
    return doc[order], at[order], n[order]


def _document_frequencies(vocabulary: np.ndarray, cfg: ToxicityConfig):
    def run(batches):
        sieve = _sieve(vocabulary)
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for b in batches:
            df[-1] += b.num_rows
            for _, data, offsets in _text.chunks(b.column(0)):
                df[:-1] += np.bincount(_sparse(vocabulary, sieve, data, offsets, cfg)[1], minlength=len(vocabulary))
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(at), pa.array(df[at])], ["term", "df"])

    return run


def _example_vectors(vocabulary: np.ndarray, cfg: ToxicityConfig):
    def run(batches):
        sieve = _sieve(vocabulary)
        for b in batches:
            for lo, data, offsets in _text.chunks(b.column(3)):
                doc, term, n = _sparse(vocabulary, sieve, data, offsets, cfg)
                at = np.searchsorted(doc, np.arange(len(offsets)))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32())) for x in (term, n)]
                yield pa.record_batch([*(b.column(i).slice(lo, len(at) - 1) for i in range(3)), *lists], ["doc_id", "toxic", "aside", "terms", "counts"])

    return run


class BlockMaxIndex:
    """Postings of example vectors with block maxima; exact top k by cosine."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]], idf: np.ndarray, cfg: ToxicityConfig):
        self.idf, self.k, self.block = idf, cfg.k, cfg.block
        filled = [r for r in rows if len(r[2])]
        # Examples of one language share their most common term, so they lie together and others' blocks have low bounds.
        filled.sort(key=lambda r: (int(r[2][np.argmin(idf[r[2]])]), r[1], r[0]))
        self.ids = np.array([r[0] for r in filled], dtype=np.int64)
        self.toxic = np.array([r[1] for r in filled], dtype=np.float64)
        n, v = len(filled), len(idf)
        term = np.concatenate([r[2] for r in filled]).astype(np.int32) if n else np.zeros(0, np.int32)
        example = np.repeat(np.arange(n, dtype=np.int32), [len(r[2]) for r in filled]) if n else np.zeros(0, np.int32)
        order = np.argsort(term, kind="stable")  # examples stay in order within a term
        self.weight = np.concatenate([self.weights(r[2], r[3]) for r in filled])[order] if n else np.zeros(0)
        term, example = term[order], example[order]
        self.n_blocks = -(-n // self.block) if n else 0
        # A cell is a term in a block that holds it: its block, its largest weight, its first posting.
        block = example // self.block
        self.slot = (example % self.block).astype(np.int16 if self.block <= 1 << 15 else np.int32)
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.cell_block = block[at].astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.cell_first = np.append(at, len(term)).astype(np.int32)
        self.first_cell = np.searchsorted(term[at], np.arange(v + 1)).astype(np.int32)

    def weights(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def nearest(self, terms: np.ndarray, counts: np.ndarray, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, those with a cosine of 0 left out."""
        q = self.weights(terms, counts)
        first = self.first_cell[terms]
        n = self.first_cell[terms + 1] - first
        cell = _ranges(first, n)
        block, weight = self.cell_block[cell], np.repeat(q, n)
        bounds = np.bincount(block, weights=weight * self.cell_max[cell], minlength=self.n_blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        rank = np.full(self.n_blocks, len(order))
        rank[order] = np.arange(len(order))
        turn = rank[block].astype(np.int16 if self.n_blocks < 1 << 15 else np.int64)  # short numbers sort by radix
        by_turn = np.argsort(turn, kind="stable")
        cell, weight, turn = cell[by_turn], weight[by_turn], turn[by_turn]
        at, sim = np.zeros(0, np.int64), np.zeros(0)
        i, step = 0, 16
        while i < len(order) and not (len(sim) == self.k and sim[-1] >= bounds[order[i]] + 1e-12):
            lo, hi = np.searchsorted(turn, [i, i + step])
            posts = self.cell_first[cell[lo:hi]]
            m = self.cell_first[cell[lo:hi] + 1] - posts
            posting = _ranges(posts, m)
            local = np.repeat((turn[lo:hi].astype(np.int32) - i) * self.block, m) + self.slot[posting]
            got = np.bincount(local, weights=np.repeat(weight[lo:hi], m) * self.weight[posting])
            # Only what may be among the best is sorted: one more than k, should `skip` be among them.
            hit = np.flatnonzero(got >= sim[-1] if len(sim) == self.k else got > 0)
            if len(hit) > self.k + 1:
                own = got[hit]
                hit = hit[own >= np.partition(own, -self.k - 1)[-self.k - 1]]
            who = order[i + hit // self.block] * self.block + hit % self.block
            keep = who != skip
            at, sim = np.concatenate([at, who[keep]]), np.concatenate([sim, got[hit[keep]]])
            best = np.lexsort((at, -sim))[: self.k]
            at, sim = at[best], sim[best]
            i, step = i + step, 4 * step
        return at, sim


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those from first[1], and so on."""
    upto = np.cumsum(n)
    return np.repeat((first - (upto - n)).astype(np.int32), n) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)


class Model:
    """vocabulary, index, base rates and calibration; small by the bounds of the configuration."""

    def __init__(self, cfg: ToxicityConfig, vocabulary: np.ndarray, telling: np.ndarray, idf: np.ndarray, rows: list):
        self.cfg, self.vocabulary, self.telling = cfg, vocabulary, telling
        self.seen: dict[bytes, tuple] = {}  # results of vectors that came before
        y = np.array([r[1] for r in rows], dtype=np.float64)
        self.base = float((y.sum() + 0.5) / (len(y) + 1))
        empty = np.array([r[1] for r in rows if not len(r[2])], dtype=np.float64)
        self.blank = float((empty.sum() + self.base) / (len(empty) + 1))
        some = [(r[0], r[1], r[2][telling[r[2]]], r[3][telling[r[2]]]) for r in rows]
        self.indexes = BlockMaxIndex(rows, idf, cfg), BlockMaxIndex(some, idf, cfg)
        number = [{int(d): i for i, d in enumerate(x.ids)} for x in self.indexes]
        self.knots = None
        votes = lambda some: isotonic([(self.vote(*self.nearest(r[2], r[3], number, int(r[0]))), r[1]) for r in some if len(r[2])])
        self.knots = votes([r for r in rows if r[4]]) or votes(rows)

    def nearest(self, terms: np.ndarray, counts: np.ndarray, number: list[dict] | None = None, skip: int | None = None):
        """(index, numbers, cosines): by telling terms, else by possible ones."""
        sure = self.telling[terms]
        some = int(sure.any())
        index = self.indexes[some]
        if some:
            terms, counts = terms[sure], counts[sure]
        return index, *index.nearest(terms, counts, -1 if number is None else number[some][skip])

    def vote(self, index: BlockMaxIndex, at: np.ndarray, sim: np.ndarray) -> float:
        if not len(at):
            return self.base
        return float(((sim * index.toxic[at]).sum() + self.cfg.prior * self.base) / (sim.sum() + self.cfg.prior))

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, list[tuple[int, float, int]]]:
        """Score and evidence (id, similarity, label)."""
        if not len(terms):
            return self.blank, []
        key = hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest()
        if key not in self.seen:
            index, at, sim = self.nearest(terms, counts)
            vote = self.vote(index, at, sim)
            fitted = float(np.interp(vote, *self.knots)) if self.knots else vote
            if len(self.seen) >= self.cfg.remembered:
                self.seen.clear()
            evidence = [(int(index.ids[i]), float(c), int(index.toxic[i])) for i, c in zip(at[: self.cfg.evidence], sim)]
            self.seen[key] = fitted, evidence
        return self.seen[key]


def isotonic(votes: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray] | None:
    """Pooled adjacent violators: rising vote -> share of label 1, shrunk by half an example each way."""
    if not votes or len({y for _, y in votes}) < 2:
        return None
    pools: list[list[float]] = []  # sum of votes, sum of labels, n
    for v, y in sorted(votes):
        pools.append([v, y, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            a = pools.pop()
            pools[-1] = [x + z for x, z in zip(pools[-1], a)]
    return np.array([v / n for v, _, n in pools]), np.array([(s + 0.5) / (n + 1) for _, s, n in pools])


def learn(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), text_col: str = "text", id_col: str = "doc_id") -> Model:
    """labels (doc_id, toxic): rows outside learn_rows() and nulls are left out."""
    own = labels.where(F.col("toxic").isNotNull() & learn_rows(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_examples)  # a bounded top-n, merged by task
    text = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    # The sample has max_examples rows of two numbers at most.
    examples = text.join(F.broadcast(sample), F.col("_id") == F.col("doc_id")).groupBy("doc_id", "toxic").agg(F.min("_text").alias("_text"))
    # Copies of a text are one example, so they neither outvote others nor make its words telling.
    examples = examples.groupBy("_text", "toxic").agg(F.min("doc_id").alias("doc_id"))
    examples = materialise(examples.withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(cfg.folds)) == 0), "examples")
    choosing = examples.where("not aside")
    n = {r.toxic: r.n for r in choosing.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    bad, good = float(sum(v for k, v in n.items() if k >= 1)), float(sum(v for k, v in n.items() if k < 1))
    counts = choosing.select("_text", (F.col("toxic") >= 1).cast("double").alias("y")).mapInArrow(_term_counts(cfg), "term long, bad long, good long")
    counts = counts.groupBy("term").agg(F.sum("bad").alias("a"), F.sum("good").alias("b"))
    vocabulary, sure = np.zeros(0, dtype=U), np.zeros(0, dtype=bool)
    if bad and good:
        a, b = F.col("a"), F.col("b")
        df, total = a + b, bad + good
        chi2 = total * (a * good - b * bad) ** 2 / (df * (total - df + 1e-9) * bad * good)
        picked = counts.where((df >= cfg.min_df) & (chi2 >= cfg.min_chi2))
        lift = ((a + 0.5) / (bad + 1)) / ((b + 0.5) / (good + 1))
        sure = (chi2 >= float(np.log(total))) & (F.greatest(lift, 1 / lift) >= cfg.min_lift)
        picked = picked.select("term", sure.alias("sure")).toPandas()  # terms of max_examples texts
        vocabulary = picked["term"].to_numpy(dtype=np.int64).view(U)
        order = np.argsort(vocabulary)
        vocabulary, sure = vocabulary[order], picked["sure"].to_numpy(dtype=bool)[order]
    df = np.zeros(len(vocabulary) + 1)
    for r in text.select("_text").mapInArrow(_document_frequencies(vocabulary, cfg), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r.term] = r.df  # a row for each term of the vocabulary
    stays = sure | (df[:-1] <= max(cfg.max_df * df[-1], cfg.min_df))
    vocabulary, sure, df = vocabulary[stays], sure[stays], np.append(df[:-1][stays], df[-1])
    idf = np.log1p(df[-1] / np.maximum(1, df[:-1]))
    vectors = examples.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "aside", "_text").mapInArrow(_example_vectors(vocabulary, cfg), "doc_id long, toxic int, aside boolean, terms array<int>, counts array<int>")
    t = vectors.toArrow()  # max_examples rows
    ids, toxic, aside = (t.column(c).to_pylist() for c in ("doc_id", "toxic", "aside"))
    lists = [t.column(c).combine_chunks() for c in ("terms", "counts")]
    at = lists[0].offsets.to_numpy()
    term, count = (x.values.to_numpy() for x in lists)
    rows = [(d, int(y >= 1), term[a:z], count[a:z], k) for d, y, k, a, z in zip(ids, toxic, aside, at[:-1].tolist(), at[1:].tolist())]
    rows.sort(key=lambda r: r[0])
    return Model(cfg, vocabulary, sure, idf, rows)


SCORED = "_toxicity double, _evidence array<struct<doc_id:long,similarity:double,toxic:int>>"


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """keep columns, _toxicity (0 to 1), _evidence (nearest examples) and, if wanted, _text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the terms of max_examples texts
    x = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_text"))
    names = [f"_k{i}" for i in range(len(keep))]
    x = x.toDF(*names, "_text")
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, x.schema)) + ", " + SCORED + ", _text string" * keep_text

    def run(batches):
        m = shared.value
        sieve = _sieve(m.vocabulary)
        for b in batches:
            scores, evidence = [], []
            for _, data, offsets in _text.chunks(b.column(b.num_columns - 1)):
                doc, term, n = _sparse(m.vocabulary, sieve, data, offsets, m.cfg)
                at = np.searchsorted(doc, np.arange(len(offsets))).tolist()
                for a, z in zip(at, at[1:]):
                    score, found = m.score(term[a:z], n[a:z])
                    scores.append(score)
                    evidence.append([dict(zip(("doc_id", "similarity", "toxic"), e)) for e in found])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
            text = [b.columns[-1]] * keep_text
            yield pa.record_batch([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(evidence, kind), *text], [*names, "_toxicity", "_evidence", *["_text"] * keep_text])

    return x.mapInArrow(run, schema).toDF(*keep, "_toxicity", "_evidence", *["_text"] * keep_text)


def reject_toxic(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs below the threshold, with their own columns."""
    model = learn(docs, labels, cfg, text_col, id_col)
    rest = [c for c in docs.columns if c != text_col]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"), F.col(text_col).alias("_judged"))
    x = score_texts(row, model, "_judged", ("_rest",), keep_text=True).where(F.col("_toxicity") < cfg.threshold)
    return x.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns])
