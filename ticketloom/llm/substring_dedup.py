"""Removal of repeated passages by level-wise doubling.

A window of 35 words can only repeat if the windows of 18 words inside it do, and those only if their windows of 9
words do. So windows of 9 words are counted first; those that repeat are extended to 18, those of them that repeat to
35 (twice 18, cut to the length asked for); it ends early when no candidate survives.

Texts stay where they are: they are written once, in chunks of a few MB, as a table bucketed by chunk, and each level
reads it without a shuffle. A chunk sends each distinct candidate hash once, as arrays by hash bucket (4 bytes a
window, 16 at the last level), so a passage that a third of all rows share costs one hash from each chunk. A bucket
answers each chunk with a bit for each hash: repeated or not. The answers are small and are joined by chunk.

There are as many buckets as keep one at `BUCKET_WINDOWS` windows or so. Rows sent are one for each bucket and chunk
that have something in common, so one for each window at most: beyond a TB or so arrays get short, and a row's own 60
bytes outweigh them. Larger chunks (`chunk_bytes`), where executors have the memory, push that out.

At the early levels a collision of 32 bits within a bucket only keeps a candidate alive; the last level compares 128
bits. Windows are judged on the input; equal means the same words, whatever white space is between them.

Defined results: null text has no words and stays null; texts shorter than the window stay as they are; very long ones
are one chunk each and judged whole; copies of a whole text (repeated rows too) lose all words of their windows, the
first one as well. An empty table gives an empty result. Other columns, with any name, come back unchanged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm import _text
from ticketloom.llm._chunks import Chunks
from ticketloom.llm._store import materialise
from ticketloom.llm._text import U

#: Windows of a bucket, about; they meet in one task.
BUCKET_WINDOWS = 1 << 23
_TWO = np.dtype([("a", "<u8"), ("b", "<u8")])
MARKS = "chunk long, level int, bucket int, n int, bits binary"
SENT = "chunk long, bucket int, n int, hashes binary, twice binary"


def level_lengths(window: int, shortest: int = 9) -> list[int]:
    out = [window]
    while out[0] > shortest:
        out.insert(0, -(-out[0] // 2))
    return out


def _windows(h: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Hashes of windows of the last of the lengths, doubled up from words through each length."""
    k = 1
    for length in lengths:
        while k < length:
            to = min(2 * k, length)
            h, k = _text.double(h, k, to) if len(h) > to - k else h[:0], to
    return h


class Levels:
    """The windows of one chunk, level by level."""

    def __init__(self, text: pa.ChunkedArray, lengths: list[int], buckets: int):
        parts = list(_text.chunks(text))
        self.data = np.concatenate([d for _, d, _ in parts]) if parts else np.zeros(0, np.uint8)
        sizes = np.concatenate([np.diff(o) for _, _, o in parts]) if parts else np.zeros(0, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.h, self.starts, self.ends, self.first = _text.word_hashes(self.data, self.offsets)
        self.lengths, self.buckets = lengths, buckets
        n = np.diff(self.first)
        self.left = np.repeat(self.first[1:], n) - np.arange(len(self.h))  # words from here to the end of the text
        long_enough = np.repeat(n >= lengths[-1], n)
        self.level, self.windows = 0, _windows(self.h, lengths[:1])
        self.at = np.flatnonzero((self.left >= lengths[0]) & long_enough)

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, which of them occur twice here, each candidate's number among them, first key of each
        bucket. Keys have 64 bits, at the last level 128."""
        if self.level < len(self.lengths) - 1:
            own, back, n = np.unique(self.windows[self.at], return_inverse=True, return_counts=True)
            high = own
        else:
            a, b = self.windows[self.at], _windows(_text.span_hashes(self.data, self.starts, self.ends, second=True), self.lengths)[self.at]
            order = np.lexsort((b, a))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            back = np.empty(len(order), np.int64)
            back[order] = np.cumsum(new) - 1
            n = np.bincount(back, minlength=int(new.sum()))
            own = np.empty(int(new.sum()), dtype=_TWO)
            own["a"], own["b"] = a[order[new]], b[order[new]]
            high = own["a"]
        bucket = ((high >> U(32)) * U(self.buckets)) >> U(32)
        return own, n > 1, back, np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=U))

    def repeated(self, marks: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Positions whose window of this level repeats."""
        own, _, back, first = self.keys()
        hit = np.zeros(len(own), dtype=bool)
        for (level, bucket), bits in marks.items():
            if level == self.level:
                a, b = first[bucket], first[bucket + 1]
                hit[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a)
        return self.at[hit[back]]

    def step(self, marks: dict[tuple[int, int], bytes]) -> None:
        """Extend what repeats to the next length."""
        k, to = self.lengths[self.level], self.lengths[self.level + 1]
        alive = np.zeros(len(self.h) + to, dtype=bool)
        at = self.repeated(marks)
        alive[at] = True
        self.windows = _text.double(self.windows, k, to) if len(self.windows) > to - k else self.windows[:0]
        self.at = at[alive[at + (to - k)] & (self.left[at] >= to)]
        self.level += 1


def _read_marks(table: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(x, y): z for x, y, z in zip(table["level"].to_pylist(), table["bucket"].to_pylist(), table["bits"].to_pylist())}


def _emit(text: pa.ChunkedArray, chunk: int, marks: dict, lengths: list[int], level: int, buckets: int) -> pa.Table:
    x = Levels(text, lengths, buckets)
    for _ in range(level):
        x.step(marks)
    own, twice, _, first = x.keys()
    kind = _TWO if level == len(lengths) - 1 else np.uint32
    rows = [(b, first[b], first[b + 1]) for b in np.flatnonzero(np.diff(first))]
    return pa.table({
        "chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array([int(b) for b, _, _ in rows], pa.int32()), "n": pa.array([int(z - a) for _, a, z in rows], pa.int32()),
        "hashes": pa.array([own[a:z].astype(kind).tobytes() for _, a, z in rows], pa.binary()), "twice": pa.array([np.packbits(twice[a:z]).tobytes() for _, a, z in rows], pa.binary()),
    })


def _first(lengths: list[int], buckets: int):
    def run(key, table):
        return _emit(table["_text"], key[0].as_py(), {}, lengths, 0, buckets)

    return run


def _next(lengths: list[int], level: int, buckets: int):
    def run(key, table, marks):
        return _emit(table["_text"], key[0].as_py(), _read_marks(marks), lengths, level, buckets)

    return run


def _answer(level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n = table["n"].to_numpy()
        h = np.frombuffer(b"".join(table["hashes"].to_pylist()), dtype=_TWO if last else np.uint32)
        hit = np.concatenate([np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=k) for b, k in zip(table["twice"].to_pylist(), n)]).astype(bool)
        order = np.lexsort((h["b"], h["a"])) if last else np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        upto = np.concatenate([[0], np.cumsum(n)])
        keep = [i for i in range(len(n)) if hit[upto[i] : upto[i + 1]].any()]
        bits = [np.packbits(hit[upto[i] : upto[i + 1]]).tobytes() for i in keep]
        return pa.table({"chunk": table["chunk"].take(pa.array(keep, pa.int64())), "level": pa.array([level] * len(keep), pa.int32()), "bucket": table["bucket"].take(pa.array(keep, pa.int64())), "n": table["n"].take(pa.array(keep, pa.int64())), "bits": pa.array(bits, pa.binary())})

    return run


def _kept(table: pa.Table, marks: dict, lengths: list[int], done: bool, buckets: int) -> pa.Table:
    """The rows with the words that are left."""
    text = table["_text"]
    x = Levels(text, lengths, buckets)
    cut = np.zeros(len(x.h) + 1, np.int64)
    if done:
        for _ in lengths[1:]:
            x.step(marks)
        at = x.repeated(marks)
        np.add.at(cut, at, 1)
        np.add.at(cut, at + lengths[-1], -1)
    keep = np.cumsum(cut)[:-1] == 0
    n = np.diff(x.first)
    upto = np.concatenate([[0], np.cumsum(keep)])
    left = upto[x.first[1:]] - upto[x.first[:-1]]
    # Each kept word with the space before it, but for the first of a text.
    size = (x.ends - x.starts)[keep] + 1
    out_at = np.concatenate([[0], np.cumsum(size)])
    from_at = x.starts[keep] - 1
    where = np.repeat(from_at - out_at[:-1], size) + np.arange(out_at[-1])
    out = x.data[np.maximum(where, 0)]
    out[out_at[:-1]] = 32
    bounds = out_at[upto[x.first]]
    whole = out.tobytes()
    bounds = bounds.tolist()
    kept = [whole[a + 1 : b].decode("utf-8") for a, b in zip(bounds, bounds[1:])]
    return pa.table({"_rest": table["_rest"], "_text": text, "_n_words": pa.array(n, pa.int64()), "_n_removed": pa.array(n - left, pa.int64()), "_kept": pa.array(kept, pa.string())})


def remove_repeats(docs: DataFrame, window: int = 35, shortest: int = 9, text_col: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """_row (struct of docs' columns, as they were), _n_words, _n_removed and _kept (the words left, joined by one space)."""
    lengths = level_lengths(window, shortest)
    chunks = Chunks(docs, text_col, chunk_bytes)
    n_chunks = chunks.table.select("_chunk").distinct().count()
    buckets = max(chunks.n, n_chunks * chunks.chunk_bytes // (6 * BUCKET_WINDOWS))  # a word of six bytes starts a window
    marks, done = None, True
    for level in range(len(lengths)):
        last = level == len(lengths) - 1
        if marks is None:
            sent = chunks.table.groupBy("_chunk").applyInArrow(_first(lengths, buckets), SENT)
        else:
            sent = chunks.table.groupBy("_chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_next(lengths, level, buckets), SENT)
        found = materialise(sent.groupBy("bucket").applyInArrow(_answer(level, last), MARKS), "marks")
        marks = found if marks is None else marks.unionByName(found)
        if found.isEmpty():
            done = False
            break
    run = lambda t, m: _kept(t, _read_marks(m), lengths, done, buckets)
    kept = chunks.table.groupBy("_chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, chunks.schema() + ", _n_words long, _n_removed long, _kept string")
    return kept.select(F.struct(*chunks.original()).alias("_row"), "_n_words", "_n_removed", "_kept")


def drop_repeats(docs: DataFrame, window: int = 35, text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of text_col; texts without any stay as they are."""
    x = remove_repeats(docs, window, text_col=text_col)
    clean = F.when(F.col("_n_removed") > 0, F.col("_kept")).otherwise(F.col(f"_row.`{text_col}`"))
    return x.select(*[clean.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
