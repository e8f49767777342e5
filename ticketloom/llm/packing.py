"""Best-fit packing of token sequences by large-item matching.

Pieces longer than a third of the capacity pair at most twice in a sequence: from the longest down, each takes the
longest partner that fits. Smaller pieces, from the longest down, go to the smallest remaining gap that holds them.
Only lengths matter to this, so it is planned on a histogram of lengths (at most `capacity` numbers, whatever the
size of the input): the plan says for the pieces of a length, by their number within that length, which sequence and
offset they get. Numbers are given by task and shifted by running sums of counts by task; no length is gathered
in one task.

Defined results: a null or empty text is one piece of just the end token. A document longer than the capacity is cut
into pieces of full capacity, the first of which may be shorter. Repeated rows are packed each for itself. An empty
table gives no pieces. Ties in length are numbered in any order. Very long texts are encoded whole. A null id is an id
like any other. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ticketloom.llm import _text
from ticketloom.llm._store import materialise
from ticketloom.llm.bpe import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def tokenize_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """The pieces of each document; nth counts the pieces of one length within one task. With ids as little-endian
    unsigned 32-bit integers, if wanted. `vocabulary` is a tokenizer file (its added tokens count) or a rank file."""

    def run(batches):
        e = encoder(vocabulary)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for lo, data, offsets in _text.chunks(b.column(1)):
                ids, at = e.encode(data, offsets)
                n_docs = len(at) - 1
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(n_docs + 1)
                total = np.diff(at)
                n = -(-total // capacity)
                head = total - (n - 1) * capacity  # length of the first piece
                doc = np.repeat(np.arange(n_docs), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                a = (at[doc] + start).tolist()
                cut = [raw[4 * x : 4 * (x + y)] for x, y in zip(a, length.tolist())]
                order = np.argsort(length, kind="stable")
                own = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(doc), np.int64)
                nth[order] = np.arange(len(doc)) - np.repeat(np.cumsum(own) - own, own)
                nth += seen[length]
                seen += own
                cols = [b.column(0).slice(lo, n_docs).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in cut], pa.int64()), pa.array(np.full(len(doc), task)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    cols.append(pa.array([x.tobytes() for x in cut], pa.binary()))
                    names.append("ids")
                yield pa.record_batch(cols, names)

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return x.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def plan_packing(counts: dict[int, int], capacity: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, sequence, offset, per_bin) from a histogram of lengths.

    The pieces of a length numbered from..to-1 fill sequences sequence, sequence + 1, ..., per_bin to each, one
    after another from offset.
    """
    left = {x: n for x, n in counts.items() if n}
    bins: list[tuple[int, list[tuple[int, int]], int]] = []  # (gap, [(length, in each)], how many)
    large = sorted(x for x in left if 3 * x > capacity)
    for x in reversed(large):
        while left.get(x):
            # The longest partner that fits, itself included.
            k = bisect_left(large, capacity - x + 1) - 1
            while k >= 0 and (not left[large[k]] or large[k] > x or (large[k] == x and left[x] < 2)):
                k -= 1
            if k < 0:
                bins.append((capacity - x, [(x, 1)], left[x]))
                left[x] = 0
                break
            y = large[k]
            n = left[x] // 2 if y == x else min(left[x], left[y])
            bins.append((capacity - x - y, [(x, 2)] if y == x else [(x, 1), (y, 1)], n))
            left[x] -= n
            left[y] -= n
    gaps: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    order: list[int] = []

    def add(gap: int, items: list[tuple[int, int]], n: int) -> None:
        if n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((items, n))

    for gap, items, n in bins:
        add(gap, items, n)
    for x in sorted((x for x in left if 3 * x <= capacity and left[x]), reverse=True):
        n = left[x]
        while n:
            k = bisect_left(order, x)
            if k == len(order):
                c = capacity // x
                add(capacity - c * x, [(x, c)], n // c)
                if n % c:
                    add(capacity - (n % c) * x, [(x, n % c)], 1)
                break
            gap = order[k]
            items, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(k)
            c = gap // x
            full = min(m, n // c)
            add(gap - c * x, [*items, (x, c)], full)
            n -= full * c
            m -= full
            if m and n:  # fewer than c are left
                add(gap - n * x, [*items, (x, n)], 1)
                m, n = m - 1, 0
            add(gap, items, m)
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for groups in gaps.values():
        for items, n in groups:
            offset = 0
            for x, c in items:
                out.append((x, used[x], used[x] + c * n, sequence, offset, c))
                used[x] += c * n
                offset += c * x
            sequence += n
    return out


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces (from tokenize_pieces, written) with sequence_id and offset in place of task and nth."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "task").agg(F.max("nth").alias("n")).withColumn("n", F.col("n") + 1)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = plan_packing(histogram, capacity)
    # Each pattern holds distinct lengths that sum to the capacity at most, and each step of the plan uses up a
    # length or a gap: a few thousand rows, by the capacity and not by the input.
    table = spark.createDataFrame(plan, "length long, lo long, hi long, sequence long, offset long, per long")
    x = pieces.join(counts.select("length", "task", "shift"), ["length", "task"]).withColumn("_r", F.col("nth") + F.col("shift"))
    p = F.broadcast(table).alias("p")
    x = x.join(p, (x["length"] == F.col("p.length")) & (F.col("_r") >= F.col("p.lo")) & (F.col("_r") < F.col("p.hi")))
    at = F.col("_r") - F.col("p.lo")
    rest = ["ids"] if "ids" in pieces.columns else []
    return x.select(
        "doc_id", "piece", "start", pieces["length"], "ids_crc32",
        (F.col("p.sequence") + (at - at % F.col("p.per")) / F.col("p.per")).cast("long").alias("sequence_id"),
        (F.col("p.offset") + at % F.col("p.per") * pieces["length"]).cast("long").alias("offset"), *rest,
    )


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Tokenizes, cuts and packs: doc_id, piece, start, length, ids_crc32, sequence_id, offset and the ids."""
    pieces = materialise(tokenize_pieces(docs, vocabulary, end_id, capacity, text_col, id_col, with_ids), "pieces")
    return pack_pieces(pieces, capacity)
