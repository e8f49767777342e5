"""Byte-level BPE encoding and decoding in numpy.

Texts are cut by the character classes of the published pattern ('s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|
\\s+(?!\\S)|\\s+) with array operations over code points. Distinct pieces that are not known yet are merged in padded
matrices, one for each bucket of byte lengths (`BUCKETS`): each round every row merges its leftmost pair of least rank,
pairs are found in a hash table of (left, right) -> rank, and rows without a mergeable pair leave the matrix. A row of L bytes costs O(L) a
round, so pieces of more than `WIDEST` bytes (runs of base64, say) are merged one at a time from a heap of pairs
instead, in the same order, by O(L log L). Pieces are kept in a bounded hash table by worker (`MAX_PIECES`); when it is
full it is emptied, which costs time and changes no result.

A vocabulary is a rank file (.tiktoken: every pair that makes a token merges, strings of special tokens are ordinary
text) or a tokenizer file (.json: the merges it lists, and its added tokens are cut out of texts first and stand for
themselves).

Defined results: null text encodes as empty (0 tokens, hashes of nothing); ties of rank go to the left; repeated rows
and empty tables need nothing special; very long texts and pieces are encoded whole. Columns other than id and text
are not read. Pieces are told apart by two independent 64-bit hashes; two that share the first are kept apart by the second.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ticketloom.llm import _text
from ticketloom.llm._text import U

MAX_PIECES = 1 << 20
#: Bytes of a piece that is merged in a matrix.
WIDEST = 512
#: Widths of the matrices: pieces are padded to the next one.
BUCKETS = np.array([*range(1, 17), 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512])
#: Fills a row after its piece; no pair has it.
_PAD = np.int32(2**31 - 2)
_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


class PairTable:
    """Open addressing from a 64-bit key other than 0 to an int32."""

    def __init__(self, bits: int):
        self.mask = np.int64((1 << bits) - 1)
        self.shift = U(64 - bits)
        self.keys = np.zeros(1 << bits, dtype=U)
        self.values = np.zeros(1 << bits, dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, _NONE where there is none."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], _NONE)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys: distinct and new."""
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & self.mask


def character_classes() -> np.ndarray:
    import regex

    every = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, _OTHER, dtype=np.uint8)
    for what, cls in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(what, every):
            out[m.start() : m.end()] = cls
    return out


def letters_of_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level tokenizer file: printable ones for themselves, the others
    for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(i if i in shown else next(other)) for i in range(256)]


def read_ranks(path: str):
    """(token -> id, (left id, right id, id) of the pairs that merge, whether a piece that is a token is taken whole, added
    tokens). Ids are in the order of merging."""
    with open(path, "rb") as f:
        if not path.endswith(".json"):
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            return ranks, [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], True, {}
        spec = json.load(f)
    added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    if spec["normalizer"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("tokenizer files that normalize texts or widen added tokens are not supported")
    byte = {c: i for i, c in enumerate(letters_of_bytes())}
    raw = lambda token: bytes(byte[c] for c in token)
    vocabulary, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    ranks = {raw(t): i for t, i in vocabulary.items() if i not in added.values()}
    pairs = [(vocabulary[x], vocabulary[y], vocabulary[x + y]) for x, y in merges]
    if any(p[2] >= q[2] for p, q in zip(pairs, pairs[1:])):
        raise ValueError("the ids of this file are not in the order of its merges")
    return ranks, pairs, bool(spec["model"].get("ignore_merges")), added


class Encoder:
    """Encodes and decodes with the vocabulary of a .tiktoken or tokenizer .json file."""

    def __init__(self, path: str):
        ranks, pairs, take_whole, self.added = read_ranks(path)
        self.classes = character_classes()
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.pairs = PairTable(20)
        left, right, rank = np.array(pairs, dtype=np.int64).T
        self.pairs.put((left << 32 | right).astype(U) + U(1), rank.astype(np.int32))
        by_id = [b""] * (max([*ranks.values(), *self.added.values()]) + 1)
        for t, r in [*ranks.items(), *self.added.items()]:
            by_id[r] = t
        self.token_len = np.array(list(map(len, by_id)), dtype=np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.whole = ranks if take_whole else {}
        self.rank_of = {(x << 32 | y): r for x, y, r in pairs}
        self.cuts = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.forget()

    def forget(self) -> None:
        self.known = PairTable(21)
        self.n_known = 0
        self.at, self.n, self.check = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, dtype=U)
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts of the pieces (with the end of the data last), and the first piece of each text."""
        if not len(data):
            return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead)
        cp = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        cls = self.classes[cp]
        n = len(cp)
        opens = np.zeros(n + 1, dtype=bool)
        doc = np.searchsorted(at, offsets)  # in characters
        opens[doc] = True
        text_start = opens.copy()
        opens[1:n] |= cls[1:] != cls[:-1]
        # The last of a run of white space before something else, in the same text, stands apart.
        last = np.flatnonzero((cls[:-1] == _SPACE) & (cls[1:] != _SPACE) & ~text_start[1:n])
        opens[last] = True
        blank = last[cp[last] == 32]
        opens[blank + 1] = False
        # Contractions: an apostrophe that opens a piece.
        apo = np.flatnonzero((cp == 39) & opens[:n])
        apo = apo[apo + 1 < n]
        apo = apo[~text_start[apo + 1]]
        if len(apo):
            c1 = cp[apo + 1]
            two = np.isin(c1, [ord(c) for c in "stmd"])
            nxt = np.minimum(apo + 2, n - 1)
            more = (apo + 2 < n) & ~text_start[nxt]
            c2 = cp[nxt]
            three = more & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
            opens[apo[two] + 1] = text_start[apo[two] + 1]
            opens[apo[two] + 2] = True
            opens[apo[three] + 1] = False
            opens[apo[three] + 3] = True
        opens[n] = False
        chars = np.flatnonzero(opens[:n])
        starts = at[chars]
        return np.append(starts, len(data)), np.searchsorted(starts, offsets)

    def _merge(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """rows (n x L byte values, `size` of them in each row) to (ids one row after another, number of each)."""
        n, width = rows.shape
        pad = width - size  # a row merges one pair a round and gets narrower with the matrix, so its padding stays
        ids = np.where(np.arange(width) < size[:, None], self.byte_ids[rows], _PAD)
        out, length = np.zeros((n, width), np.int32), size.copy()
        alive = np.arange(n)
        key = lambda a, b: ((a.astype(np.int64) << 32) | b.astype(np.int64)).astype(U) + U(1)
        rank = self.pairs.get(key(ids[:, :-1].ravel(), ids[:, 1:].ravel())).reshape(n, width - 1) if width > 1 else np.full((n, 0), _NONE)
        while len(alive):
            w = ids.shape[1]
            if w == 1:
                out[alive, :1] = ids
                length[alive] = 1
                break
            j = rank.argmin(axis=1)
            r = np.arange(len(j))
            best = rank[r, j]
            done = best == _NONE
            if done.any():
                out[alive[done], :w] = ids[done]
                length[alive[done]] = w - pad[alive[done]]
                alive, ids, rank, j, best = (x[~done] for x in (alive, ids, rank, j, best))
                if not len(alive):
                    break
                r = np.arange(len(j))
            # Every row merges one pair, so all stay equally wide.
            take = np.arange(w - 1)
            take = take + (take > j[:, None])
            ids = np.take_along_axis(ids, take, axis=1)
            ids[r, j] = best
            take = np.arange(w - 2)
            take = take + (take >= j[:, None])
            rank = np.take_along_axis(rank, np.minimum(take, w - 2), axis=1)
            left, right = j > 0, j < w - 2
            rank[r[left], j[left] - 1] = self.pairs.get(key(ids[r[left], j[left] - 1], best[left]))
            rank[r[right], j[right]] = self.pairs.get(key(best[right], ids[r[right], j[right] + 1]))
        keep = np.arange(width) < length[:, None]
        return out[keep], length

    def _merge_long(self, row: np.ndarray) -> np.ndarray:
        """The ids of one row of byte values; pairs leave a heap by rank and place."""
        ids = self.byte_ids[row]
        rank = self.pairs.get(((ids[:-1].astype(np.int64) << 32) | ids[1:].astype(np.int64)).astype(U) + U(1))
        at = np.flatnonzero(rank != _NONE)
        heap = ((rank[at].astype(np.int64) << 32) | at).tolist()
        heapq.heapify(heap)
        n = len(ids)
        ids, rank = ids.tolist(), rank.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank.append(int(_NONE))
        rank_of, none, place = self.rank_of, int(_NONE), (1 << 32) - 1
        push, pop = heapq.heappush, heapq.heappop
        while heap:
            x = pop(heap)
            i, r = x & place, x >> 32
            if rank[i] != r:
                continue  # merged or changed since
            j = after[i]
            ids[i], ids[j], rank[j] = r, -1, none
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank[i] = new = rank_of.get(r << 32 | ids[k], none)
                if new != none:
                    push(heap, new << 32 | i)
            else:
                rank[i] = none
            h = before[i]
            if h >= 0:
                rank[h] = new = rank_of.get(ids[h] << 32 | r, none)
                if new != none:
                    push(heap, new << 32 | h)
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, check: np.ndarray) -> None:
        size = ends - starts
        for g in np.flatnonzero(size > WIDEST).tolist():
            ids = self._merge_long(data[starts[g] : ends[g]])
            if len(ids) > 1 and size[g] <= self.token_len.max() and (t := self.whole.get(data[starts[g] : ends[g]].tobytes())) is not None:
                ids = np.array([t], dtype=np.int32)
            self._store(hashes[g : g + 1], check[g : g + 1], ids, np.array([len(ids)]))
        short = np.flatnonzero(size <= WIDEST)
        widths = np.minimum(BUCKETS[np.minimum(np.searchsorted(BUCKETS, size[short]), len(BUCKETS) - 1)], WIDEST)
        widths = np.maximum(widths, size[short])
        for width in np.unique(widths).tolist():
            group = short[widths == width]
            step = max(1, (1 << 21) // max(1, width))
            for i in range(0, len(group), step):
                g = group[i : i + step]
                rows = data[np.minimum(starts[g][:, None] + np.arange(width), len(data) - 1)]
                ids, n = self._merge(rows, size[g])
                # A piece that is itself a token is that token, even where merging would end elsewhere.
                if self.whole and (many := np.flatnonzero((n > 1) & (size[g] <= self.token_len.max()))).size:
                    at = np.concatenate([[0], np.cumsum(n)])
                    keep = np.ones(len(ids), dtype=bool)
                    for k in many:
                        if (t := self.whole.get(rows[k, : size[g[k]]].tobytes())) is not None:
                            ids[at[k]] = t
                            keep[at[k] + 1 : at[k + 1]] = False
                            n[k] = 1
                    ids = ids[keep]
                self._store(hashes[g], check[g], ids, n)

    def _store(self, hashes: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        a, b = self.n_known, self.n_known + len(hashes)
        while b > len(self.at):
            self.at, self.n, self.check = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.check))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.at[a:b] = self.used + np.concatenate([[0], np.cumsum(n)[:-1]])
        self.n[a:b], self.check[a:b] = n, check
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.put(hashes, np.arange(a, b, dtype=np.int32))
        self.n_known = b

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, end, id) of the added tokens in each text, leftmost first."""
        raw = data.tobytes()
        if not any(t in raw for t in self.added):
            return []
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            out += [(a + m.start(), a + m.end(), self.added[m.group()]) for m in self.cuts.finditer(raw[a:b])]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (n + 1)."""
        found = self._added(data, offsets) if self.added else []
        if not found:
            return self._encode(data, offsets)
        # What is between added tokens is encoded as texts of its own, each added token as an empty one and its id.
        start, end, own = (np.array(x, dtype=np.int64) for x in zip(*found))
        cut = np.ones(len(data), dtype=bool)
        for a, b in zip(start.tolist(), end.tolist()):
            cut[a:b] = False
        upto = np.concatenate([[0], np.cumsum(cut)])
        edges = np.concatenate([offsets, start, end])
        # Of equal places a text's end comes first, so that an added token belongs to the text it is in.
        kind = np.concatenate([np.zeros(len(offsets), np.int64), np.full(len(start), 1), np.full(len(end), 2)])
        order = np.lexsort((np.where(kind == 2, 0, kind + 1), edges))
        ids, at = self._encode(data[cut], upto[edges[order]])
        place = np.empty(len(edges), np.int64)
        place[order] = np.arange(len(edges))
        where = at[place[len(offsets) : len(offsets) + len(start)]]
        ids = np.insert(ids, where, own)
        text_at = at[place[: len(offsets)]]
        in_text = np.searchsorted(start, offsets, side="left")
        return ids, text_at + in_text

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds, first = self.pieces(data, offsets)
        starts, ends = bounds[:-1], bounds[1:]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        h = _text.span_hashes(data, starts, ends)
        check = _text.span_hashes(data, starts, ends, second=True)
        h = np.maximum(h, U(1))
        while True:
            at = self.known.get(h)
            new = np.flatnonzero(at == _NONE)
            if len(new):
                _, one = np.unique(h[new], return_index=True)
                if self.n_known + len(one) > MAX_PIECES:
                    self.forget()
                    _, one = np.unique(h, return_index=True)
                    new = np.arange(len(h))
                one = new[one]
                self._learn(data, starts[one], ends[one], h[one], check[one])
                at = self.known.get(h)
            odd = np.flatnonzero(self.check[at] != check)
            if not len(odd):
                break
            h[odd] = np.maximum(_text.mix(h[odd] ^ check[odd]), U(1))  # another piece has this hash: go by both
        n = self.n[at]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.at[at] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, upto[first]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        n = self.token_len[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.token_bytes[np.repeat(self.token_at[ids] - upto[:-1], n) + np.arange(upto[-1])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_texts(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array<int>): the ids of each text."""
    schema = "doc_id long, ids array<int>"

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            for lo, data, offsets in _text.chunks(b.column(1)):
                ids, at = e.encode(data, offsets)
                yield pa.record_batch([b.column(0).slice(lo, len(at) - 1), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text: encoded (doc_id, ids) back to text."""

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            texts = [None if x is None else e.decode(np.asarray(x, dtype=np.int64)).tobytes().decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 without shipping the ids."""

    def run(batches):
        e = encoder(vocabulary)
        for b in batches:
            for lo, data, offsets in _text.chunks(b.column(1)):
                ids, at = e.encode(data, offsets)
                back = e.decode(ids)
                back_at = np.concatenate([[0], np.cumsum(e.token_len[ids])])[at]
                raw, text = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                a, z = at.tolist(), back_at.tolist()
                one = [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(a, a[1:])]
                two = [hashlib.sha256(text[x:y]).hexdigest() for x, y in zip(z, z[1:])]
                yield pa.record_batch([b.column(0).slice(lo, len(one)), pa.array(np.diff(at)), pa.array(one), pa.array(two)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return x.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
