"""BPE against tiktoken, packing against tokenizers and the packing's own rules."""

import base64
import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from conftest import SF
from ticketloom.llm import _text, bpe, packing, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(x): int(b) for x, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_strings(library):
    random.seed(0)
    e = bpe.Encoder(RANKS)
    letters = list("  \n\t'''sstmdlrevL09.!é中😀 　\r\x1c²Ⅷ")
    texts = ["".join(random.choices(letters, k=random.randint(0, 25))) for _ in range(5000)] + [None, "", "'s", "'", "it's 're 'll've", "a" * 3000, "<|endoftext|>"]
    for lo, data, offsets in _text.chunks(pa.array(texts)):
        ids, at = e.encode(data, offsets)
        for k in range(len(at) - 1):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(texts[lo + k] or "")


def pieces_of_json(texts):
    e = bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for lo, data, offsets in _text.chunks(pa.array(texts)):
        ids, at = e.encode(data, offsets)
        for k in range(len(at) - 1):
            yield texts[lo + k], ids[at[k] : at[k + 1]].tolist(), e.decode(ids[at[k] : at[k + 1]]).tobytes()


@pytest.mark.parametrize("chunk", [1 << 21, 40])
def test_tokenizer_file(monkeypatch, chunk):
    """Ids of the tokenizer file, added tokens included: at the ends, in a row, by blanks, cut short, across texts."""
    monkeypatch.setattr(_text, "CHUNK_BYTES", chunk)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    random.seed(1)
    end = "<|endoftext|>"
    parts = [end, " ", "  ", "word", "é", "<|endof", "text|>", "'s", "\n", "<|", "endoftext|>", "12"]
    texts = [None, "", end, f"hello {end} world", end * 3, f"{end}a", f"a{end}", f" {end} ", "<|endof", "text|>", end[:-1], f"x{end}{end[:-1]}"]
    texts += ["".join(random.choices(parts, k=random.randint(0, 9))) for _ in range(3000)]
    for text, ids, back in pieces_of_json(texts):
        assert ids == t.encode(text or "", add_special_tokens=False).ids, text
        assert back == (text or "").encode()


def test_long_pieces(library, monkeypatch):
    """Pieces beyond a matrix: equal to the library's and to the matrix's own, in about linear time."""
    random.seed(2)
    texts = ["".join(random.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[:k], k=n)) for k, n in ((2, 700), (26, 5000), (52, 20000), (1, 999), (5, 513))]
    monkeypatch.setattr(bpe, "WIDEST", 40)
    texts += ["".join(random.choices("etaoins", k=random.randint(1, 90))) for _ in range(300)]
    e = bpe.Encoder(RANKS)
    for lo, data, offsets in _text.chunks(pa.array(texts)):
        ids, at = e.encode(data, offsets)
        for k in range(len(at) - 1):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(texts[lo + k])
    assert list(pieces_of_json(texts[:4])) == [(x, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(x, add_special_tokens=False).ids, x.encode()) for x in texts[:4]]
    began = time.perf_counter()
    data = np.frombuffer("".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=1 << 20)).encode(), dtype=np.uint8)
    ids, _ = e.encode(data, np.array([0, len(data)]))
    assert e.decode(ids).tobytes() == data.tobytes() and time.perf_counter() - began < 30


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PIECES", 50)
    monkeypatch.setattr(_text, "CHUNK_BYTES", 64)
    e = bpe.Encoder(RANKS)
    texts = [f"word{i} other{i * 7} more" for i in range(100)]
    for lo, data, offsets in _text.chunks(pa.array(texts)):
        ids, at = e.encode(data, offsets)
        for k in range(len(at) - 1):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(texts[lo + k])


def test_query_and_round_trip(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op5_byte_bpe(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = np.array(library.encode_ordinary(r.text or ""), dtype="<u4")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_encode_decode_tables(spark):
    x = spark.createDataFrame([(1, "héllo", "x"), (2, None, "y"), (2, "", "z"), (None, " a\n\n b", "w")], "doc_id long, text string, ids string")
    back = bpe.decode_ids(bpe.encode_texts(x, RANKS), RANKS).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == [(0, " a\n\n b"), (1, "héllo"), (2, ""), (2, "")]
    assert bpe.encode_texts(x.limit(0), RANKS).count() == 0


def check_packing(rows, texts, capacity=1024):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, own in by_doc.items():
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // capacity)
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or r.piece == 0
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n, tokens = check_packing(queries.op1_best_fit_packing(spark, SF).collect(), texts)
    assert n <= 1.02 * tokens / 1024 + 1


def test_packing_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "a", 5: "b " * 1023, 6: "c " * 1024}
    x = spark.createDataFrame([(k, v, 7) for k, v in texts.items()], "doc_id long, text string, length int").repartition(3)
    check_packing(packing.pack_documents(x, RANKS).collect(), texts)
    assert packing.pack_documents(x.limit(0), RANKS).count() == 0
    one = packing.pack_documents(x, RANKS).where("doc_id = 4").first()
    assert len(one.ids) == 4 * one.length
    twice = packing.pack_documents(x.unionByName(x), RANKS)
    assert twice.count() == 2 * packing.pack_documents(x, RANKS).count()


@pytest.mark.parametrize("seed", range(30))
def test_plan(seed):
    random.seed(seed)
    capacity = random.choice([10, 64, 1024])
    counts = {random.randint(1, capacity): random.randint(1, 50) for _ in range(random.randint(1, 60))}
    got, bins = dict.fromkeys(counts, 0), {}
    for length, lo, hi, sequence, offset, per in packing.plan_packing(counts, capacity):
        assert lo == got[length]
        got[length] = hi
        for r in range(hi - lo):
            bins.setdefault(sequence + r // per, []).append((offset + r % per * length, length))
    assert got == counts
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in own) <= 2
    least = -(-sum(k * v for k, v in counts.items()) // capacity)
    large = sum(v for k, v in counts.items() if 2 * k > capacity)
    assert len(bins) <= max(least, large) * 1.25 + 2


def thue_morse(n):
    """A word over a and b, and its complement: polynomial hashes modulo powers of two can't tell them apart."""
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096, 65536])
def test_structured_pieces(library, n):
    t, u = thue_morse(n)
    texts = [f"q{t}q", f"q{u}q", t, u, t + u, u + t]
    e = bpe.Encoder(RANKS)
    for _, data, offsets in _text.chunks(pa.array(texts)):
        ids, at = e.encode(data, offsets)
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode_ordinary(text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids, back in pieces_of_json(texts):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids and back == text.encode()


def test_pieces_of_one_hash(library, monkeypatch):
    """Pieces whose first hashes are all equal are still told apart."""
    whole = _text.span_hashes
    monkeypatch.setattr(_text, "span_hashes", lambda data, starts, ends, second=False: whole(data, starts, ends, second) if second else whole(data, starts, ends) % 7)
    texts = ["one two three, four five", "six seven", "one eight nine two", ""]
    e = bpe.Encoder(RANKS)
    for _ in range(2):
        for _, data, offsets in _text.chunks(pa.array(texts)):
            ids, at = e.encode(data, offsets)
            assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == [library.encode_ordinary(t) for t in texts]


def test_span_hashes():
    """Both hashes go by bytes, order and length alone, wherever a span lies."""
    words = ["a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "12345678abcdefgh", "abcdefgh12345678", "\0", "\0\0", *thue_morse(65536), "é" * 700000]
    for second in (False, True):
        seen = {}
        for order in (words, words[::-1]):
            data = np.frombuffer(" ".join(order).encode(), dtype=np.uint8)
            n = np.array([len(w.encode()) for w in order])
            ends = np.cumsum(n + 1) - 1
            for w, h in zip(order, _text.span_hashes(data, ends - n, ends, second).tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(words)
