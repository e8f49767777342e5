"""Word and window hashes of Arrow string columns in numpy, a bounded chunk of bytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21
_BLOCK = 1 << 20
#: Keys of the two hashes of span_hashes: what a word of 8 bytes, its place and a span's length are scrambled with.
_KEYS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
#: The lowest k bytes of a word.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def chunks(column: pa.Array | pa.ChunkedArray):
    """(first row, bytes, offsets) of runs of rows, about CHUNK_BYTES each; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        # The bytes under a null are unspecified, so they are cut out.
        column = column.fill_null("")
        yield from chunks(column)
        return
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + CHUNK_BYTES, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap.

    Each word of 8 bytes is scrambled together with its place in the span, without which sums of scrambled words would not
    tell orders apart; their sum is scrambled with the length. second: a hash of other keys from the bytes up, so that
    the two make 128 bits.
    """
    word, place, length = (U(k) for k in _KEYS[second])
    out = np.empty(len(starts), dtype=U)
    i, n = 0, len(starts)
    while i < n:
        j = max(int(np.searchsorted(ends, starts[i] + _BLOCK, side="right")), i + 1)
        a, z = int(starts[i]), int(ends[j - 1])
        words = np.ndarray((z - a + 1,), dtype="<u8", buffer=np.concatenate([data[a:z], np.zeros(8, np.uint8)]), strides=(1,))
        s, size = starts[i:j] - a, ends[i:j] - starts[i:j]
        k = np.maximum((size + 7) >> 3, 1)
        first = np.cumsum(k) - k
        no = np.arange(int(k.sum())) - np.repeat(first, k)
        x = words[np.repeat(s, k) + 8 * no] & _LOWEST[np.minimum(np.repeat(size, k) - 8 * no, 8)]
        x = mix((x ^ word) + no.astype(U) * place)
        out[i:j] = mix(np.add.reduceat(x, first) + size.astype(U) * length)
        i = j
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, for each text, the number of its first word (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = blank[data]
    s = ~space
    e = s.copy()
    s[1:] &= space[:-1]
    e[:-1] &= space[1:]
    at = offsets[:-1][np.diff(offsets) > 0]
    s[at] = ~space[at]
    at = offsets[1:][np.diff(offsets) > 0] - 1
    e[at] = ~space[at]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, blank: np.ndarray = _SPACE):
    """(hash, start, end of each word; first word of each text)."""
    starts, ends, first = word_bounds(data, offsets, blank)
    return span_hashes(_LOWER[data] if lower else data, starts, ends), starts, ends, first


def double(h: np.ndarray, k: int, to: int) -> np.ndarray:
    """Hashes of windows of `to` words from those of k words, k < to <= 2 k: two windows that overlap or meet."""
    return mix(h[: len(h) - (to - k)] * U(0xD6E8FEB86659FD93) + h[to - k :])


def valid_windows(first: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the words at which a window of k words of one text starts."""
    n = np.diff(first)
    left = np.repeat(first[1:], n)
    at = np.arange(first[0], first[-1])
    return at[at + k <= left]
