"""Vectorised word and n-gram hashing over Arrow string batches.

A batch's UTF-8 bytes are read as one numpy array; words are maximal runs of
"word bytes" inside one document. A word's hash is a 64-bit polynomial over its
bytes, taken from one cumulative sum, then mixed; an n-gram's hash is a
polynomial over its words' hashes. Cost is a fixed number of passes over the
bytes, whatever the documents' lengths, and memory is bounded by `chunks`.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
CHUNK_BYTES = 1 << 19  # text taken at once; a longer document is one chunk of its own
_P, _Q = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93

#: `[^\x20\x09-\x0D]+`
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _byte_values(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[0x41:0x5B] += U(0x20)
    return mix((b + U(1)) * U(_P))


_VALUES = {x: _byte_values(x) for x in (False, True)}
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            a = np.full(size, U(p))
            a[0] = U(1)
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """The words of some documents: byte offsets, hashes, and each document's first word."""

    def __init__(self, texts: pa.Array, word_bytes: np.ndarray, lower: bool):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, off, data = texts.buffers()
        off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        base, end = int(off[0]), int(off[-1])
        self.bytes = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
        self.doc_bytes = off - base
        is_word = word_bytes[self.bytes]
        n = len(is_word)
        first = np.zeros(n + 1, bool)
        first[self.doc_bytes] = True
        begin, stop = is_word.copy(), is_word.copy()
        if n:
            begin[1:] &= ~is_word[:-1] | first[1:n]
            stop[:-1] &= ~is_word[1:] | first[1:n]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.doc_bytes)
        p, self._inverse = powers(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[lower][self.bytes] * p[:n], out=self._sum[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._inverse[start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        """The document of a word's index."""
        return np.searchsorted(self.first, word, side="right") - 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n-gram that starts at each word, and whether it fits its document."""
        return rolling(self.hash, n), fits(self.first, len(self.hash), n)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, at their first; shorter tails hold what is left."""
    out = h.copy()
    q = 1
    for j in range(1, min(n, len(h))):
        q = q * _Q % (1 << 64)
        out[:-j] += h[j:] * U(q)
    return mix(out + U(n))


def fits(first: np.ndarray, n_words: int, n: int) -> np.ndarray:
    ok = np.ones(n_words, bool)
    for j in range(1, n):
        at = first[1:] - j
        ok[at[at >= first[:-1]]] = False
    return ok


def sequence_hash(h: np.ndarray) -> np.uint64:
    """One hash for a whole sequence, equal to `rolling` with n = its length."""
    return rolling(h, len(h))[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes of text."""
    n = len(texts)
    if not n:
        return
    sizes = np.cumsum(np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(float)))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, side="right"))
        hi = max(hi, lo + 1)
        yield lo, hi
        lo = hi
    release()


def release() -> None:
    """Gives freed memory back to the system: idle Python workers stay for the next tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class HashSet:
    """Membership of many 64-bit values in a sorted table: a bit table first, then bisection."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values.astype(np.uint64))
        bits = max(12, min(24, int(np.ceil(np.log2(len(self.values) + 1))) + 5))
        self.mask = U((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.values & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are members, and their indexes in `values`."""
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(self.values) or not len(at):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[k] == h[at]
        return at[ok], k[ok]


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, at their first, from one cumulative sum: for long windows."""
    start = np.arange(len(h))
    return span_hash(h, start, np.minimum(start + n, len(h)), n)


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, n: int | None = None) -> np.ndarray:
    """Hashes of the entries from each start to its end; of n entries each, or of any number."""
    q, inverse = _word_powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * q[: len(h)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (U(n) if n is not None else (end - start).astype(np.uint64)))


_for_words: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _word_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_for_words[0]) < n:
        for k, q in enumerate((_Q, pow(_Q, -1, 1 << 64))):
            a = np.full(max(n, 1 << 19), U(q))
            a[0] = U(1)
            _for_words[k] = np.cumprod(a, dtype=np.uint64)
    return _for_words[0], _for_words[1]
