"""Vectorised tokenising and hashing of Arrow string columns.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``. Every byte range has a 64-bit polynomial
hash from one prefix sum (odd base modulo 2^64, a random value per byte), so words, word
prefixes and windows are hashed by array arithmetic, without a Python loop over words.
Whole texts are read; long columns are walked in slices of about ``SLICE_BYTES``."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (uint64 in and out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~_SPACE
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS.get("n", 0) < n:
        size = max(n, 2 * SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size + 1, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.cumprod(p, dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def slices(col: pa.Array, size: int = SLICE_BYTES):
    """(first row, number of rows) of slices of about ``size`` bytes, one row at least."""
    off = offsets(col)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, j - i
        i = j


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string column's rows (null rows are empty)."""
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    return np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64) \
        if len(col) else np.zeros(1, np.int64)


class Words:
    """The words of a slice of texts, with hashes of arbitrary byte ranges."""

    def __init__(self, col: pa.Array, fold: bool = False):
        if pa.types.is_large_string(col.type):
            col = col.cast(pa.string())
        off = offsets(col)
        data = col.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.bytes = raw[off[0]:off[-1]]
        self.off = off - off[0]
        self.n_docs = len(col)
        n = len(self.bytes)
        self.is_word = WORD_BYTE[self.bytes]
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = self.is_word[:-1]
        edge = self.off[:-1][self.off[:-1] < n]
        before[edge] = False
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = self.is_word[1:]
        after[edge[edge > 0] - 1] = False
        self.start = np.flatnonzero(self.is_word & ~before)
        self.end = np.flatnonzero(self.is_word & ~after) + 1
        self.doc = np.searchsorted(self.off[1:], self.start, "right")
        #: first word of each document, and the number of words
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        up, self._down = _powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_FOLDED if fold else _VALUE)[self.bytes] * up[:n], out=sums[1:])
        self._sums = sums

    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        return self.hash(self.start, self.end)

    def per_doc(self, byte_mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes in each document."""
        c = np.concatenate([[0], np.cumsum(byte_mask, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows inside one document, and their first word's index."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += mix(h[k:k + n] * np.uint64((2 * k + 1) * 0xC2B2AE3D27D4EB4F & _M | 1))
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    return mix(out[at]), at


def shingle_sets(words: Words, width: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct ``width``-word shingles (the whole sequence as one when
    the document has fewer words; empty without words), as 64-bit hashes."""
    h = words.hashes()
    win, at = windows(h, words.doc, width)
    cut = np.searchsorted(at, words.first)           # windows start at the document's words
    count = words.n_words()
    out = []
    for i in range(words.n_docs):
        if count[i] >= width:
            s = np.sort(win[cut[i]:cut[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif count[i]:
            a = words.first[i]
            x = np.zeros(1, np.uint64)
            for k in range(count[i]):
                x += mix(h[a + k:a + k + 1] * np.uint64((2 * k + 3) * 0xA0761D6478BD642F & _M | 1))
            out.append(mix(x + np.uint64(count[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
