"""Hashed text features shared by the classifiers: whole words and word prefixes."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

from .kernel import Words, mix, slices

PREFIXES = (4, 5, 6)           # bytes


def hashed(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs, distinct and sorted, of a slice's words folded to lower case
    (A-Z) and without ASCII punctuation around them, and of their longer words' prefixes."""
    start, end = _trim(words)
    doc = words.doc
    parts = [(doc, words.hash(start, end))]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        parts.append((doc[longer], mix(words.hash(start[longer], start[longer] + k) + np.uint64(k))))
    d = np.concatenate([p[0] for p in parts]).astype(np.uint64)
    f = np.concatenate([p[1] for p in parts]) & np.uint64((1 << bits) - 1)
    key = np.sort(d << np.uint64(bits) | f)
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(bits)).astype(np.int64), (key & np.uint64((1 << bits) - 1)).astype(np.int64)


_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _trim(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges without up to four bytes of ASCII punctuation at either end (one byte stays)."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        start += (end - start > 1) & _PUNCT[words.bytes[start]]
        end -= (end - start > 1) & _PUNCT[words.bytes[end - 1]]
    return start, end


def linear(col: pa.Array, weights: np.ndarray, bits: int, scale: bool = False) -> np.ndarray:
    """Sum of the weights of each text's distinct features; ``scale`` divides by their root number."""
    out = np.zeros(len(col))
    for a, n in slices(col):
        w = Words(col.slice(a, n), fold=True)
        d, f = hashed(w, bits)
        s = np.bincount(d, weights[f], minlength=n)
        out[a:a + n] = s / np.sqrt(np.maximum(np.bincount(d, minlength=n), 1)) if scale else s
    return out


def packed(batches, bits: int, extra: list[str]):
    """Arrow batches with a text column -> ``extra`` columns and the features as int32 bytes."""
    for b in batches:
        out = []
        col = b.column("text")
        for a, n in slices(col):
            d, f = hashed(Words(col.slice(a, n), fold=True), bits)
            cut = np.searchsorted(d, np.arange(n + 1))
            f = f.astype(np.int32)
            out += [f[cut[i]:cut[i + 1]].tobytes() for i in range(n)]
        yield pa.RecordBatch.from_arrays([*(b.column(e) for e in extra), pa.array(out, pa.binary())], names=[*extra, "features"])


class Rows:
    """Sparse 0/1 rows for fitting on the driver."""

    def __init__(self, packed_rows: list[bytes]):
        rows = [np.frombuffer(x, np.int32) for x in packed_rows]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)

    def counts(self, width: int) -> np.ndarray:
        return np.bincount(self.col, minlength=width)

    def keep(self, index: np.ndarray) -> None:
        """Renumber the columns; those with index -1 go."""
        c = index[self.col]
        ok = c >= 0
        self.row, self.col = self.row[ok], c[ok]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], minlength=width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return w - self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)
