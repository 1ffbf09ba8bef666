"""Quality rules: gradient-boosted trees over document statistics.

Statistics are taken by array arithmetic over whole texts. The trees are fitted by histogram boosting
(logistic loss) under monotonic constraints: a split on a constrained statistic must order its
children, and their values bound all below. The fitted forest is flattened into arrays of node
features, thresholds, children and values; scoring walks all rows of a batch down one level at a time.

Fitting takes at most ``FIT_ROWS`` labelled documents, chosen by a hash of doc_id; everything else reads
all rows. A document fails the base rules with fewer than 50 words or when over half of its words
lie in three-word windows found twice or more; else the forest decides.

Cases: null, empty and blank texts have no words and fail the base rules; without labelled rows the
forest keeps what the base rules keep; repeated rows are judged alike; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import one_text_each, table
from .kernel import Words, mix, slices, windows

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: statistics of the forest, and the direction in which quality may move with each (0: any)
FEATURES = {"log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_lines": -1, "repeats": -1, "digits": -1,
            "capitals": 0, "words_per_line": 0, "punctuation": 0, "distinct": 1}
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, MIN_LEAF, RIDGE = 60, 4, 48, 0.2, 10, 1.0
KEEP_AT = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_DIGIT, _CAPITAL, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[48:58], _CAPITAL[65:91] = True, True
_STOP[[ord(c) for c in ".,;:!?"]] = True


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (document, hash) pairs: order of sorting, and whether a sorted pair starts a new value."""
    key = mix(h + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
    order = np.argsort(key, kind="stable")
    k = key[order]
    return order, np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)


def statistics(col: pa.Array) -> dict[str, np.ndarray]:
    """Base counts (int64) and forest features of each text."""
    parts = [_slice_statistics(Words(col.slice(a, n))) for a, n in slices(col)]
    if not parts:
        return {k: np.zeros(0) for k in [*BASE, *FEATURES]}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _slice_statistics(w: Words) -> dict[str, np.ndarray]:
    n = w.n_docs
    h, words = w.hashes(), w.n_words()
    out = {"n_words": words, "word_chars": w.per_doc(w.is_word & ((w.bytes & 0xC0) != 0x80)), "n_symbols": w.per_doc(_SYMBOL[w.bytes])}
    # lines: ranges between line feeds inside a document
    feeds = np.flatnonzero(w.bytes == 10)
    starts = np.concatenate([w.off[:-1], feeds + 1])
    ends = np.concatenate([feeds, w.off[1:]])
    starts.sort()
    ends.sort()
    line_doc = np.repeat(np.arange(n), 1 + w.per_doc(w.bytes == 10))
    has = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends, line_doc = starts[has], ends[has], line_doc[has]
    lines = np.bincount(line_doc, minlength=n)
    order, new = _distinct(line_doc, w.hash(starts, ends))
    out["n_dup_lines"] = lines - np.bincount(line_doc[order][new], minlength=n)
    # words in three-word windows found again in the text
    win, at = windows(h, w.doc, 3)
    order, new = _distinct(w.doc[at], win)
    group = np.cumsum(new) - 1
    again = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    covered = np.zeros(len(h), bool)
    first = at[order[again]]
    for k in range(3):
        covered[first + k] = True
    out["n_repeat_words"] = np.bincount(w.doc[covered], minlength=n)
    order, new = _distinct(w.doc, h)
    chars, per = np.maximum(out["word_chars"], 1), np.maximum(words, 1)
    out |= {"log_words": np.log2(per), "word_length": out["word_chars"] / per, "symbols_per_word": out["n_symbols"] / per,
            "dup_lines": out["n_dup_lines"] / np.maximum(lines, 1), "repeats": out["n_repeat_words"] / per,
            "digits": w.per_doc(_DIGIT[w.bytes]) / chars, "capitals": w.per_doc(_CAPITAL[w.bytes]) / chars,
            "words_per_line": per / np.maximum(lines, 1), "punctuation": w.per_doc(_STOP[w.bytes]) / per,
            "distinct": np.bincount(w.doc[order][new], minlength=n) / per}
    return {k: v.astype(np.int64) if k in BASE else v.astype(float) for k, v in out.items()}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


class Forest:
    """Flat node arrays of all trees: a leaf has feature -1."""

    def __init__(self, bias: float):
        self.bias, self.roots = bias, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def add(self) -> int:
        for a, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            a.append(v)
        return len(self.feature) - 1

    def arrays(self):
        return (self.bias, np.array(self.roots, np.int64), np.array(self.feature, np.int64), np.array(self.threshold),
                np.array(self.left, np.int64), np.array(self.right, np.int64), np.array(self.value))


def predict(forest: tuple, x: np.ndarray) -> np.ndarray:
    """Probability of good quality of each row of ``x``."""
    bias, roots, feature, threshold, left, right, value = forest
    out = np.full(len(x), bias)
    rows = np.arange(len(x))
    for r in roots:
        node = np.full(len(x), r)
        while True:
            f = feature[node]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            at = node[inner]
            low = x[rows[inner], f[inner]] <= threshold[at]
            node[inner] = np.where(low, left[at], right[at])
        out += value[node]
    return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, direction: np.ndarray) -> tuple:
    """Boosted trees for 0/1 ``y`` under monotonic ``direction`` per column."""
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.999
    forest = Forest(float(np.log(rate / (1 - rate))))
    if len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return forest.arrays()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), forest.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = forest.add()
        forest.roots.append(root)
        _grow(forest, root, np.arange(len(y)), binned, edges, g, h, direction, 0, -np.inf, np.inf, margin)
    return forest.arrays()


def _grow(forest, node, rows, binned, edges, g, h, direction, depth, low, high, margin):
    """Split a node or make it a leaf with a value inside [low, high]."""
    gs, hs = g[rows].sum(), h[rows].sum()
    best = None
    if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b, m = binned[rows, j], len(e) + 1
            gl, hl, nl = (np.cumsum(np.bincount(b, v, minlength=m))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
            vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip((gs - gl) / (hs - hl + RIDGE), low, high)
            gain = gl * vl - 0.5 * (hl + RIDGE) * vl ** 2 + (gs - gl) * vr - 0.5 * (hs - hl + RIDGE) * vr ** 2
            ok = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF)
            if direction[j]:
                ok &= direction[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -np.inf)
            k = int(gain.argmax())
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0]):
                best = (gain[k], j, k, float(vl[k]), float(vr[k]))
    value = float(np.clip(gs / (hs + RIDGE), low, high))
    if best is None or best[0] <= gs * value - 0.5 * (hs + RIDGE) * value ** 2 + 1e-6:
        forest.value[node] = RATE * value
        margin[rows] += RATE * value
        return
    _, j, k, vl, vr = best
    forest.feature[node], forest.threshold[node] = j, float(edges[j][k])
    side = binned[rows, j] <= k
    middle = (vl + vr) / 2
    for go_left, part in ((True, rows[side]), (False, rows[~side])):
        child = forest.add()
        (forest.left if go_left else forest.right)[node] = child
        lo, hi = low, high
        if direction[j]:
            if (direction[j] > 0) == go_left:
                hi = min(hi, middle)
            else:
                lo = max(lo, middle)
        _grow(forest, child, part, binned, edges, g, h, direction, depth + 1, lo, hi, margin)


def train(docs: DataFrame, labels: DataFrame) -> tuple:
    pick = (labels.filter("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
            .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(FIT_ROWS))

    def run(batches):
        for b in batches:
            s = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(base_failed(s)),
                                              *(pa.array(s[k]) for k in FEATURES)], names=["doc_id", "quality", "failed", *FEATURES])
    found = one_text_each(docs, pick, ["quality"])
    rows = found.mapInArrow(run, "doc_id long, quality int, failed boolean, " + ", ".join(f"{k} double" for k in FEATURES)).toPandas()
    rows = rows[~rows.failed].sort_values(["doc_id", *FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(float), rows.quality.to_numpy(float), np.array(list(FEATURES.values())))


def _verdict(s: dict[str, np.ndarray], forest: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, probability of good quality, kept."""
    failed = base_failed(s)
    p = predict(forest, np.stack([s[k] for k in FEATURES], axis=1))
    return failed, p, ~failed & (p >= KEEP_AT)


def judge(docs: DataFrame, forest: tuple) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base counts, base_failed, probability, kept."""
    handle = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            s = statistics(b.column("text"))
            failed, p, kept = _verdict(s, handle.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[k], pa.int64()) for k in BASE), pa.array(failed),
                                              pa.array(p), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "probability", "kept"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, probability double, kept boolean")


def good_only(docs: DataFrame, forest: tuple) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    handle = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_verdict(statistics(b.column("text")), handle.value)[2]))
    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    return judge(docs, train(docs, table(spark, sf_dir, "labels")))
