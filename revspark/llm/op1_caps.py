"""Embedding near-duplicates by spherical-cap filters.

Filter directions are a structured random product code: vectors are rotated at random and cut into
``PARTS`` parts with ``t`` random unit codewords each; a filter is one codeword per part, so there are ``t **
PARTS`` directions. Each vector is list-decoded to all filters whose inner product exceeds a threshold:
sums over the first and the second half of the parts are pruned by the best possible other half, so
the product is never listed. Vectors meet on filters and are verified by cosine in double precision.

``t`` grows with the number of distinct vectors so that unrelated vectors rarely share a filter. The
threshold is fitted on at most ``FIT_ROWS`` vectors to give ``PER_VECTOR`` filters each on average. One code misses more partners the greater
``t`` is, so codes are added, each with a rotation of its own, until the measured share of synthetic partners just above the least cosine
that meet on a filter is ``HIT_RATE``. The threshold is lowered for a vector that would have fewer than ``LEAST`` filters. Equal vectors are one node. A filter's members are dealt into blocks;
pairs of blocks are tasks, and a pair of vectors is counted only at the least filter they share, so
links are counted without a list of all pairs.

Cases: null, empty or zero vectors and ones with null or non-finite components link with nothing and are
components of their own; vectors of different lengths never link; repeated rows are vectors of their
own; a null vec_id takes part but names no component and is never kept; extra columns are ignored.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, bounds, table, whole_groups
from .graph import components

THRESHOLD = 0.95
PARTS = 4                # parts of a vector, an even number
PER_VECTOR = 16         # filters of a vector above the threshold, on average
LEAST = 16               # every vector gets so many best filters at least
SPARE = 16               # filters per vector-filter incidence
FIT_ROWS = 1000
HIT_RATE = 0.995         # share of synthetic partners that must meet on a filter
MOST_CODES = 32          # rotations at which the fit gives up
SUMS = 1 << 23           # codeword sums held at once
BLOCK = 512
SEED = 29


class Caps:
    """The filter directions for vectors of one length."""

    def __init__(self, dim: int, n_vectors: int):
        rng = np.random.default_rng([SEED, dim])
        self.width = -(-dim // PARTS)
        self.dim = dim
        self.rotations = [self._rotation(0)]
        self.t = max(2, math.ceil((SPARE * PER_VECTOR * max(n_vectors, 1)) ** (1 / PARTS)))
        words = rng.standard_normal((PARTS, self.t, self.width))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True)
        self.threshold = 0.0

    def _rotation(self, r: int) -> np.ndarray:
        side = self.width * PARTS
        return np.linalg.qr(np.random.default_rng([SEED, self.dim, 2, r]).standard_normal((side, side)))[0][:self.dim]

    def halves(self, x: np.ndarray, r: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with all codeword tuples of each half of the parts, under rotation ``r``."""
        y = (x @ self.rotations[r]).reshape(len(x), PARTS, self.width)
        out = []
        for half in (range(PARTS // 2), range(PARTS // 2, PARTS)):
            s = np.zeros((len(x), 1))
            for p in half:
                s = (s[:, :, None] + (y[:, p] @ self.words[p].T)[:, None, :]).reshape(len(x), -1)
            out.append(s)
        return out[0], out[1]

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Sorted ids of the filters that each unit vector exceeds."""
        out, step, size = [], self.step(), self.t ** PARTS
        for k in range(0, len(x), step):
            codes = [[self._above(a, b) + r * size for a, b in zip(*self.halves(x[k:k + step], r))] for r in range(len(self.rotations))]
            out += [np.concatenate(found) for found in zip(*codes)]
        return out

    def step(self) -> int:
        """Vectors decoded at once, so that memory doesn't grow with ``t``."""
        return max(1, SUMS // self.t ** (PARTS // 2))

    def _above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cut = min(self.threshold, self._nth_best(a, b))
        i = np.flatnonzero(a >= cut - b.max())
        j = np.flatnonzero(b >= cut - a.max())
        p, q = np.nonzero(a[i][:, None] + b[j][None, :] >= cut)
        return np.sort(i[p] * len(b) + j[q])

    def _nth_best(self, a: np.ndarray, b: np.ndarray) -> float:
        """The ``LEAST``-th greatest sum: it lies among the greatest of each half."""
        k = min(LEAST, len(a), len(b))
        s = (np.partition(a, -k)[-k:, None] + np.partition(b, -k)[None, -k:]).ravel()
        return float(np.partition(s, -k)[-k])

    def fit(self, x: np.ndarray, cosine: float = THRESHOLD) -> None:
        """Threshold that gives ``PER_VECTOR`` filters of a code on average over a sample, and codes until partners at ``cosine`` meet."""
        self._aim(x, PER_VECTOR)
        rng = np.random.default_rng([SEED, self.dim, 1])
        y = rng.standard_normal(x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        c = min(cosine + 0.0005, 1.0)
        y = c * x + math.sqrt(1 - c * c) * y
        missed = np.arange(len(x))
        while True:
            r = len(self.rotations) - 1
            found = [len(np.intersect1d(self._above(a, b), self._above(d, e), assume_unique=True)) > 0 for k in range(0, len(missed), self.step())
                     for a, b, d, e in zip(*self.halves(x[missed[k:k + self.step()]], r), *self.halves(y[missed[k:k + self.step()]], r))]
            missed = missed[~np.array(found, bool)]
            if len(missed) <= (1 - HIT_RATE) * len(x) or len(self.rotations) == MOST_CODES:
                return
            self.rotations.append(self._rotation(r + 1))

    def hit_rate(self, x: np.ndarray, y: np.ndarray) -> float:
        """Share of the pairs (row of x, row of y) that have a filter in common."""
        hits = sum(len(np.intersect1d(a, b, assume_unique=True)) > 0 for a, b in zip(self.decode(x), self.decode(y)))
        return hits / max(len(x), 1)

    def _aim(self, x: np.ndarray, aim: float) -> None:
        """Threshold that gives ``aim`` filters on average."""
        low, high = 0.0, 2.0
        for _ in range(12):
            self.threshold = (low + high) / 2
            if self._count(x, aim) > aim * len(x):
                low = self.threshold
            else:
                high = self.threshold
        self.threshold = high

    def _count(self, x: np.ndarray, aim: float) -> int:
        """Number of filters above the threshold; stops once it is well over the aim."""
        n, step = 0, min(64, self.step())
        for k in range(0, len(x), step):
            for a, b in zip(*self.halves(x[k:k + step])):
                b = np.sort(b[b >= self.threshold - a.max()])
                n += int((len(b) - np.searchsorted(b, self.threshold - a[a >= self.threshold - b[-1]])).sum()) if len(b) else 0
            if n > 2 * aim * len(x):
                break
        return n


def _unit(col: pa.Array, dim: int) -> np.ndarray:
    return _scaled(col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; by their greatest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(caps):
    def run(batches):
        by_dim = caps.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                node = part.column("node").to_numpy()
                x = _unit(part.column("embedding"), dim)
                for k in range(0, len(x), 128):
                    found = by_dim[dim].decode(x[k:k + 128])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found)), pa.array(np.repeat(node[k:k + 128], [len(f) for f in found])),
                         pa.array(np.full(sum(map(len, found)), dim), pa.int32())], names=["filter", "node", "dim"])
    return run


def _merge(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index reachable over the pairs (i, j)."""
    lab = np.arange(n)
    while True:
        new = lab.copy()
        np.minimum.at(new, i, lab[j])
        np.minimum.at(new, j, lab[i])
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _shared_before(lists: list[np.ndarray], here: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the pairs (i, j) share a filter below ``here``."""
    lower = [x[x < here] for x in lists]
    every, n = np.unique(np.concatenate(lower), return_counts=True)
    common = every[n > 1]
    if not len(common):
        return np.zeros(len(i), bool)
    m = np.zeros((len(lists), len(common)), np.float32)
    for k, x in enumerate(lower):
        m[k, np.searchsorted(common, np.intersect1d(x, common, assume_unique=True))] = 1
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 8192):
        out[k:k + 8192] = np.einsum("ab,ab->a", m[i[k:k + 8192]], m[j[k:k + 8192]]) > 0
    return out


def _verify(threshold: float):
    """Rows (dim, filter, a, b, side, node, mult, embedding, filters) sorted by dim, filter, a, b -> rows
    (node, n_links, dst): partial numbers of links, and edges that connect what is linked here."""
    keys = ["dim", "filter", "a", "b"]

    def run(batches):
        for tab in whole_groups(batches, keys, 4000):
            cut = bounds(tab, keys)
            node, mult, side, filt = (tab.column(c).to_numpy() for c in ("node", "mult", "side", "filter"))
            dims, lists = tab.column("dim").to_numpy(), tab.column("filters")
            emb = tab.column("embedding").combine_chunks()
            emb = emb.chunk(0) if isinstance(emb, pa.ChunkedArray) else emb
            counts: dict[int, int] = {}
            edges = set()
            for p, q in zip(cut[:-1], cut[1:]):
                left, right = np.flatnonzero(side[p:q] == 0), np.flatnonzero(side[p:q] == 1)
                if q - p < 2 or not len(left):
                    continue
                x = _unit(emb.slice(p, q - p), int(dims[p]))
                if len(right):
                    i, j = np.nonzero(x[left] @ x[right].T >= threshold)
                    i, j = left[i], right[j]
                else:
                    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
                if not len(i):
                    continue
                lab = _merge(q - p, i, j)
                edges.update((int(node[p + k]), int(node[p + lab[k]])) for k in np.flatnonzero(lab != np.arange(q - p)))
                members = np.unique(np.concatenate([i, j]))
                at = np.zeros(q - p, np.int64)
                at[members] = np.arange(len(members))
                mine = [np.asarray(lists[int(p + k)].values) for k in members]
                first = ~_shared_before(mine, int(filt[p]), at[i], at[j])
                for u, v in ((i[first], j[first]), (j[first], i[first])):
                    w = np.bincount(u, mult[p + v], minlength=q - p)
                    for k in np.flatnonzero(w):
                        name = int(node[p + k])
                        counts[name] = counts.get(name, 0) + int(w[k])
            out = [(k, v, None) for k, v in counts.items()] + [(a, 0, b) for a, b in edges]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                                  pa.array([r[2] for r in out], pa.int64())], names=["node", "n_links", "dst"])
    return run


def cap_links(vectors: DataFrame, stage: Stage, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept, one row per row."""
    sc = vectors.sparkSession.sparkContext
    v = F.col("embedding")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))   # NaN is above all
    sound = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding").withColumn("node", F.when(sound, F.xxhash64(v)))
    nodes = stage.save(rows.filter("node is not null").groupBy("node").agg(
        F.any_value("embedding").alias("embedding"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("embedding")), "vectors")
    caps = {}
    for r in nodes.groupBy("dim").count().collect():             # one row per vector length
        caps[r.dim] = Caps(r.dim, r["count"])
        sample = nodes.filter(F.col("dim") == r.dim).orderBy("node").limit(FIT_ROWS).select("embedding").collect()
        caps[r.dim].fit(_scaled(np.array([s.embedding for s in sample], float)), threshold)
    handle = sc.broadcast(caps)
    hits = stage.save(nodes.select("node", "dim", "embedding").mapInArrow(_decode(handle), "filter long, node long, dim int"), "filters")
    live = (hits.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select("dim", "filter", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    met = stage.save(hits.join(live, ["dim", "filter"]), "met")
    payload = nodes.select("node", "mult", "embedding").join(
        met.groupBy("node").agg(F.collect_list("filter").alias("filters")), "node")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.when(o < mine, pair(o, mine, 1)).otherwise(pair(mine, o, 0)))
    order = ["dim", "filter", "a", "b"]
    tasks = (met.select("dim", "filter", "node", F.inline(to)).join(payload, "node")
             .select(*order, "side", "node", "mult", "embedding", "filters")
             .repartition(*order).sortWithinPartitions(*order))
    found = stage.save(tasks.mapInArrow(_verify(threshold), "node long, n_links long, dst long"), "links")
    edges = found.filter("dst is not null").select(F.col("node").alias("src"), "dst")
    comp = components(edges, stage)
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    known = stage.save(nodes.select("node", "mult", "least").join(links, "node", "left").join(comp, "node", "left").select(
        "node", "least", (F.col("mult") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("comp", "node").alias("comp")), "nodes")
    names = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    known = known.join(names, "comp").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_links(table(spark, sf_dir, "embeddings"), Stage(spark, "op1"))
