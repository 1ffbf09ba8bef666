"""Jaccard join of n-gram sets by signature trees.

Sets are a document's distinct word shingles; documents link when ``|A & B| / |A | B| >= threshold``.
Equal sets are one node (a 64-bit fingerprint), so copies are never paired.

Top level of the trees, as Spark aggregations: under a global order of shingles from rare to common,
two sets that link share a shingle among the first ``n - ceil(t * n) + 1`` of each, and one of the two
among its first ``n - ceil(2t / (1 + t) * n) + 1`` (prefix principle, ``t`` the threshold); so each such
shingle is a subtree, and no pair outside a common subtree can have enough overlap. Subtrees with
the same members are one.

Below, a subtree's members are dealt by a hash into blocks of bounded size, and pairs of blocks are
tasks: in each block the members' signatures (token bitmap, size), in order of size, form a tree
whose nodes hold the OR of their members' bitmaps and their size range; both trees are walked
together and a pair of nodes is pruned when the greatest overlap its bitmaps and sizes allow is
less than the least overlap a link needs. What remains is verified on the sets themselves.

First the trees only tell which sets have a partner left at all (within blocks, then the others across
blocks): the texts of these alone are read again. Only components matter, so pairs that are connected
already are skipped: first each set is searched in its largest subtree only, within blocks, each with
the subtree's least member, which merges groups of near copies without all their pairs; then all
subtrees that still hold several components are searched for all pairs that are apart: nothing is
lost. There the members of a subtree's largest component are in blocks of their own, which need not
meet each other. A pair of sets is taken up in the least of the subtrees that they share only. Where the trees leave a block at most
``FEW`` pairs per set, these are put out and verified by a join; a block with more (sets that are alike, but
below the threshold) gets the sets themselves, verifies in the task and merges as it goes, so it puts out fewer links than it has sets.

The order counts shingles over all documents in a hashed table of fixed size (``SKETCH`` counters;
collisions only change the order, never the result); its logarithms, ``SKETCH`` bytes, are the one
thing that is broadcast.

Cases: null, empty or blank texts have an empty set and link with nothing; texts with fewer words
than a shingle are one shingle; repeated rows and equal texts with several ids are one component;
a null doc_id takes part but names no component (a component without ids has a null id); extra
columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, bounds, table, unused, whole_groups
from .graph import components
from .kernel import Words, mix, shingle_sets, slices

WIDTH = 5
THRESHOLD = (80, 100)          # as a fraction of integers
SKETCH = 1 << 20               # counters of the shingle table
CHUNK = 1 << 12                # counters per row of its pieces
BLOCK = 256                    # members of a block of a subtree
FEW = 2                        # pairs per set that a block puts out
DENSE = 2000                   # pairs from which overlaps are counted by a matrix product
BITS = 4096                    # token bitmap
FAN_OUT = 8                    # children of a tree node


def _sets(col: pa.Array, width: int):
    """(first row, sets) of slices of a text column; words fold A-Z."""
    for a, n in slices(col):
        yield a, shingle_sets(Words(col.slice(a, n), fold=True), width)


def _fingerprint(s: np.ndarray) -> int:
    """64-bit fingerprint of a set, as a signed integer; 0 for the empty set."""
    if not len(s):
        return 0
    x = int(mix(mix(s * np.uint64(0x9FB21C651E98DF25)).sum(keepdims=True) + np.uint64(len(s)))[0]) or 1
    return x - (1 << 64) if x >> 63 else x


def _prefix(n: int, t: tuple) -> int:
    """Length of the prefix in which linked sets share a shingle."""
    return n - -(-t[0] * n // t[1]) + 1 if n else 0


def _short_prefix(n: int, t: tuple) -> int:
    """Length of the prefix in which the smaller of two linked sets shares a shingle."""
    return n - -(-2 * t[0] * n // (t[0] + t[1])) + 1 if n else 0


# --- nodes and the order of shingles ---------------------------------------------------------
NODE = "doc_id long, text_hash long, node long, n_shingles long, excess long, bits binary, piece int, counts binary"


def _nodes_and_counts(width: int):
    """A row for each document with its node and signature, and at a task's end its shingle counts by
    pieces of the table."""
    def run(batches):
        counts = np.zeros(SKETCH, np.uint32)
        for b in batches:
            sets = [s for _, part in _sets(b.column("text"), width) for s in part]
            for k in range(0, len(sets), 500):
                np.add(counts, np.bincount(np.concatenate(sets[k:k + 500]).astype(np.int64) & (SKETCH - 1), minlength=SKETCH)
                       .astype(np.uint32), out=counts)
            sig = [signature(s) for s in sets]
            none = [None] * len(sets)
            yield _row(b.column("doc_id"), b.column("text_hash"), [_fingerprint(s) for s in sets], [len(s) for s in sets],
                       [e for _, e in sig], [w.tobytes() for w, _ in sig], none, none)
        pieces = counts.reshape(-1, CHUNK)
        some = [int(i) for i in np.flatnonzero(pieces.any(axis=1))]
        none, zero = [None] * len(some), [0] * len(some)
        yield _row(none, none, zero, zero, zero, none, some, [pieces[i].tobytes() for i in some])
    return run


def _row(*columns):
    names, types = zip(*(c.split(" ") for c in NODE.split(", ")))
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[t]) for c, t in zip(columns, types)],
                                      names=list(names))


def _add_pieces(batches):
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for p, c in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist()):
            total[p] = total.get(p, 0) + np.frombuffer(c, np.uint32).astype(np.int64)
    for p, c in total.items():
        level = np.ceil(np.log2(np.maximum(c, 1)) * 2).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["piece", "level"])


def shingle_levels(pieces: DataFrame) -> bytes:
    """Half-octave levels of the counts: ``SKETCH`` bytes whatever the input."""
    rows = pieces.repartition("piece").mapInArrow(_add_pieces, "piece int, level binary").collect()
    out = np.zeros((SKETCH // CHUNK, CHUNK), np.uint8)
    for r in rows:
        out[r.piece] = np.frombuffer(r.level, np.uint8)
    return out.tobytes()


def _ordered(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set from rare to common; ties by hash."""
    return s[np.lexsort((s, level[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))]


# --- subtrees --------------------------------------------------------------------------------
SEEN = 200_000             # nodes that a task remembers, so as not to list copies again


def _postings(width: int, t: tuple, levels):
    """(key, node, short) for the prefix shingles of each set; short marks the part of the prefix that
    the smaller set of a link shares."""
    def run(batches):
        level, seen = np.frombuffer(levels.value, np.uint8), set()
        for b in batches:
            for _, sets in _sets(b.column("text"), width):
                some = {f: s for s in sets if len(s) and (f := _fingerprint(s)) not in seen}
                if not some:
                    continue
                seen = set(some) | (seen if len(seen) < SEEN else set())
                keys = [_ordered(s, level)[:_prefix(len(s), t)] for s in some.values()]
                n = np.array([len(k) for k in keys])
                rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                short = rank < np.repeat([_short_prefix(len(s), t) for s in some.values()], n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(list(some), np.int64), n)),
                     pa.array(short)], names=["key", "node", "short"])
    return run


def _shared(batches):
    """Rows sorted by key, node -> distinct rows of the keys with several nodes. Holds one row of a
    key until its second node comes, so a key of any size passes through."""
    held, open_key, last_node = None, None, None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
        key, node = t.column("key").to_numpy(), t.column("node").to_numpy()
        if not len(key):
            continue
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        if held is None and open_key is not None:
            fresh[0] = key[0] != open_key or node[0] != last_node
        t = t.filter(pa.array(fresh)).combine_chunks()
        end = (key[-1], node[-1])
        key = key[fresh]
        if not len(key):
            continue
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        several = np.bincount(group) > 1
        if held is None and open_key is not None and key[0] == open_key:
            several[0] = True
        keep = several[group]
        held = None if several[-1] else t.slice(len(key) - 1)
        open_key, last_node = end if several[-1] else (None, None)
        if keep.any():
            yield from t.filter(pa.array(keep)).combine_chunks().to_batches()


def _set_rows(width: int):
    def run(batches):
        for b in batches:
            for _, sets in _sets(b.column("text"), width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_fingerprint(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["node", "tokens"])
    return run


def signature(s: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's token bitmap, and its excess: tokens beyond the bits set."""
    bits = np.zeros(BITS, bool)
    bits[(s >> np.uint64(40)).astype(np.int64) % BITS] = True
    return np.packbits(bits).view(np.uint64), len(s) - int(bits.sum())


class Tree:
    """Signature tree over sets in order of size: levels of (OR bitmap, least size, greatest
    size, greatest excess); level 0 has one node per set. Two sets have at most
    ``popcount(a & b) + min(excess)`` tokens in common."""

    def __init__(self, words: np.ndarray, size: np.ndarray, excess: np.ndarray):
        self.levels = [(words, size, size, excess)]
        while len(self.levels[-1][1]) > 1:
            words, lo, hi, excess = self.levels[-1]
            at = np.arange(0, len(lo), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(words, at, axis=0), np.minimum.reduceat(lo, at),
                                np.maximum.reduceat(hi, at), np.maximum.reduceat(excess, at)))


def walk(a: Tree, b: Tree, t: tuple) -> np.ndarray:
    """Dual traversal: pairs (i, j) of sets whose bitmaps and sizes allow a link."""
    depth = max(len(a.levels), len(b.levels))
    level = lambda tree, d: tree.levels[min(d, len(tree.levels) - 1)]
    pairs = np.zeros((1, 2), np.int64)
    for d in range(depth - 1, -1, -1):
        if not len(pairs):
            break
        wa, loa, hia, xa = level(a, d)
        wb, lob, hib, xb = level(b, d)
        keep = []
        for k in range(0, len(pairs), 4096):
            i, j = pairs[k:k + 4096, 0], pairs[k:k + 4096, 1]
            # links need hi >= t * lo, and an overlap of t / (1 + t) of both sizes
            fit = (t[1] * hia[i] >= t[0] * lob[j]) & (t[1] * hib[j] >= t[0] * loa[i])
            i, j = i[fit], j[fit]
            most = np.bitwise_count(wa[i] & wb[j]).sum(axis=1, dtype=np.int64) + np.minimum(xa[i], xb[j])
            most = np.minimum(most, np.minimum(hia[i], hib[j]))
            ok = (t[0] + t[1]) * most >= t[0] * (loa[i] + lob[j])
            keep.append(np.stack([i[ok], j[ok]], axis=1))
        pairs = np.concatenate(keep)
        if a is b:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        if d and len(pairs):
            pairs = _children(pairs, len(level(a, d - 1)[1]), len(level(b, d - 1)[1]),
                              d < len(a.levels), d < len(b.levels))
    return pairs


def _children(pairs: np.ndarray, na: int, nb: int, down_a: bool, down_b: bool) -> np.ndarray:
    fa, fb = np.arange(FAN_OUT if down_a else 1), np.arange(FAN_OUT if down_b else 1)
    i = (pairs[:, 0] * len(fa))[:, None, None] + fa[None, :, None] + 0 * fb[None, None, :]
    j = (pairs[:, 1] * len(fb))[:, None, None] + 0 * fa[None, :, None] + fb[None, None, :]
    out = np.stack([i.ravel(), j.ravel()], axis=1)
    return out[(out[:, 0] < na) & (out[:, 1] < nb)]


def survivors(words: np.ndarray, size: np.ndarray, excess: np.ndarray, left: np.ndarray, right: np.ndarray,
              t: tuple) -> np.ndarray:
    """Pairs (i, j) from ``left`` x ``right`` (within ``left`` if ``right`` is empty) that the trees keep."""
    if not len(left):
        return np.zeros((0, 2), np.int64)
    left = left[np.argsort(size[left], kind="stable")]
    a = b = Tree(words[left], size[left], excess[left])
    if len(right):
        right = right[np.argsort(size[right], kind="stable")]
        b = Tree(words[right], size[right], excess[right])
    else:
        right = left
    pairs = walk(a, b, t)
    return np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], axis=1) if len(pairs) else np.zeros((0, 2), np.int64)


def linked(x: np.ndarray, y: np.ndarray, t: tuple) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return t[1] * both >= t[0] * (len(x) + len(y) - both)


def _edges(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in found], pa.int64()),
                                       pa.array([int(y) for _, y in found], pa.int64())], names=["src", "dst"])


def _search_sets(t: tuple):
    """Rows (key, a, node, tokens) sorted by key, a -> links that connect each block's sets."""
    def run(batches):
        for tab in whole_groups(batches, ["key", "a"], 2000):
            cut = bounds(tab, ["key", "a"])
            node, tokens = tab.column("node").to_numpy(), tab.column("tokens")
            found = []
            for p, q in zip(cut[:-1], cut[1:]):
                sets = [np.frombuffer(tokens[int(k)].as_buffer(), np.uint64) for k in range(p, q)]
                words, excess = zip(*map(signature, sets))
                size = np.array([len(s) for s in sets])
                label = np.arange(q - p)
                for i, j in survivors(np.array(words), size, np.array(excess), label.copy(), label[:0], t).tolist():
                    if label[i] != label[j] and linked(sets[i], sets[j], t):
                        found.append((node[p + i], node[p + j]))
                        label[label == label[j]] = label[i]
            yield _edges(found)
    return run


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all ``left`` x ``right`` sets, by products of 0/1 matrices over slices of the
    tokens that several sets have."""
    every, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(every):
        return np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(every, kind="stable")
    every, at = every[order], at[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    token = np.cumsum(new) - 1
    several = np.bincount(token) > 1
    keep = several[token]
    token, at = (np.cumsum(several) - 1)[token[keep]], at[keep]
    out = np.zeros((len(left), len(right)), np.int64)
    for t in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(token, [t, t + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[at[a:b], token[a:b] - t] = 1
        out += (m[left] @ m[right].T).astype(np.int64)
    return out


def _merge(label: np.ndarray, pairs: np.ndarray, ok: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that join two labels, in turn; ``label`` is changed."""
    out = []
    for i, j in pairs[ok].tolist():
        if label[i] != label[j]:
            out.append((i, j))
            label[label == label[j]] = label[i]
    return out


def _verified(sets: list[np.ndarray], size: np.ndarray, pairs: np.ndarray, left: np.ndarray, right: np.ndarray, t: tuple) -> np.ndarray:
    """Which pairs link."""
    if len(pairs) < DENSE:
        return np.array([linked(sets[i], sets[j], t) for i, j in pairs.tolist()], bool)
    other = right if len(right) else left
    both = overlaps(sets, left, other)[np.searchsorted(left, pairs[:, 0]), np.searchsorted(other, pairs[:, 1])]
    return t[1] * both >= t[0] * (size[pairs[:, 0]] + size[pairs[:, 1]] - both)


def _search_dense(t: tuple):
    """Rows (key, a, b, side, node, label, tokens) sorted by key, a, b -> links that connect the sets of a pair of
    blocks as far as their labels leave them apart. Sets of one label aren't compared."""
    def run(batches):
        for tab in whole_groups(batches, ["key", "a", "b"], 1024):
            cut = bounds(tab, ["key", "a", "b"])
            node, label, side = (tab.column(c).to_numpy() for c in ("node", "label", "side"))
            tokens, found = tab.column("tokens"), []
            for p, q in zip(cut[:-1], cut[1:]):
                lab = np.unique(label[p:q], return_inverse=True)[1]
                if q - p < 2 or lab.max() == 0:
                    continue
                sets = [np.frombuffer(tokens[int(k)].as_buffer(), np.uint64) for k in range(p, q)]
                size = np.array([len(s) for s in sets])
                words, excess = zip(*map(signature, sets))
                left, right = np.flatnonzero(side[p:q] == 0), np.flatnonzero(side[p:q] == 1)
                pairs = survivors(np.array(words), size, np.array(excess), left, right, t)
                pairs = pairs[lab[pairs[:, 0]] != lab[pairs[:, 1]]]
                found += [(node[p + i], node[p + j]) for i, j in _merge(lab, pairs, _verified(sets, size, pairs, left, right, t))]
            if found:
                yield _edges(found)
    return run


def _least_shared(keys: list[np.ndarray], key: int, pairs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs share no subtree whose key is less than ``key``."""
    before = [k[:np.searchsorted(k, key)] for k in keys]
    if len(pairs) < DENSE:
        return np.array([not len(np.intersect1d(before[i], before[j], assume_unique=True)) for i, j in pairs.tolist()], bool)
    other = right if len(right) else left
    both = overlaps(before, left, other)
    return both[np.searchsorted(left, pairs[:, 0]), np.searchsorted(other, pairs[:, 1])] == 0


def _search_apart(t: tuple):
    """Rows (key, a, b, side, node, label, size, excess, bits, keys) sorted by key, a, b -> pairs to verify (src, dst), or a
    row (key, a, b) for a block that would put out more than ``FEW`` pairs per set."""
    def run(batches):
        for tab in whole_groups(batches, ["key", "a", "b"]):
            cut = bounds(tab, ["key", "a", "b"])
            node, label, side, size, excess, key, a, b = (
                tab.column(c).to_numpy() for c in ("node", "label", "side", "size", "excess", "key", "a", "b"))
            words = np.array([np.frombuffer(x.as_buffer(), np.uint64) for x in tab.column("bits")])
            found, dense = [], []
            for p, q in zip(cut[:-1], cut[1:]):
                lab, s = label[p:q], side[p:q]
                if q - p < 2 or lab.min() == lab.max():
                    continue
                left, right = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
                pairs = survivors(words[p:q], size[p:q], excess[p:q], left, right, t)
                pairs = pairs[lab[pairs[:, 0]] != lab[pairs[:, 1]]]
                if len(pairs):
                    keys = [x.values.to_numpy() for x in tab.column("keys").slice(p, q - p)]
                    pairs = pairs[_least_shared(keys, key[p], pairs, left, right)]
                if len(pairs) > FEW * (q - p):
                    dense.append((key[p], a[p], b[p]))
                elif len(pairs):
                    found.append(np.sort(node[p + pairs], axis=1))
            out = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            n, m = len(out), len(dense)
            if n + m:
                null = lambda k, type_: pa.nulls(k, type_)
                where = [pa.array([int(d[i]) for d in dense], type_) for i, type_ in enumerate((pa.int64(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array(out[:, i]), null(m, pa.int64())]) for i in (0, 1)]
                    + [pa.concat_arrays([null(n, w.type), w]) for w in where], names=["src", "dst", "key", "a", "b"])
    return run


def _search_alive(t: tuple):
    """Rows (key, a, b, side, node, label, size, excess, bits) sorted by key, a, b -> the nodes that the trees leave in a pair
    of different labels. ``a`` and ``b`` are blocks of a subtree (the same: searched within itself)."""
    def run(batches):
        for tab in whole_groups(batches, ["key", "a", "b"]):
            cut = bounds(tab, ["key", "a", "b"])
            node, label, side, size, excess = (tab.column(c).to_numpy() for c in ("node", "label", "side", "size", "excess"))
            words = np.array([np.frombuffer(x.as_buffer(), np.uint64) for x in tab.column("bits")])
            found = []
            for p, q in zip(cut[:-1], cut[1:]):
                lab, s = label[p:q], side[p:q]
                if q - p < 2 or lab.min() == lab.max():
                    continue
                pairs = survivors(words[p:q], size[p:q], excess[p:q], np.flatnonzero(s == 0), np.flatnonzero(s == 1), t)
                found.append(node[p + np.unique(pairs[lab[pairs[:, 0]] != lab[pairs[:, 1]]])])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["node"])
    return run


def _pair(a, b, side: int):
    return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(side).alias("side"))


def _homes(members: DataFrame, sets: DataFrame, t: tuple) -> DataFrame:
    """Links within blocks of each set's largest subtree; the subtree's least member is in each block."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    home = (members.join(sizes, "key").filter("n > 1").groupBy("node")
            .agg(F.max(F.struct("n", "key", "first")).alias("h")).select("node", "h.key", "h.first"))
    blocks = home.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.first("first").alias("first"))
    mine = home.join(blocks.drop("first"), "key").filter("node <> first").select(
        "key", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("a"))
    pilot = blocks.select("key", F.col("first").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"))
    return (mine.union(pilot).join(sets, "node").select("key", "a", "node", "tokens").repartition("key", "a")
            .sortWithinPartitions("key", "a").mapInArrow(_search_sets(t), "src long, dst long"))


def _all_tasks(members: DataFrame, labels: DataFrame, stage: Stage, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of blocks of every subtree that holds several components; the largest component's
    blocks come first and meet the others' blocks only. Returns the tasks, (key, node) of these subtrees, and the
    written table that both read."""
    rows = base = stage.save(members.select("key", "node").join(labels, "node", "left")
                             .select("key", "node", F.coalesce("comp", "node").alias("label")), "labels")
    sizes = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    live = (sizes.groupBy("key").agg(F.count(F.lit(1)).alias("apart"), F.max_by("label", "n").alias("major"),
                                     F.max("n").alias("most"), F.sum("n").alias("n")).filter("apart > 1")
            .select("key", "major", F.ceil(F.col("most") / most).cast("int").alias("upper"),
                    F.ceil((F.col("n") - F.col("most")) / most).cast("int").alias("lower")))
    h = F.xxhash64("node")
    is_major = F.col("label") == F.col("major")
    block = F.when(is_major, F.pmod(h, F.col("upper"))).otherwise(F.col("upper") + F.pmod(h, F.col("lower"))).cast("int")
    rows = rows.join(live, "key").withColumn("block", block)
    mine, end = F.col("block"), F.col("upper") + F.col("lower") - 1
    to = F.transform(F.sequence(F.when(is_major, F.col("upper")).otherwise(0), end),
                     lambda o: F.when(o < mine, _pair(o, mine, 1)).otherwise(_pair(mine, o, 0)))
    return rows.select("key", "node", "label", F.inline(to)), rows.select("key", "node"), base


def _block_tasks(members: DataFrame) -> DataFrame:
    """Every block of every subtree by itself, each set with a label of its own."""
    live = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return members.join(live, "key").select("key", "node", F.col("node").alias("label"), F.inline(F.array(_pair(mine, mine, 0))))


def _alive(members: DataFrame, sigs: DataFrame, t: tuple, stage: Stage) -> DataFrame:
    """(node) that keep a partner in some subtree: found within blocks, and the others across them."""
    order = ["key", "a", "b"]

    def search(tasks: DataFrame) -> DataFrame:
        return (tasks.join(sigs, "node").select(*order, "side", "node", "label", "size", "excess", "bits")
                .repartition(*order).sortWithinPartitions(*order).mapInArrow(_search_alive(t), "node long").distinct())
    near = stage.save(search(_block_tasks(members)), "alive")
    # what is alive already needs no partner: one label for all of it
    tasks, _, base = _all_tasks(members, near.withColumn("comp", F.lit(0).cast("long")), stage, BLOCK)
    out = stage.save(near.union(search(tasks)).distinct(), "alive")
    stage.drop(base)
    return out


def _verify(t: tuple):
    def run(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            keep = [linked(np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64), t)
                    for k in range(b.num_rows)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["src", "dst"])
    return run


def _apart(members: DataFrame, labels: DataFrame, sigs: DataFrame, sets: DataFrame, t: tuple, stage: Stage) -> DataFrame:
    """Links between sets of different components that share a subtree: as many as connect them."""
    order = ["key", "a", "b"]
    tasks, live, base = _all_tasks(members, labels, stage, BLOCK)
    # two sets of different labels share live subtrees only; a list is at most as long as a prefix
    keys = live.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    found = (tasks.join(sigs.join(keys, "node"), "node").select(*order, "side", "node", "label", "size", "excess", "bits", "keys")
             .repartition(*order).sortWithinPartitions(*order)
             .mapInArrow(_search_apart(t), "src long, dst long, key long, a int, b int"))
    found = stage.save(found, "pairs")
    pairs = found.filter("src is not null").select("src", "dst").distinct()
    both = (pairs.join(sets.select(F.col("node").alias("src"), F.col("tokens").alias("x")), "src")
            .join(sets.select(F.col("node").alias("dst"), F.col("tokens").alias("y")), "dst").select("src", "dst", "x", "y"))
    dense = tasks.join(found.filter("src is null").select(*order), order, "left_semi").join(sets, "node")
    links = stage.save(
        both.mapInArrow(_verify(t), "src long, dst long").union(
            dense.select(*order, "side", "node", "label", "tokens").repartition(*order).sortWithinPartitions(*order)
            .mapInArrow(_search_dense(t), "src long, dst long")), "links")
    stage.drop(base)
    stage.drop(found)
    return links


def _subtrees(rows: DataFrame) -> DataFrame:
    """Keys of the subtrees that may hold a link: one of several members has the key in its short
    prefix; of subtrees with the same members, one."""
    part = F.shiftrightunsigned(F.xxhash64("node"), 16)
    stat = rows.groupBy("key").agg(
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"), F.try_sum(part).alias("s"),
        F.max("short").alias("short"))
    same = F.when(F.col("s").isNull(), F.col("key"))           # a sum beyond 64 bits: a subtree by itself
    return (stat.filter("short").groupBy("lo", "hi", "n", "s", same.alias("own"))
            .agg(F.min("key").alias("key")).select("key"))


def jaccard_components(docs: DataFrame, stage: Stage, width: int = WIDTH, threshold: tuple = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, n_shingles, node, comp, component_id, one row per row of docs.

    ``node`` is the fingerprint of the document's set (0 without shingles), ``comp`` that of its component."""
    sc = docs.sparkSession.sparkContext
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    both = stage.save(d.mapInArrow(_nodes_and_counts(width), NODE), "nodes")
    nodes = both.filter("piece is null").drop("piece", "counts")
    levels = sc.broadcast(shingle_levels(both.filter("piece is not null").select("piece", "counts")))
    shared = stage.save(d.select("text").mapInArrow(_postings(width, threshold, levels), "key long, node long, short boolean")
                        .repartition("key").sortWithinPartitions("key", "node")
                        .mapInArrow(_shared, "key long, node long, short boolean"), "shared")
    subtrees = stage.save(_subtrees(shared), "subtrees")
    every = stage.save(shared.join(subtrees, "key", "left_semi"), "members")
    stage.drop(shared)
    stage.drop(subtrees)
    sigs = stage.save(nodes.join(every.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.any_value("n_shingles").alias("size"), F.any_value("excess").alias("excess"), F.any_value("bits").alias("bits")), "signatures")
    nodes = stage.save(nodes.drop("bits", "excess"), "nodes")
    stage.drop(both)
    alive = _alive(every, sigs, threshold, stage)
    members = stage.save(every.join(alive, "node", "left_semi").select("key", "node"), "members")
    stage.drop(every)
    # one text for each of these nodes
    one = (nodes.join(alive, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("o"))
           .select(F.xxhash64("o.doc_id", "o.text_hash").alias("_row")))
    text = d.withColumn("_row", F.xxhash64("doc_id", "text_hash")).join(stage.save(one, "wanted").distinct(), "_row", "left_semi")
    sets = (text.select("text").mapInArrow(_set_rows(width), "node long, tokens binary")
            .groupBy("node").agg(F.any_value("tokens").alias("tokens")))
    sets = stage.save(sets, "sets")
    found = stage.save(_homes(members, sets, threshold), "links")
    more = _apart(members, components(found, stage), sigs, sets, threshold, stage)
    stage.drop(members)
    stage.drop(sigs)
    stage.drop(sets)
    comp = (nodes.join(components(found.union(more), stage), "node", "left")
            .withColumn("comp", F.coalesce("comp", "node")))
    comp = stage.save(comp, "labelled")
    stage.drop(nodes)
    least = comp.filter("n_shingles > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return (comp.join(least, "comp", "left")
            .select("doc_id", "text_hash", "n_shingles", "node", "comp",
                    F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def one_of_each(docs: DataFrame, stage: Stage, width: int = WIDTH, threshold: tuple = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row with its least doc_id
    stays (a row without id only if none has one), and every text without words.

    Texts meet the kept rows once, unsorted; only rows whose id and text occur more than once are reduced to one of them. All columns
    come back as they are, whatever their names."""
    row, n = unused(docs.columns, "_row"), unused(docs.columns, "_n")
    comp = jaccard_components(docs, stage, width, threshold).filter("n_shingles > 0")
    same = (comp.groupBy("comp", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).groupBy("comp")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")).alias("o")))
    first = stage.save(same.select(F.xxhash64("o.doc_id", "o.text_hash").alias(row), F.col("o.n").alias(n)).distinct(), "kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = (docs.filter(worded).withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
             .join(first.hint("shuffle_hash"), row))
    out = docs.filter(~worded).unionByName(found.filter(F.col(n) == 1).select(*docs.columns))
    if not first.filter(F.col(n) > 1).isEmpty():
        out = out.unionByName(found.filter(F.col(n) > 1).dropDuplicates([row]).select(*docs.columns))
    return out


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_components(docs, Stage(spark, "op5")).select("doc_id", "n_shingles", "component_id")
