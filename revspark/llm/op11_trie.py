"""Conversation prefix trie by splitter skeleton.

A conversation is a path of turn keys (16 bytes of a SHA-256 over role and text), so paths are binary strings whose
order puts a prefix before what extends it, and the conversations below a node are one range of the order (path,
conv_id). A bounded sample gives the splitters of the shards. Only prefixes of a splitter's path can lie on both
sides of it: those prefixes are the *skeleton*, a trie of at most shards x ``SPLITTER_TURNS`` nodes. Splitters and skeleton
are shipped to all tasks.

Each shard is one sorted task that walks its paths with a stack of open nodes, as deep as one conversation.
A node outside the skeleton lies in one shard and is finished there. For a skeleton node the shard leaves a partial: members,
smallest member, finished children, and the leaves and saved words of finished subtrees that hang from it. Spark adds the
partials up and reduces them over the skeleton's ancestors. Ids of conversations that end in a skeleton node (one
conversation text may be copied into a third of all rows) are left as numbered chunks of joined digits and are hashed
in order, a chunk at a time.

Cases: null roles and texts are empty; turns go null first, equal turns by role, then by the text's SHA-256; repeated rows are
turns of their own; rows without conv_id belong to no conversation; no conversations give no nodes. Turn keys are
compared, not texts: two turns are equal up to a collision of 128 bits of SHA-256. A conversation is one row of 20 bytes a turn.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table

KEY = 16                    # bytes of a turn key
SPLITTER_TURNS = 64         # longest splitter path
SAMPLE = 16                 # sampled conversations a shard, about
SHARD_TURNS = 2_000_000     # turns and conversations that a shard is planned for
MAX_SHARDS = 4096           # so the skeleton has at most 4096 x 64 nodes of some 30 bytes as shipped
LEAST_ID = -(1 << 63)
CHUNK = 1 << 16             # characters of joined ids in a chunk
WORD = r"[^\x20\x09-\x0D]+"


def turn_lists(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, turns: array of (key, words) in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    sha = F.sha2(text.cast("binary"), 256)
    key = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, sha).cast("binary"), 256), 1, 2 * KEY))
    turn = F.struct("turn", role.alias("role"), sha.alias("sha"), key.alias("key"),
                    F.regexp_count(text, F.lit(WORD)).alias("words"))
    return (rows.filter("conv_id is not null").select("conv_id", turn.alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns")))


def rebuild(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c: the first h turns of conversation c - c % family, then c's own after its first h;
    h is crc32(c) % most."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = turns.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("first"))
    own = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": head})
    none = F.slice("turns", 1, 0)
    return (own.join(base, "base", "left")
            .select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), F.col("h")), none),
                                        F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")))


def as_paths(turns: DataFrame) -> DataFrame:
    """conv_id, turns -> conv_id, path (turn keys one after another), words (of each turn)."""
    return turns.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("path"),
                        F.transform("turns", lambda t: t["words"]).alias("words"))


def splitters(paths: DataFrame, shards: int, sample: int = SAMPLE, longest: int = SPLITTER_TURNS) -> list[tuple[bytes, int]]:
    """At most ``shards`` - 1 (path, conv_id) that cut a sample of about ``sample`` x ``shards`` rows, chosen by a
    hash of the conv_id, into ranges of equal weight (turns + 1).

    A splitter keeps its path where its predecessor in the sample has the same one, so that copies of one conversation are cut by conv_id; else
    only the turns up to the first that differs from its predecessor's."""
    if shards < 2:
        return []
    odds = min(1.0, sample * shards / max(paths.count(), 1))
    chosen = F.pmod(F.xxhash64("conv_id", F.lit(11)), F.lit(1 << 20)) < int(odds * (1 << 20))
    rows = sorted((bytes(r.path), r.conv_id, r.w) for r in paths.filter(chosen).select(
        F.substring("path", 1, KEY * longest).alias("path"), "conv_id", (F.size("words") + 1).alias("w")).collect())
    total, seen, out, before = sum(r[2] for r in rows), 0, [], b""
    for path, conv, w in rows:
        if seen * shards >= total * (len(out) + 1):
            out.append((path, conv) if path == before else (path[:KEY * (_common(before, path) + 1)], LEAST_ID))
        seen, before = seen + w, path
    return sorted(set(out))


class Skeleton:
    """All prefixes of the splitters' paths as a trie; node 0 is the root, ``kids[i]`` its children by turn key."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.kids, self.up, self.depth = [{}], [None], [0]
        for path, _ in cuts:
            at = 0
            for d in range(0, len(path), KEY):
                at = self._child(at, path[d:d + KEY])

    def _child(self, at: int, key: bytes) -> int:
        if key not in self.kids[at]:
            self.kids[at][key] = len(self.kids)
            self.kids.append({})
            self.up.append(at)
            self.depth.append(self.depth[at] + 1)
        return self.kids[at][key]

    def lines(self):
        """(node, depth, parent, the node and its ancestors)."""
        above: list[list[int]] = []
        for i, up in enumerate(self.up):
            above.append([i] if up is None else [*above[up], i])
            yield i, self.depth[i], up, above[i]


NODE = pa.schema([("skel", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()),
                  ("parent_skel", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
                  ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends_sha256", pa.string()),
                  ("shard", pa.int32()), ("chunk", pa.int64()), ("ids", pa.string())])
NODE_TYPE = ("skel int, depth long, conv_id long, parent_conv_id long, parent_skel int, n_convs long, n_children long, "
             "n_leaves long, saved_tokens long, words long, ends_sha256 string, shard int, chunk long, ids string")


class Node:
    """An open node of the walk."""
    __slots__ = ("skel", "words", "least", "convs", "children", "leaves", "saved", "ends", "ids", "chars", "chunks", "waiting")

    def __init__(self, skel: int | None, words: int):
        self.skel, self.words, self.least = skel, words, None
        self.convs = self.children = self.leaves = self.saved = self.chars = self.chunks = 0
        self.ends, self.ids, self.waiting = (hashlib.sha256() if skel is None else None), [], []


class Walk:
    """Sorted paths of one shard -> rows of ``NODE``: finished nodes (skel null), partials and chunks of skeleton nodes."""

    def __init__(self, skel: Skeleton, shard: int, chunk: int):
        self.skel, self.shard, self.chunk, self.rows = skel, shard, chunk, []
        self.path, self.open = b"", [Node(0, 0)]

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        same = _common(self.path, path)
        while len(self.open) - 1 > same:
            self.close()
        for d in range(same + 1, len(path) // KEY + 1):
            up = self.open[-1].skel                           # below a finished node all nodes are finished
            self.open.append(Node(None if up is None else self.skel.kids[up].get(path[(d - 1) * KEY:d * KEY]), words[d - 1]))
        self.path, top = path, self.open[-1]
        top.convs += 1
        top.least = conv if top.least is None else min(top.least, conv)
        if top.skel is None:
            top.ends.update(f",{conv}".encode() if top.chars else str(conv).encode())
            top.chars = 1
        else:
            top.ids.append(str(conv))
            top.chars += len(top.ids[-1]) + 1
            if top.chars >= self.chunk:
                self.leave_chunk(top)

    def leave_chunk(self, node: Node) -> None:
        self.rows.append((node.skel, *[None] * 10, self.shard, node.chunks, ",".join(node.ids)))
        node.chunks, node.ids, node.chars = node.chunks + 1, [], 0

    def close(self) -> None:
        """Finish the deepest node. The row of a finished node whose parent is finished here too waits for the
        parent's smallest member, which is known when the parent closes."""
        depth, node = len(self.open) - 1, self.open.pop()
        up = self.open[-1] if self.open else None
        if up is not None and node.least is not None:
            up.least = node.least if up.least is None else min(up.least, node.least)
        if node.skel is None:
            node.saved += (node.convs - 1) * node.words
            node.leaves += 0 if node.children else 1
            up.convs += node.convs
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            self.emit_waiting(node)
            row = (None, depth, node.least, None, up.skel, node.convs, node.children, node.leaves, node.saved, node.words,
                   node.ends.hexdigest(), None, None, None)
            if up.skel is None:
                up.waiting.append(row)
            else:
                self.rows.append(row)
        else:
            if node.ids:
                self.leave_chunk(node)
            self.rows.append((node.skel, depth, node.least, None, None, node.convs, node.children, node.leaves, node.saved,
                              node.words, None, self.shard, None, None))

    def emit_waiting(self, node: Node) -> None:
        self.rows += [(*r[:3], node.least, *r[4:]) for r in node.waiting]
        node.waiting = []

    def end(self) -> None:
        while self.open:
            self.close()


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // KEY
    low, high = 0, n // KEY
    while low < high:                                # the first turns agree up to low, and not up to high
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid * KEY] == b[:mid * KEY] else (low, mid - 1)
    return low


def _deal(cuts: list[tuple[bytes, int]]):
    def run(batches):
        for b in batches:
            keys = zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist())
            yield b.append_column("shard", pa.array([bisect_right(cuts, k) for k in keys], pa.int32()))
    return run


def _shard(skel: Skeleton, chunk: int):
    def run(batches):
        walk = None
        for b in batches:
            for conv, path, words, shard in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "words", "shard"))):
                if walk is None or walk.shard != shard:
                    if walk is not None:
                        walk.end()
                        yield from _rows(walk)
                    walk = Walk(skel, shard, chunk)
                walk.add(conv, path, words)
                if len(walk.rows) >= 10_000:
                    yield from _rows(walk)
        if walk is not None:
            walk.end()
            yield from _rows(walk)
    return run


def _rows(walk: Walk):
    rows, walk.rows = walk.rows, []
    for a in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[a:a + 10_000]), NODE)], schema=NODE)


def _hash_chunks(batches):
    """Chunks sorted by (skel, shard, chunk) -> skel, ends_sha256, one chunk held at a time."""
    now, sha, out = None, None, []
    for b in batches:
        for skel, ids in zip(b.column("skel").to_pylist(), b.column("ids").to_pylist()):
            if skel != now:
                if now is not None:
                    out.append((now, sha.hexdigest()))
                now, sha = skel, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if now is not None:
        out.append((now, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([h for _, h in out], pa.string())],
                                     names=["skel", "ends_sha256"])


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(paths: DataFrame, stage: Stage, shards: int | None = None, chunk: int = CHUNK, sample: int = SAMPLE,
                longest: int = SPLITTER_TURNS) -> DataFrame:
    """paths(conv_id, path, words), one row per conversation -> a row per node (``COLUMNS``)."""
    spark = stage.spark
    paths = stage.save(paths, "paths")
    if shards is None:
        load = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        shards = min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), load // SHARD_TURNS))
    cuts = splitters(paths, shards, sample, longest)
    skel = Skeleton(cuts)
    dealt = paths.mapInArrow(_deal(cuts), "conv_id long, path binary, words array<int>, shard int")
    sorted_ = dealt.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    nodes = stage.save(sorted_.mapInArrow(_shard(skel, chunk), NODE_TYPE), "nodes")
    stage.drop(paths)

    # the skeleton: partials by node, then every node's numbers to itself and its ancestors
    tree = spark.createDataFrame(list(skel.lines()), "skel int, depth long, up int, above array<int>")
    partial = (nodes.filter("skel is not null and ids is null").groupBy("skel")
               .agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
                    F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"), F.max("words").alias("words"))
               .join(tree, "skel"))
    partial = stage.save(partial, "partials")
    sums = (partial.select(F.explode("above").alias("skel"), "conv_id", "n_convs", "n_leaves", "saved")
            .groupBy("skel").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
                                 F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved")))
    inner = partial.filter("up is not null").groupBy(F.col("up").alias("skel")).agg(F.count(F.lit(1)).alias("kids"))
    ends = nodes.filter("ids is not null").select("skel", "shard", "chunk", "ids")
    ends = ends.repartition("skel").sortWithinPartitions("skel", "shard", "chunk").mapInArrow(_hash_chunks, "skel int, ends_sha256 string")
    own = (partial.select("skel", "depth", "up", "above", "n_children", "words").join(sums, "skel").join(inner, "skel", "left")
           .join(ends, "skel", "left")
           .withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
           .withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0))
           .withColumn("self", (F.col("n_convs") - 1) * F.col("words")))
    own = stage.save(own, "skeleton")
    more = (own.select(F.explode("above").alias("skel"), "leaf", "self").groupBy("skel")
            .agg(F.sum("leaf").alias("leaf"), F.sum("self").alias("self")))
    least = own.select(F.col("skel").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    top = (own.drop("leaf", "self").join(more, "skel").join(least, "up", "left")
           .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
                   (F.col("saved") + F.col("self")).alias("saved_tokens"),
                   F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))
    done = nodes.filter("skel is null").join(
        F.broadcast(least.select(F.col("up").alias("parent_skel"), F.col("parent_conv_id").alias("above_id"))), "parent_skel", "left")
    done = done.withColumn("parent_conv_id", F.coalesce("above_id", "parent_conv_id")).select(*COLUMNS)
    return done.unionByName(top.select(*COLUMNS))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_lists(table(spark, sf_dir, "conversations"))
    return prefix_trie(as_paths(rebuild(turns)), Stage(spark, "op11"))


SQL = {"op11_trie": r"""
WITH r AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS no
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT c, c - c % 20 AS base, count(*) AS n,
    CAST((4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))),
      lambda a, y: list_reduce(list_prepend(xor(a, y), range(8)), lambda z, i: xor(z >> 1, (z & 1) * 3988292384)))) % 4 AS INTEGER) AS h
  FROM r GROUP BY c),
t AS (SELECT b.c, r.no AS pos, r.role, r.text FROM b JOIN r ON r.c = b.base AND r.no <= b.h
  UNION ALL SELECT b.c, r.no - b.h + least(b.h, coalesce(o.n, 0)), r.role, r.text
  FROM b JOIN r ON r.c = b.c AND r.no > b.h LEFT JOIN b o ON o.c = b.base),
p AS (SELECT b.c, list(length(t.role) || ':' || t.role || t.text ORDER BY t.pos) FILTER (t.pos IS NOT NULL) AS keys,
    list(len(regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')) ORDER BY t.pos) FILTER (t.pos IS NOT NULL) AS words FROM b LEFT JOIN t ON t.c = b.c GROUP BY b.c),
m AS MATERIALIZED (SELECT c, d, sha256(CAST(keys[1:d] AS VARCHAR)) AS prefix, coalesce(words[d], 0) AS words, d = coalesce(len(keys), 0) AS ends
  FROM (SELECT *, unnest(range(0, coalesce(len(keys), 0) + 1)) AS d FROM p)),
n AS MATERIALIZED (SELECT d, CASE WHEN d > 0 THEN prefix END AS prefix, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY 1, 2),
w AS MATERIALIZED (SELECT m.c, m.d, n.conv_id FROM m JOIN n ON m.d = n.d AND (m.d = 0 OR m.prefix = n.prefix)),
k AS (SELECT w.conv_id, w.d, count(*) AS n_children FROM n JOIN w ON w.c = n.conv_id AND w.d = n.d - 1 GROUP BY ALL),
s AS (SELECT w.conv_id, w.d, CAST(count(*) FILTER (k.n_children IS NULL) AS BIGINT) AS n_leaves, CAST(sum((n.n_convs - 1) * n.words) AS BIGINT) AS saved_tokens
  FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.d = n.d JOIN w ON w.c = n.conv_id AND w.d <= n.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.conv_id = n.conv_id AND s.d = n.d LEFT JOIN k ON k.conv_id = n.conv_id AND k.d = n.d
LEFT JOIN w u ON u.c = n.conv_id AND u.d = n.d - 1"""}
