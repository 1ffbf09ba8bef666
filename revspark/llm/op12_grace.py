"""Exact dedup by Grace hashing: complete contents meet in open-addressing tables.

1. Blocks. Each task folds its rows, up to ``BLOCK_BYTES`` of distinct content or ``BLOCK_ROWS`` rows at a
   time, through an open-addressing table, so copies that lie together become one *class* (content, greatest id,
   number of rows, the ids). The classes are the first spill table.
2. Buckets. Classes are dealt by hash to as many buckets as their bytes ask for; a bucket is one task and
   one table that compares complete contents. What doesn't fit under ``TABLE_BYTES`` is passed on, written, and dealt
   again by another hash, until nothing is left. A content is either in the table from its first class on, or all its
   classes are passed on, so no group is torn.
3. Each class learns its group's greatest id and size; its rows get them by a join on the class, which has one block's
   rows at most. So a text that a third of all rows hold crosses the network once a block, its ids never meet in one
   task, and no join key is hot.

Cases: null and empty texts are equal (empty); a normalisation is a column expression of the caller. Ids may be null or
repeated: the greatest id that isn't null stays, null only where a group has no other; of several rows with that id one
stays (``kept``). A text longer than ``TABLE_BYTES`` has a table of its own. No rows give no rows; other columns
of the input may have any names.
"""
from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, table

BLOCK_BYTES = 32 << 20      # distinct content that a task folds before it writes classes
BLOCK_ROWS = 1 << 16
BUCKET_BYTES = 64 << 20     # content that a bucket is planned for
TABLE_BYTES = 128 << 20     # content that a bucket's table holds
OUT_ROWS = 20_000


class ContentTable:
    """Open addressing with linear probing over complete contents.

    Slots hold entry numbers; an entry is its hash and its whole content. Half of the slots at least stay free."""

    def __init__(self):
        self.slots, self.hashes, self.contents, self.bytes = [-1] * 1024, [], [], 0

    def find(self, h: int, content: bytes) -> int:
        """The entry of this content, or -1."""
        slots, mask = self.slots, len(self.slots) - 1
        i = h & mask
        while (e := slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            i = (i + 1) & mask
        return -1

    def add(self, h: int, content: bytes) -> int:
        """A new entry for a content that ``find`` doesn't know."""
        e = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self.slots = [-1] * (2 * len(self.slots))
            for old in range(e):
                self._place(old)
        self._place(e)
        return e

    def _place(self, e: int) -> None:
        mask = len(self.slots) - 1
        i = self.hashes[e] & mask
        while self.slots[i] >= 0:
            i = (i + 1) & mask
        self.slots[i] = e


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


BLOCK_SCHEMA = pa.schema([("cls", pa.int64()), ("h", pa.int64()), ("sha", pa.string()), ("content", pa.binary()),
                          ("bytes", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64()))])


def _blocks(block_bytes: int, block_rows: int):
    """(id, content) rows -> classes of equal content, block by block."""
    def flush(known: ContentTable, shas: list, ids: list, first: int):
        ids = [sorted(g, key=lambda i: (i is None, 0 if i is None else -i)) for g in ids]
        columns = [range(first, first + len(ids)), known.hashes, shas, known.contents, [len(c) for c in known.contents],
                   [g[0] for g in ids], [len(g) for g in ids], ids]
        for a in range(0, len(ids), OUT_ROWS):
            yield _batch(BLOCK_SCHEMA, [c[a:a + OUT_ROWS] for c in columns])

    def run(batches):
        cls = TaskContext.get().partitionId() << 40
        known, shas, ids, rows = ContentTable(), [], [], 0
        for b in batches:
            for key, value in zip(b.column(0).to_pylist(), b.column(1)):
                content = value.as_py()
                digest = hashlib.sha256(content).digest()
                h = int.from_bytes(digest[:8], "little", signed=True)
                e = known.find(h, content)
                if e < 0:
                    e = known.add(h, content)
                    shas.append(digest.hex())
                    ids.append([])
                ids[e].append(key)
                rows += 1
                if known.bytes >= block_bytes or rows >= block_rows:
                    yield from flush(known, shas, ids, cls)
                    cls += len(ids)
                    known, shas, ids, rows = ContentTable(), [], [], 0
        if rows:
            yield from flush(known, shas, ids, cls)
    return run


FIELDS = ["cls", "h", "content", "bytes", "last", "n"]        # what a bucket gets
LEVEL_SCHEMA = pa.schema([("cls", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("home", pa.bool_()),
                          *list(BLOCK_SCHEMA)[1:2], *list(BLOCK_SCHEMA)[3:7]])
LEVEL = "cls long, keep_id long, group_size long, home boolean, h long, content binary, bytes long, last long, n long"


def _resolve(table_bytes: int):
    """The classes of a bucket -> per class its group's greatest id and size, and whether it holds the row that
    stays; classes whose content found no room come out as they are, with their content."""
    def run(batches):
        known, last, size, home = ContentTable(), [], [], []
        seen, entry = [], []
        for b in batches:
            late = []
            for i, (cls, h, top, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("cls", "h", "last", "n")))):
                content = b.column("content")[i].as_py()
                e = known.find(h, content)
                if e < 0:
                    if known.hashes and known.bytes + len(content) > table_bytes:
                        late.append(i)
                        continue
                    e = known.add(h, content)
                    last.append(top)
                    size.append(0)
                    home.append(cls)
                size[e] += n
                if (top is not None, top or 0, -cls) > (last[e] is not None, last[e] or 0, -home[e]):
                    last[e], home[e] = top, cls
                seen.append(cls)
                entry.append(e)
            if late:
                t = b.take(pa.array(late))
                none = [pa.nulls(len(late), f.type) for f in list(LEVEL_SCHEMA)[1:4]]
                yield pa.RecordBatch.from_arrays(
                    [t.column("cls"), *none, *(t.column(c) for c in FIELDS[1:])], schema=LEVEL_SCHEMA)
        for a in range(0, len(seen), OUT_ROWS):
            part = list(zip(seen[a:a + OUT_ROWS], entry[a:a + OUT_ROWS]))
            none = [[None] * len(part)] * len(FIELDS[1:])
            yield _batch(LEVEL_SCHEMA, [[c for c, _ in part], [last[e] for _, e in part], [size[e] for _, e in part],
                                        [home[e] == c for c, e in part], *none])
    return run


def dedup(docs: DataFrame, stage: Stage, content: Column | None = None, key: str = "doc_id",
          block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS, bucket_bytes: int = BUCKET_BYTES,
          table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: its id (named as ``key``), keep_id, group_size, kept, text_sha256.

    ``content`` is the normalised text to compare, ``text`` unchanged by default."""
    content = F.coalesce(F.col("text") if content is None else content, F.lit("")).cast("binary")
    classes = stage.save(docs.select(F.col(key).cast("long").alias("id"), content.alias("content")).mapInArrow(
        _blocks(block_bytes, block_rows),
        "cls long, h long, sha string, content binary, bytes long, last long, n long, ids array<long>"), "classes")
    todo, level, verdicts = classes.select(*FIELDS), 0, []
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        left, size = todo.agg(F.count(F.lit(1)), F.sum("bytes")).first()
        if level and not left:
            break
        buckets = max(least if level == 0 else 1, math.ceil((size or 0) / bucket_bytes))
        bucket = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(buckets)).cast("int")
        out = stage.save(todo.repartitionById(buckets, bucket).mapInArrow(_resolve(table_bytes), LEVEL), f"level{level}")
        verdicts.append(out.filter("group_size is not null").select("cls", "keep_id", "group_size", "home"))
        todo, level = out.filter("group_size is null").select(*FIELDS), level + 1
    every = verdicts[0]
    for v in verdicts[1:]:
        every = every.unionByName(v)
    rows = classes.select("cls", F.col("sha").alias("text_sha256"), "ids").join(every, "cls")
    return (rows.select("keep_id", "group_size", "home", "text_sha256", F.posexplode("ids").alias("pos", key))
            .select(key, "keep_id", "group_size", (F.col("home") & (F.col("pos") == 0)).alias("kept"), "text_sha256"))


def op12_grace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"), Stage(spark, "op12"))


SQL = {"op12_grace": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""}
