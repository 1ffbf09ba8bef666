"""Tables that change by whole parts and become visible together.

A store is a folder with tables, each cut into named parts (a hash bucket of its key, or a day). A part is a folder of
Parquet files below ``data/<table>/v=<version>/_part=<name>``; a manifest ``manifests/<version>.json`` says which version holds
each part of each table. A commit writes the parts that it changes under the next version, then its manifest aside, and publishes
all of them by one rename of that file. Readers take the newest manifest, so they see all tables as of one commit; parts that a
commit doesn't touch keep their files.

A driver lost before the rename leaves the old state (files of the unpublished version are removed when it is written
again); lost after it, the new one. A commit carries a batch id and a small result; ``result_of`` gives back the
result of a batch that was published, so a replayed batch changes nothing and answers as it did first.

One writer at a time. ``vacuum`` removes parts that none of the newest manifests names.
"""
from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import io

PART = "_part"
SLOTS = 256                         # of a bucket, counted to deal its rows


def bucket_of(key, buckets: int) -> Column:
    """Name of the part that holds a key (string keys and numbers alike; null keys in one part)."""
    return _bucket_name(_hashed(key, buckets), buckets)


def _hashed(key, n: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n))


def _bucket_name(bucket: Column, buckets: int) -> Column:
    return F.lpad(bucket.cast("string"), len(str(buckets - 1)), "0")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- manifests ------------------------------------------------------------------------
    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return [int(n[:-5]) for n in io.folder_names(self.spark, f"{self.root}/manifests") if n.endswith(".json") and not n.startswith("_")]

    def manifest(self, version: int | None = None) -> dict:
        """tables: {name: {schema, parts: {part: version}}}; of the newest version by default."""
        if version is None:
            version = max(self.versions(), default=None)
        if version is None:
            return {"version": 0, "tables": {}}
        return json.loads(io.read_text(self.spark, f"{self.root}/manifests/{version:012d}.json"))

    def result_of(self, batch: str) -> dict | None:
        """The result that this batch was published with; None if it wasn't."""
        path = f"{self.root}/batches/{_name(batch)}.json"
        if not io.table_exists(self.spark, path):
            return None
        noted = json.loads(io.read_text(self.spark, path))
        if noted["final"]:
            return noted["result"]
        if noted["version"] not in self.versions() or self.manifest(noted["version"])["batch"] != batch:
            return None                            # written before a rename that never came
        return noted["result"]

    # --- reads ----------------------------------------------------------------------------
    def read(self, table: str, parts: Sequence[str] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The table as of the newest commit (or of ``manifest``), or those parts of it; None if there is no such table."""
        entry = (manifest or self.manifest())["tables"].get(table)
        if entry is None:
            return None
        names = entry["parts"] if parts is None else {p: entry["parts"][p] for p in parts if p in entry["parts"]}
        schema = StructType.fromJson(entry["schema"])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.part_path(table, p, v) for p, v in sorted(names.items())])

    def part_path(self, table: str, part: str, version: int) -> str:
        return f"{self.root}/data/{table}/v={version}/{PART}={part}"

    # --- writes ---------------------------------------------------------------------------
    def begin(self, batch: str) -> Commit:
        return Commit(self, batch)

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests older than the newest ``keep``, and versions' parts that no kept manifest names."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        live: dict = {}
        for v in kept:
            for table, entry in self.manifest(v)["tables"].items():
                live.setdefault(table, set()).update((p, n) for p, n in entry["parts"].items())
        for table in io.folder_names(self.spark, f"{self.root}/data"):
            for folder in io.folder_names(self.spark, f"{self.root}/data/{table}"):
                v = int(folder[2:])
                if v > max(kept, default=0):
                    continue                       # a commit that is being written
                for part in io.folder_names(self.spark, f"{self.root}/data/{table}/{folder}"):
                    if part.startswith(PART) and (part[len(PART) + 1:], v) not in live.get(table, set()):
                        io.remove(self.spark, f"{self.root}/data/{table}/{folder}/{part}")
        for v in old:
            m = self.manifest(v)                   # its batch was published: say so for good
            _note(self, m["batch"], v, m["result"], final=True)
            io.remove(self.spark, f"{self.root}/manifests/{v:012d}.json")


class Commit:
    """Changes of several tables that ``publish`` makes visible together."""

    def __init__(self, store: Store, batch: str):
        self.store, self.batch, self.base = store, batch, store.manifest()
        self.version = self.base["version"] + 1
        self.tables = {t: {"schema": e["schema"], "parts": dict(e["parts"])} for t, e in self.base["tables"].items()}

    def read(self, table: str, parts: Sequence[str] | None = None) -> DataFrame | None:
        """The table as this commit has it so far."""
        return self.store.read(table, parts, {"tables": self.tables})

    def put(self, table: str, df: DataFrame, part: Column, replaces: Sequence[str] = (), spread: int = 1,
            pieces: int | None = None) -> None:
        """Write ``df``'s parts under the new version. Parts named in ``replaces`` go if ``df`` has no row for
        them; all others stay as they are. ``spread`` tasks write each part (for parts that may be large);
        ``pieces`` is into how many the rows are dealt (``io.pieces``)."""
        deal = [PART] if spread == 1 else [PART, F.pmod(F.xxhash64(*df.columns), F.lit(spread))]
        rows = df.withColumn(PART, part)
        self._write(table, rows.repartition(*deal) if pieces is None else io.dealt(rows, pieces, *deal), replaces)

    def _write(self, table: str, rows: DataFrame, replaces: Sequence[str]) -> None:
        """``put`` of rows with their part, as they lie."""
        path = f"{self.store.root}/data/{table}/v={self.version}"
        schema = rows.drop(PART).schema
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy(PART).parquet(path)
        written = [n[len(PART) + 1:] for n in io.folder_names(self.store.spark, path) if n.startswith(PART)]
        entry = self.tables.setdefault(table, {"schema": schema.jsonValue(), "parts": {}})
        entry["schema"] = schema.jsonValue()
        for p in replaces:
            entry["parts"].pop(p, None)
        entry["parts"].update({p: self.version for p in written})

    def merge(self, table: str, batch: DataFrame, key: str, buckets: int, merge) -> list[str]:
        """Merge a batch into a table hashed by ``key``: reads and rewrites only the buckets that the batch
        touches. ``merge(old or None, batch)`` gives their new rows. Returns the touched parts."""
        of = bucket_of(key, buckets)
        touched = sorted(r[0] for r in batch.select(of.alias("p")).distinct().collect())      # at most ``buckets`` names
        old = self.read(table, touched)
        if touched or old is None:
            self.put(table, merge(old, batch), of, touched)
        return touched

    def reduce(self, table: str, batch: DataFrame, key: str, buckets: int, reduce) -> list[str]:
        """``merge`` for a reduction by key: ``reduce(rows, keys)`` gives the rows that stay of old and new ones together, by an
        aggregate over ``keys`` (the key and columns that follow from it). Rows are sent once, into pieces of the buckets that a
        task sorts in its memory, and are reduced and written there; only those of a slot that very many rows of
        the batch share (a key of a third of them) are reduced within their tasks first."""
        slot = _hashed(key, buckets * SLOTS)                    # its remainder is the bucket
        sizes = dict(batch.groupBy(slot.alias("s")).count().collect())                       # a row per slot
        width = len(str(buckets - 1))
        touched = sorted({f"{s % buckets:0{width}d}" for s in sizes})
        old = self.read(table, touched)
        if not touched and old is not None:
            return touched
        rows, n = batch, sum(sizes.values())
        if old is not None:
            rows, n = old.unionByName(batch, allowMissingColumns=True), n + old.count()      # from file footers
        spread = min(SLOTS, max(1, -(-n // (max(1, len(touched)) * io.PIECE_ROWS))))
        crowded = sorted(s for s, k in sizes.items() if k > 2 * n / (buckets * SLOTS) + io.PIECE_ROWS)
        piece = (F.col("_slot") % buckets * spread + F.floor(F.col("_slot") / buckets) % spread).cast("int")
        placed = rows.withColumn("_slot", slot).withColumn(PART, _bucket_name(F.col("_slot") % buckets, buckets)).withColumn("_piece", piece)
        even = placed.where(~F.col("_slot").isin(crowded)) if crowded else placed
        keys = [PART, "_piece", key]
        out = reduce(even.drop("_slot").repartitionById(buckets * spread, F.col("_piece")), keys)
        if crowded:
            out = out.unionByName(reduce(placed.where(F.col("_slot").isin(crowded)).drop("_slot"), keys))
        self._write(table, out.drop("_piece"), touched)
        return touched

    def publish(self, result: dict | None = None) -> None:
        """The one step that makes everything visible: a rename of the manifest."""
        store = self.store
        _note(store, self.batch, self.version, result, final=False)
        aside = f"{store.root}/manifests/_next-{uuid.uuid4().hex}"
        io.write_text(store.spark, aside, json.dumps(
            {"version": self.version, "batch": self.batch, "result": result, "tables": self.tables}))
        target = f"{store.root}/manifests/{self.version:012d}.json"
        if io.table_exists(store.spark, target):
            raise RuntimeError(f"version {self.version} of {store.root} was published by another writer")
        io.rename(store.spark, aside, target)


def _note(store: Store, batch: str, version: int, result: dict | None, final: bool) -> None:
    io.write_text(store.spark, f"{store.root}/batches/{_name(batch)}.json",
                  json.dumps({"batch": batch, "version": version, "result": result, "final": final}))


def _name(batch: str) -> str:
    return hashlib.sha256(batch.encode()).hexdigest()[:32]
