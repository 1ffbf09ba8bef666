"""New-id selection against a long history (B3): Bloom filters decide which ids can be stored at all.

The history lies in a ``Store``: table ``ids`` hashed into parts, table ``filters`` with the same parts and one row per *page*, a
bitmap of fixed size (32,768 bits, ``HASHES`` bits per id) for the ids whose hash falls on that page. Bitmaps are built by Spark's bitmap
aggregates: partial bitmaps per task are ORed, so a batch of any size sends one bitmap per page and task. A batch meets the filters by a join
on the page; ids with an unset bit are new for certain, and only the others meet the exact anti-join, against those parts of ``ids`` that may hold
one of them. So false positives cost reading, never a wrong row. The number of pages is fixed when the history begins;
at some 3,000 ids a page 1 % of new ids are false positives.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io
from ..sources.store import PART, Commit, Store
from .ingest import dedup_keep_first

PAGE_BITS = 32768               # of Spark's bitmap aggregates
HASHES = 4


class KnownIds:
    """Stored ids below the tables ``ids`` and ``filters`` of a store."""

    def __init__(self, store: Store, key: str = "review_id", pages: int = 1024, parts: int = 64):
        self.store, self.key, self.pages, self.parts = store, key, pages, parts

    def _page(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string"), F.lit(1)), F.lit(self.pages))

    def _part(self, page: Column) -> Column:
        return F.lpad(F.pmod(page, F.lit(self.parts)).cast("string"), len(str(self.parts - 1)), "0")

    def _placed(self, df: DataFrame) -> DataFrame:
        """With _page and part of each row's id. A null id is a key like any other."""
        return df.withColumn("_page", self._page()).withColumn(PART, self._part(F.col("_page")))

    def _bits(self):
        """Positions of an id on its page, by double hashing."""
        key = F.col(self.key).cast("string")
        a, b = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(PAGE_BITS)), F.pmod(F.xxhash64(key, F.lit(3)), F.lit(PAGE_BITS // 2)) * 2 + 1
        return F.array(*[F.pmod(a + b * i, F.lit(PAGE_BITS)) for i in range(HASHES)])

    def add(self, commit: Commit, ids: DataFrame) -> list[str]:
        """Put ids into the history; rewrites only the parts that get one. Visible once the commit is published."""
        new = io.stage(self._placed(ids.select(self.key).distinct()), "new-ids")
        touched = sorted(r[0] for r in new.select(PART).distinct().collect())             # at most ``parts`` names
        bits = new.select("_page", PART, F.explode(self._bits()).alias("_bit"))
        maps = bits.groupBy("_page", PART).agg(F.bitmap_construct_agg(F.col("_bit")).alias("bits"))
        old_maps, old_ids = commit.read("filters", touched), commit.read("ids", touched)
        if old_maps is not None:
            maps = (maps.select("_page", "bits").unionByName(old_maps.select("_page", "bits"))
                    .groupBy("_page").agg(F.bitmap_or_agg("bits").alias("bits")))
        every = new.select(self.key)
        if old_ids is not None:
            every = old_ids.unionByName(every).distinct()
        commit.put("filters", maps.select("_page", "bits"), self._part(F.col("_page")), touched)
        commit.put("ids", every, self._part(self._page()), touched)
        return touched

    def may_be_stored(self, batch: DataFrame) -> DataFrame:
        """``batch`` with _page, its part and ``_maybe``: false only for ids that are not in the history."""
        placed = self._placed(batch)
        filters = self.store.read("filters")
        if filters is None:
            return placed.withColumn("_maybe", F.lit(False))
        j = placed.join(filters.select("_page", "bits"), "_page", "left")
        def is_set(bit: Column) -> Column:
            byte = F.conv(F.hex(F.substr(F.col("bits"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
        hit = F.forall(self._bits(), is_set)
        return j.withColumn("_maybe", F.col("bits").isNotNull() & F.coalesce(hit, F.lit(False))).drop("bits")

    def suspects(self, batch: DataFrame) -> tuple[DataFrame, list[str]]:
        """The marked batch, written once, and the parts of the history that may hold one of its ids."""
        marked = io.stage(self.may_be_stored(batch), "marked")
        return marked, sorted(r[0] for r in marked.where("_maybe").select(PART).distinct().collect())

    def new_rows(self, batch: DataFrame, order: str) -> DataFrame:
        """Rows whose id is not stored yet; of repeats inside the batch the first in ``order`` (as ``ingest.new_reviews``)."""
        marked, parts = self.suspects(batch)
        fresh = marked.where(~F.col("_maybe"))
        if parts:
            maybe = marked.where("_maybe")
            known = self.store.read("ids", parts).select(F.col(self.key).alias("_known"))
            fresh = fresh.unionByName(maybe.join(known, F.col(self.key).eqNullSafe(F.col("_known")), "left_anti"))
        return dedup_keep_first(fresh.select(*batch.columns), order, [self.key], counted=marked)
