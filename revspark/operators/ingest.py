"""Ingest: landing rows from the crawl, de-duplication, new-id selection, the
reviews upsert and its load metrics.

All operators are key-partitioned: de-duplication is a ``min_by``/``max_by``
aggregate per key (partial aggregation, so a hot key is pre-reduced in every map
task), new-id selection is a ``left_anti`` join,
and the upsert is one ``full_outer`` join on review_id. Spark row order is never
used as an order: every keep-first / keep-last takes an explicit order column.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import col
from ..functions.dates import as_date, relative_date
from ..functions.text import strip_ws
from ..sources import io

BUCKETS = 1024                    # of keys, counted to find those that very many rows share
REVIEW_COLS = ("review_id", "product_id", "rating", "review_text", "review_date", "review_size")


def dedup_any(df: DataFrame, keys: Sequence[str] = ("review_id",)) -> DataFrame:
    """Drop duplicates by key, any survivor (as the batch job does)."""
    return df.dropDuplicates(list(keys))


def _keep_one(df: DataFrame, keys: Sequence[str], order: str, last: bool, counted: DataFrame | None = None) -> DataFrame:
    """One row per key: the one with the largest (``last``) or smallest ``order``.
    An aggregate, not a window: map-side partial aggregation keeps one candidate
    per key per task, so a key holding a third of all rows never lands whole in
    one task. The aggregate sorts its rows, on the map side a whole split of them; so where ``counted`` (a frame
    that is cheap to count and has at least the keys of ``df``) shows a large input, its rows are first dealt
    by key into pieces that a task sorts in memory, but for the buckets of such a key."""
    others = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*others), F.col(order))

    def kept(rows):
        return rows.groupBy(*keys).agg(pick.alias("_v")).select(*keys, "_v.*").select(*df.columns)
    n = None if counted is None else io.pieces(df.sparkSession, counted.count())
    if n is None:
        return kept(df)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = dict(counted.groupBy(bucket.alias("b")).count().collect())             # a row per bucket
    crowded = sorted(b for b, k in sizes.items() if k > 2 * sum(sizes.values()) / BUCKETS + io.PIECE_ROWS)
    out = kept(io.dealt(df.where(~bucket.isin(crowded)) if crowded else df, n, *keys))
    return out.unionByName(kept(df.where(bucket.isin(crowded)))) if crowded else out


def dedup_keep_last(df: DataFrame, order: str, keys: Sequence[str] = ("review_id",), counted: DataFrame | None = None) -> DataFrame:
    """Keep the last row per key in ``order`` (arrival order)."""
    return _keep_one(df, keys, order, True, counted)


def dedup_keep_first(df: DataFrame, order: str, keys: Sequence[str] = ("review_id",), counted: DataFrame | None = None) -> DataFrame:
    return _keep_one(df, keys, order, False, counted)


def new_reviews(batch: DataFrame, existing_ids: DataFrame, order: str, key: str = "review_id") -> DataFrame:
    """Rows whose id is not stored yet; among repeats inside the batch the first in
    crawl ``order`` wins (accepted ids join the seen set for later rows)."""
    fresh = batch.join(existing_ids.select(key), key, "left_anti")
    return dedup_keep_first(fresh, order, [key])


# --- landing rows ---------------------------------------------------------------------
def review_date_field(date_text, as_of) -> Column:
    """The crawler's date field: the missing-element sentinel when there is no date
    text, else the converted 'yyyy-MM-dd' (NULL when it cannot be converted)."""
    t = col(date_text)
    return F.when(t.isNull(), F.lit(K.DEFAULT_REVIEW_DATE)).otherwise(
        F.date_format(relative_date(t, as_of), "yyyy-MM-dd"))


def keep_after_cutoff(df: DataFrame, cutoff, date_col: str = "review_date") -> DataFrame:
    """Rows dated on/after ``cutoff`` or carrying the missing-date sentinel; an
    unconvertible (NULL) date drops the row."""
    d = F.col(date_col)
    return df.where((d == K.DEFAULT_REVIEW_DATE) | (d >= F.date_format(as_date(cutoff), "yyyy-MM-dd")))


def pick_size_option(options: Sequence[str]) -> Column:
    """First option (priority order) that ends with ' 구매' after trimming, else the
    default size text."""
    picked = F.lit(K.DEFAULT_REVIEW_SIZE)
    for option in reversed([strip_ws(F.col(c)) for c in options]):
        picked = F.when(option.endswith(K.PURCHASE_SUFFIX), option).otherwise(picked)
    return picked


def landing_rows(raw: DataFrame, as_of, cutoff=None,
                 size_options: Sequence[str] = ("size_opt1", "size_opt2", "size_opt3"),
                 extra: Sequence[str] = ()) -> DataFrame:
    """Crawled fields -> landing rows (all strings): defaults for missing fields,
    converted dates, the picked size option, then the cutoff filter. The row number keeps the filter above the
    conversion: pushed below, it would convert each date once more, its text spelled out at every mention."""
    out = raw.select(
        F.coalesce(F.col("review_id").cast("string"), F.lit(K.DEFAULT_REVIEW_ID)).alias("review_id"),
        F.col("product_id").cast("string").alias("product_id"),
        F.coalesce(F.col("rating"), F.lit(K.DEFAULT_RATING)).alias("rating"),
        F.coalesce(F.col("review_text"), F.lit(K.DEFAULT_REVIEW_TEXT)).alias("review_text"),
        review_date_field("date_text", as_of).alias("review_date"),
        pick_size_option(size_options).alias("review_size"),
        *extra, F.monotonically_increasing_id().alias("_row")).where("_row >= 0")
    if cutoff is not None:
        out = keep_after_cutoff(out, cutoff)
    else:
        out = out.where(F.col("review_date").isNotNull())
    return out.drop("_row")


# --- upsert -----------------------------------------------------------------------------
def typed_batch(landing: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Landing strings -> table types for the upsert. A rating that is no number becomes NULL; an id
    that doesn't fit ``id_type`` raises, as rows without their id would be lost to every later upsert."""
    return landing.select(
        F.col("review_id").cast(id_type).alias("review_id"),
        F.col("product_id").cast(id_type).alias("product_id"),
        F.col("rating").try_cast("double").alias("rating"),
        "review_text", "review_size")


def upsert_reviews(old: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """Insert new ids; on a key hit replace rating, text and size with the incoming
    values (NULL included) and set the date to ``as_of``; the stored product_id
    is kept. Every incoming row is dated ``as_of``. One full outer join."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in REVIEW_COLS])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in ("review_id", "product_id", "rating", "review_text",
                                                         "review_size")], F.lit(True).alias("_hit"))
    j = o.join(n, o["o_review_id"] == n["n_review_id"], "full_outer")
    inc = F.col("_hit").isNotNull()
    pick = lambda c: F.when(inc, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
    return j.select(
        F.coalesce("o_review_id", "n_review_id").alias("review_id"),
        F.coalesce("o_product_id", "n_product_id").alias("product_id"),
        pick("rating").alias("rating"), pick("review_text").alias("review_text"),
        F.when(inc, as_date(as_of)).otherwise(F.col("o_review_date")).alias("review_date"),
        pick("review_size").alias("review_size"))


def upsert_metrics(old: DataFrame, new: DataFrame, pieces: int | None = None) -> DataFrame:
    """One row: before, batch, already existing, unchanged (rating, text and size
    all equal; NULL never equals), after, inserted, and a verdict code. ``pieces``: into how many
    the join deals both sides (``io.pieces`` of their rows)."""
    o = old.select(F.col("review_id").alias("k"), F.col("rating").alias("o_r"),
                   F.col("review_text").alias("o_t"), F.col("review_size").alias("o_s"), F.lit(1).alias("o"))
    n = new.select(F.col("review_id").alias("k"), F.col("rating").alias("n_r"),
                   F.col("review_text").alias("n_t"), F.col("review_size").alias("n_s"), F.lit(1).alias("n"))
    j = io.dealt(o, pieces, "k").join(io.dealt(n, pieces, "k"), "k", "full_outer")
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    same = both & (F.col("o_r") == F.col("n_r")) & (F.col("o_t") == F.col("n_t")) & (F.col("o_s") == F.col("n_s"))
    m = j.agg(F.count_if(F.col("o").isNotNull()).alias("before_count"),
              F.count_if(F.col("n").isNotNull()).alias("batch_count"),
              F.count_if(both).alias("already_existing"),
              F.count_if(F.coalesce(same, F.lit(False))).alias("unchanged"),
              F.count(F.lit(1)).alias("after_count"))
    ins = F.col("after_count") - F.col("before_count")
    verdict = (F.when(ins > 0, F.lit("inserted"))
               .when(F.col("already_existing") == F.col("batch_count"), F.lit("all_existing"))
               .when(F.col("unchanged") == F.col("batch_count"), F.lit("all_unchanged"))
               .otherwise(F.lit("changes_not_inserted")))
    return m.select("*", ins.alias("inserted"), verdict.alias("verdict"))
