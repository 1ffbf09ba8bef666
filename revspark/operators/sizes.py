"""Size analysis: per (product, size) statistics, the size detail report, negative
lists, the most negative sizes, per-product size satisfaction top/bottom 3.

Scale notes: ``size_stats`` is the only pass over the big tables (analysis joined
to reviews on review_id, the one large equi-join, after pruning to size-topic
rows); everything downstream works on its output, which has one row per
(product, size option). The global maximum of D6 is a one-row aggregate joined
back by value (an equi-join with a one-row side), never a window over all rows.
The sentences behind the size report are returned long (one row per product and
distinct sentence), not concatenated into one unbounded string per product.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.columns import round_half_even, topic_list
from ..functions.sizes import normalise_size
from ..sources import io

PRODUCT_COLS = ("product_name", "brand", "category", "gender", "price", "image_url")


def size_stats(analysis: DataFrame, reviews: DataFrame, size_topic: str = K.SIZE_TOPIC, pieces: int | None = None) -> DataFrame:
    """Per (product_id, raw review_size): analysed rows on the size topic, mean
    rating, class counts and the negative share in percent. ``pieces``: into how many the join
    deals both sides (``io.pieces`` of the reviews)."""
    a = (analysis.where(F.array_contains(topic_list("category"), size_topic))
         .select("review_id", "product_id", "sentiment", "rating"))
    r = reviews.select("review_id", "review_size")
    j = io.dealt(a, pieces, "review_id").join(io.dealt(r, pieces, "review_id"), "review_id")
    g = j.groupBy("product_id", "review_size").agg(
        F.count(F.lit(1)).alias("total_reviews"), F.avg("rating").alias("avg_rating"),
        F.count_if(F.col("sentiment") == 2).alias("positive_count"),
        F.count_if(F.col("sentiment") == 1).alias("neutral_count"),
        F.count_if(F.col("sentiment") == 0).alias("negative_count"))
    return g.withColumn("negative_ratio", F.col("negative_count") * 100.0 / F.col("total_reviews"))


def size_detail(stats: DataFrame, products: DataFrame) -> DataFrame:
    """Size statistics with product attributes; review_size normalised."""
    return (stats.join(products.select("product_id", *PRODUCT_COLS), "product_id")
            .select("product_id", normalise_size("review_size").alias("review_size"), "total_reviews",
                    "avg_rating", "negative_ratio", *PRODUCT_COLS))


def size_sentences(analysis: DataFrame, products_with_stats: DataFrame,
                   size_topic: str = K.SIZE_TOPIC) -> DataFrame:
    """Distinct negative/neutral sentences whose category mentions the size topic,
    per product, with the newest review id carrying each (the report lists them
    by that id, descending)."""
    a = (analysis.where(F.col("category").contains(size_topic) & F.col("sentiment").isin(0, 1))
         .join(products_with_stats.select("product_id").distinct(), "product_id", "left_semi"))
    return a.groupBy("product_id", "sentence").agg(F.max("review_id").alias("last_review_id"))


def negative_rows(detail: DataFrame, by: str, threshold: float = K.NEGATIVE_RATIO_THRESHOLD) -> DataFrame:
    """Rows with a negative share >= threshold, grouped (ordered) by ``by``."""
    return detail.where(F.col("negative_ratio") >= threshold).orderBy(by, "product_id", "review_size")


def most_negative_sizes(detail: DataFrame) -> DataFrame:
    """Every row tying the global maximum negative share."""
    mx = detail.agg(F.max("negative_ratio").alias("negative_ratio"))
    return detail.join(mx, "negative_ratio")


def size_mode(rows: DataFrame) -> DataFrame:
    """Most frequent (normalised) size among ``rows``; count desc, size asc on ties;
    'N/A' when there are no rows. One global aggregate over per-size counts, so
    always exactly one row."""
    per = rows.groupBy("review_size").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("review_size", F.struct((-F.col("n")).alias("a"), F.col("review_size").alias("b")))
    return per.agg(F.coalesce(best, F.lit("N/A")).alias("most_frequent_size"))


def size_summary(detail: DataFrame, threshold: float = K.NEGATIVE_RATIO_THRESHOLD) -> DataFrame:
    """One row: rows over the threshold (the category and brand lists hold the same
    rows) and the mode of the most negative sizes. The two one-row aggregates are
    stacked and folded with max, not joined."""
    neg = F.count_if(F.col("negative_ratio") >= threshold)
    counts = detail.agg(neg.alias("c"), F.lit(None).cast("string").alias("m"))
    mode = size_mode(most_negative_sizes(detail)).select(F.lit(None).cast("bigint").alias("c"),
                                                         F.col("most_frequent_size").alias("m"))
    both = counts.unionByName(mode).agg(F.max("c").alias("c"), F.max("m").alias("m"))
    return both.select(F.col("c").alias("category_negative_count"), F.col("c").alias("brand_negative_count"),
                       F.col("m").alias("most_negative_count"), F.col("m").alias("most_frequent_most_negative"))


def size_donut_counts(detail: DataFrame, threshold: float = K.NEGATIVE_RATIO_THRESHOLD) -> DataFrame:
    """Chart counts: rows per category and per brand among those over the threshold
    (one aggregation over (chart, key) pairs), rows per size among the most
    negative (a second pass: the global maximum must be known first)."""
    neg = detail.where(F.col("negative_ratio") >= threshold)
    pairs = F.array(F.struct(F.lit("category").alias("chart"), F.col("category").alias("key")),
                    F.struct(F.lit("brand").alias("chart"), F.col("brand").alias("key")))
    by_attr = (neg.select(F.inline(pairs)).groupBy("chart", "key").agg(F.count(F.lit(1)).alias("count")))
    by_size = (most_negative_sizes(detail).groupBy(F.col("review_size").alias("key"))
               .agg(F.count(F.lit(1)).alias("count")).withColumn("chart", F.lit("size")))
    return by_attr.unionByName(by_size)


def size_satisfaction_topk(stats: DataFrame, k: int = 3) -> DataFrame:
    """Per product: satisfaction (100*pos + 50*neu)/total at 1 dp for each raw size
    (sizes with no rows skipped); the first k and last k of the descending list
    (ties by size ascending), both listed in descending order (they may overlap)."""
    s = stats.where(F.col("total_reviews") != 0).select(
        "product_id", "review_size", "total_reviews",
        round_half_even((F.col("positive_count") * 100 + F.col("neutral_count") * 50) / F.col("total_reviews"), 1)
        .alias("satisfaction_score"))
    desc = Window.partitionBy("product_id").orderBy(F.col("satisfaction_score").desc(), F.col("review_size"))
    asc = Window.partitionBy("product_id").orderBy(F.col("satisfaction_score").asc(), F.col("review_size").desc())
    r = s.select("*", F.row_number().over(desc).alias("pos"), F.row_number().over(asc).alias("_back"))
    kinds = F.filter(F.array(F.when(F.col("pos") <= k, "top"), F.when(F.col("_back") <= k, "bottom")), lambda x: x.isNotNull())
    return (r.where((F.col("pos") <= k) | (F.col("_back") <= k)).withColumn("kind", F.explode(kinds)).drop("_back"))


def split_joined_rows(df: DataFrame, c: str, sep: str = " || ", out: str = "sentence") -> DataFrame:
    """A ' || '-joined text column back to rows; empty / NULL text gives none."""
    import re
    parts = F.split(F.col(c), re.escape(sep))
    return (df.where(F.col(c).isNotNull() & (F.col(c) != ""))
            .select(*[x for x in df.columns if x != c], F.explode(parts).alias(out)))
