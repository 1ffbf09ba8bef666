"""Lookup and search: brand / product name search, existence, product search with
topic scores, and related complaints for every product at once.

Limits here (10 brands, 5 suggestions, 1 exact hit, 50 complaints per product)
are the features themselves. Per-product top-k uses ``row_number() <= k``, which
Spark plans as a WindowGroupLimit: each map task keeps only its k best rows per
product before the shuffle, so even a product holding a third of all rows sends
at most k rows per task to the final window.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.columns import round_half_even, ymd
from ..functions.text import strip_ws


def _icontains(c: str, text: str) -> Column:
    """LIKE '%text%' under a case-insensitive collation (literal match, no wildcards)."""
    return F.lower(F.col(c)).contains(text.lower())


def search_brands(products: DataFrame, query: str, limit: int = 10) -> DataFrame:
    return (products.where(_icontains("brand", query)).select("brand").distinct()
            .orderBy("brand").limit(limit))


def suggest_products(products: DataFrame, query: str, limit: int = 5) -> DataFrame:
    return (products.where(_icontains("product_name", query)).select("product_id", "product_name")
            .orderBy("product_id").limit(limit))


def product_by_name(products: DataFrame, name: str) -> DataFrame:
    return (products.where(F.col("product_name") == name).select("product_id", "product_name")
            .orderBy("product_id").limit(1))


def product_exists(products: DataFrame, requested: DataFrame) -> DataFrame:
    """For each requested ``product_id``: does the product table have it."""
    have = products.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n"))
    return (requested.select("product_id").join(have, "product_id", "left")
            .select("product_id", (F.coalesce("_n", F.lit(0)) > 0).alias("exists")))


def brand_list(products: DataFrame) -> DataFrame:
    return products.select("brand").distinct().orderBy("brand")


def price_number(c: str = "price") -> Column:
    """'1,234,000' -> 1234000 (NULL when not a number)."""
    return F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("bigint")


def _half_up_avg_x50(sum_col: Column, n_col: Column) -> Column:
    """AVG of an integer column as a 4-scale decimal rounded half up (the SQL
    database's AVG), times 50: an exact decimal."""
    avg4 = F.round(sum_col.cast("decimal(38,0)") / n_col.cast("decimal(38,0)"), 4)
    return avg4 * F.lit(50)


def product_search(products: DataFrame, analysis: DataFrame, *, category: str = "",
                   gender: str = "", price_min: int = 0, price_max: int = 99999999,
                   min_reviews: int = 0) -> DataFrame:
    """Products passing the filters with at least ``min_reviews`` analysis rows;
    ``avg_sentiment`` = AVG(sentiment)*50, 2 dp half-even (0 when NULL/zero)."""
    genders = list(K.GENDER_SETS.get(gender, K.ALL_GENDERS))
    p = products.where((F.lit(category) == "") | (F.col("category") == category))
    p = p.where(F.col("gender").isin(genders)).where(price_number().between(price_min, price_max))
    per = (analysis.join(p.select("product_id"), "product_id", "left_semi")
           .groupBy("product_id")
           .agg(F.count("review_id").alias("review_count"),
                F.sum("sentiment").alias("_s"), F.count("sentiment").alias("_n")))
    per = per.where(F.col("review_count") >= min_reviews)
    avg = F.bround(_half_up_avg_x50(F.col("_s"), F.col("_n")), 2).cast("double")
    avg = F.when((F.col("_n") == 0) | (avg == 0), F.lit(0.0)).otherwise(avg)
    return (p.join(per, "product_id")
            .select("product_id", "product_name", "price", "category", "brand", "gender", "image_url",
                    "review_count", avg.alias("avg_sentiment")))


def product_topic_scores(analysis: DataFrame, product_ids: DataFrame) -> DataFrame:
    """(product_id, topic, score) over every comma-separated, stripped label of every
    analysis row of the given products (all labels, including the fallback and
    blanks); score = mean sentiment * 50, 2 dp half-even."""
    a = (analysis.join(product_ids.select("product_id"), "product_id", "left_semi")
         .where(F.col("category").isNotNull() & F.col("sentiment").isNotNull()))
    t = a.select("product_id", "sentiment", F.explode(F.split("category", ",")).alias("topic"))
    return (t.groupBy("product_id", strip_ws(F.col("topic")).alias("topic"))
            .agg(round_half_even(F.sum("sentiment") / F.count(F.lit(1)) * 50, 2).alias("score")))


def product_search_topic(products: DataFrame, analysis: DataFrame, topic: str,
                         min_score: float = K.TOPIC_FILTER_MIN_SCORE, **filters) -> DataFrame:
    """Product search with a topic filter: keep products where ``topic`` scores at
    least ``min_score`` or is the product's best topic."""
    found = product_search(products, analysis, **filters)
    ts = product_topic_scores(analysis, found)
    best = ts.groupBy("product_id").agg(F.max("score").alias("_max"),
                                        F.max(F.when(F.col("topic") == topic, F.col("score"))).alias("topic_score"))
    keep = best.where(F.col("topic_score").isNotNull() &
                      ((F.col("topic_score") >= min_score) | (F.col("topic_score") == F.col("_max"))))
    return found.join(keep.select("product_id", "topic_score"), "product_id").withColumn("topic", F.lit(topic))


def topic_map(scores: DataFrame) -> DataFrame:
    """Sink shape: one {topic: score} map per product (bounded by #labels)."""
    return scores.groupBy("product_id").agg(F.map_from_entries(F.sort_array(
        F.collect_list(F.struct("topic", "score")))).alias("topics"))


def related_reviews(analysis: DataFrame, reviews: DataFrame, limit: int = 50,
                    k_low: int = 3, k_freq: int = 3) -> DataFrame:
    """For every product: pick the raw category strings with the 3 lowest scores and
    the 3 highest frequencies; list negative/neutral reviews whose analysis
    category contains any picked string, by sentiment asc, text length desc
    (review id asc on ties), at most ``limit`` per product."""
    picked = (related_categories(analysis, k_low, k_freq).where(F.col("category").isNotNull())
              .groupBy("product_id").agg(F.collect_set("category").alias("_picked")))
    # Many-to-one join on product_id (one small array per product); AQE splits a
    # hot product's partition of the big side if it is skewed.
    cand = (analysis.where(F.col("sentiment").isin(0, 1))
            .select("review_id", "product_id", "category", "sentiment")
            .join(picked, "product_id")
            .where(F.exists("_picked", lambda c: F.col("category").contains(c))))
    rows = cand.join(reviews.select("review_id", "review_text", "rating", F.col("review_date")), "review_id")
    w = Window.partitionBy("product_id").orderBy(
        F.col("sentiment").asc(), F.char_length("review_text").desc_nulls_last(), F.col("review_id"))
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("product_id", "rank", "review_id", "review_text", "rating", ymd("review_date").alias("review_date"),
                    "sentiment"))


def related_categories(analysis: DataFrame, k_low: int = 3, k_freq: int = 3) -> DataFrame:
    """The picked category strings per product (for inspection / tests)."""
    stats = (analysis.groupBy("product_id", "category")
             .agg(F.round(_half_up_avg_x50(F.sum("sentiment"), F.count("sentiment")), 2).cast("double").alias("score"),
                  F.count(F.lit(1)).alias("freq")))
    by_score = Window.partitionBy("product_id").orderBy(F.col("score").asc_nulls_first(), F.col("category"))
    by_freq = Window.partitionBy("product_id").orderBy(F.col("freq").desc(), F.col("category"))
    return (stats.select("product_id", "category", "score", "freq",
                         F.row_number().over(by_score).alias("_rs"), F.row_number().over(by_freq).alias("_rf"))
            .where((F.col("_rs") <= k_low) | (F.col("_rf") <= k_freq)).drop("_rs", "_rf"))
