"""Topic scores, brand/product scores and rankings (all entities at once).

Scale notes: the analysis table is the big side. Every operator here first
pre-aggregates it by ``product_id`` (map-side partial aggregation, so a hot
product or brand never becomes one giant task), then joins the product
dimension (AQE turns that join into a broadcast only when the runtime size is
under ``spark.sql.autoBroadcastJoinThreshold``), then aggregates per entity.
Topic statistics are computed as six conditional sums in the same pass instead
of an explode + second aggregation, so one scan of the analysis table feeds
everything.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.columns import count_in, grade, round_half_even, topic_list
from ..functions.dates import as_date
from ..sources.io import stage


def _topic_sums(topics: Sequence[str]) -> list[Column]:
    """Per topic: number of topic mentions and their sentiment sum (a row listing a
    topic twice counts twice). Rows with NULL category or sentiment are skipped."""
    ok = F.col("category").isNotNull() & F.col("sentiment").isNotNull()
    lst = topic_list("category")
    out = []
    for i, t in enumerate(topics):
        hits = F.when(ok, count_in(lst, t)).otherwise(0)
        out.append(F.sum(hits).alias(f"tc{i}"))
        out.append(F.sum(hits * F.col("sentiment")).alias(f"ts{i}"))
    return out


def product_stats(analysis: DataFrame, topics: Sequence[str] = K.SCORE_TOPICS, more: Sequence[Column] = ()) -> DataFrame:
    """One row per product: n rows, sentiment sum, rows with sentiment >= 0.7,
    per-topic mention counts / sentiment sums, and the ``more`` aggregates asked for."""
    return (analysis.groupBy("product_id")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum("sentiment").alias("sent_sum"),
                 F.count_if(F.col("sentiment") >= 0.7).alias("pos_n"),
                 *_topic_sums(topics), *more))


def _rollup(stats: DataFrame, key: str, topics: Sequence[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ["n", "sent_sum", "pos_n"] +
            [f"{p}{i}" for i in range(len(topics)) for p in ("tc", "ts")]]
    return stats.groupBy(key).agg(*sums)


def _topic_score(i: int) -> Column:
    c, s = F.col(f"tc{i}"), F.col(f"ts{i}")
    return F.when(c > 0, round_half_even(s / c * 50, 2)).otherwise(F.lit(0.0))


def _with_topic_scores(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    return df.select("*", *[_topic_score(i).alias(f"score{i}") for i in range(len(topics))])


def topic_scores(analysis: DataFrame, products: DataFrame, entity: str = "brand",
                 topics: Sequence[str] = K.SCORE_TOPICS, stats: DataFrame | None = None) -> DataFrame:
    """(entity, topic, score, count) for every entity with analysis rows and every
    topic; topics without mentions get score 0 and count 0. ``stats`` are the product
    statistics where they are known already (here and below)."""
    stats = product_stats(analysis, topics) if stats is None else stats
    if entity == "product_id":
        ent = stats
    else:
        ent = _rollup(stats.join(products.select("product_id", entity), "product_id"), entity, topics)
    ent = _with_topic_scores(ent.where(F.col("n") > 0), topics)
    arr = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"score{i}").alias("score"),
                             F.col(f"tc{i}").cast("bigint").alias("count"))
                    for i, t in enumerate(topics)])
    return ent.select(entity, F.inline(arr))


def _weights(n: Column, pos_ratio: Column, min_topic: Column) -> tuple[Column, Column, Column]:
    w_n = F.when(n < 30, 0.7).when(n < 100, 0.85).when(n < 300, 0.95).otherwise(1.0)
    w_pos = F.when(pos_ratio < 0.3, 0.85).when(pos_ratio < 0.5, 0.95).otherwise(1.0)
    w_topic = F.when(min_topic < 60, 0.8).when(min_topic < 75, 0.9).otherwise(1.0)
    return w_n, w_pos, w_topic


def _cap_round(x: Column) -> Column:
    return F.least(F.lit(100.0), round_half_even(x, 2))


def brand_scores(analysis: DataFrame, products: DataFrame, *, all_brands: bool = True,
                 topics: Sequence[str] = K.SCORE_TOPICS, stats: DataFrame | None = None) -> DataFrame:
    """Brand score = avg sentiment * 50 * w_n * w_pos * w_topic, 2 dp, capped at 100.

    ``all_brands=True`` is the batch re-scoring of every brand: the topic minimum is
    taken over scores > 0 (default 0), and brands without analysis rows score 0.0.
    ``all_brands=False`` is the single-brand page: only brands with rows, the
    minimum over topics with at least one mention; no such topic -> NULL score.
    """
    stats = product_stats(analysis, topics) if stats is None else stats
    prods = products.where(F.col("brand").isNotNull()).select("product_id", "brand")
    how = "left" if all_brands else "inner"
    per = _rollup(prods.join(stats, "product_id", how), "brand", topics)
    per = per.select("brand", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in per.columns if c != "brand"])
    per = _with_topic_scores(per, topics)
    scores = F.array(*[F.col(f"score{i}") for i in range(len(topics))])
    if all_brands:
        min_topic = F.coalesce(F.array_min(F.filter(scores, lambda s: s > 0)), F.lit(0.0))
    else:
        pairs = F.arrays_zip(scores.alias("s"), F.array(*[F.col(f"tc{i}") for i in range(len(topics))]).alias("c"))
        min_topic = F.array_min(F.transform(F.filter(pairs, lambda p: p["c"] > 0), lambda p: p["s"]))
        per = per.where(F.col("n") > 0)
    n = F.col("n")
    avg_sent = F.col("sent_sum") / n * 50
    w_n, w_pos, w_topic = _weights(n, F.col("pos_n") / n, min_topic)
    raw = avg_sent * w_n * w_pos * w_topic
    score = F.when(n == 0, F.lit(0.0)).when(min_topic.isNull(), F.lit(None)).otherwise(_cap_round(raw))
    out = per.select("brand", score.alias("overall_score"), n.cast("bigint").alias("review_count"))
    return out.select("brand", "overall_score",
                      F.when(F.col("overall_score").isNull(), F.lit(None))
                      .otherwise(grade("overall_score")).alias("rating"), "review_count")


def topic_sentiment_pivot(analysis: DataFrame, products: DataFrame,
                          topics: Sequence[str] = K.SCORE_TOPICS,
                          keys: dict = K.SWAPPED_SENTIMENT_KEYS) -> DataFrame:
    """Per brand and topic: counts per sentiment class where the *whole* category
    string equals the topic. ``keys`` names the classes (swapped by default, as
    on the brand page). One conditional aggregation per product (map-side
    combined), then the product dimension, then a roll-up per brand."""
    codes = sorted(keys)
    cell = {(i, k): f"c{i}_{k}" for i in range(len(topics)) for k in codes}
    cat, sen = F.col("category"), F.col("sentiment")
    per_product = analysis.groupBy("product_id").agg(
        *[F.count_if((cat == t) & (sen == k)).alias(cell[(i, k)]) for i, t in enumerate(topics) for k in codes])
    per_brand = (per_product.join(products.select("product_id", "brand"), "product_id")
                 .groupBy("brand").agg(*[F.sum(c).alias(c) for c in cell.values()]))
    rows = F.array(*[F.struct(F.lit(t).alias("topic"),
                              *[F.col(cell[(i, k)]).cast("bigint").alias(keys[k]) for k in codes])
                     for i, t in enumerate(topics)])
    out = per_brand.select("brand", F.inline(rows))
    return out.select("brand", "topic", "positive", "neutral", "negative",
                      (F.col("positive") + F.col("neutral") + F.col("negative")).alias("count"))


def brand_yearly_reviews(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews per brand and calendar year; counted per product first, so only
    (product, year) counts meet the product dimension."""
    per = reviews.groupBy("product_id", F.year("review_date").alias("review_year")).agg(F.count(F.lit(1)).alias("n"))
    return (per.join(products.select("product_id", "brand"), "product_id")
            .groupBy("brand", "review_year").agg(F.sum("n").alias("total_reviews")))


def brand_of_product_score(analysis: DataFrame, products: DataFrame) -> DataFrame:
    """Each product's brand scored as on the single-brand page."""
    bs = brand_scores(analysis, products, all_brands=False)
    return (products.where(F.col("brand").isNotNull()).select("product_id", "brand")
            .join(bs, "brand"))


def _profile_counts(as_of) -> list[Column]:
    a = as_date(as_of)
    m3, m6 = F.add_months(a, -3), F.add_months(a, -6)
    d = F.col("review_date")
    return [F.count("review_id").alias("review_count"), F.sum("rating").alias("rating_sum"),
            F.count("rating").alias("rating_n"), F.count_if(d >= m3).alias("recent_reviews"),
            F.count_if(d.between(m6, m3)).alias("past_reviews")]


def product_profile(analysis: DataFrame, products: DataFrame, as_of) -> DataFrame:
    """Per product (left join): analysed rows, average rating, rows in the last 3
    months and rows between 6 and 3 months ago (the 3-month day counts in both)."""
    per = analysis.groupBy("product_id").agg(*_profile_counts(as_of))
    out = products.join(per, "product_id", "left")
    return out.select("product_id", "product_name", "brand",
                      F.coalesce("review_count", F.lit(0)).alias("review_count"),
                      (F.col("rating_sum") / F.col("rating_n")).alias("avg_rating"),
                      F.coalesce("recent_reviews", F.lit(0)).alias("recent_reviews"),
                      F.coalesce("past_reviews", F.lit(0)).alias("past_reviews"))


def product_scores(analysis: DataFrame, products: DataFrame, as_of,
                   topics: Sequence[str] = K.SCORE_TOPICS, stats: DataFrame | None = None) -> DataFrame:
    """Product score for every product with analysis rows: one aggregation of the analysis table
    (topic sums and profile together) meets the product dimension."""
    stats = product_stats(analysis, topics, _profile_counts(as_of)) if stats is None else stats
    st = _with_topic_scores(stats, topics)
    pairs = F.arrays_zip(F.array(*[F.col(f"score{i}") for i in range(len(topics))]).alias("s"),
                         F.array(*[F.col(f"tc{i}") for i in range(len(topics))]).alias("c"))
    st = st.select("product_id", "n", "sent_sum", "review_count", "recent_reviews", "past_reviews",
                   (F.col("rating_sum") / F.nullif("rating_n", F.lit(0))).alias("avg_rating"),
                   F.array_min(F.transform(F.filter(pairs, lambda p: p["c"] > 0), lambda p: p["s"])).alias("min_topic"))
    j = st.join(products.select("product_id", "product_name", "brand"), "product_id")
    n, rc = F.col("n"), F.col("review_count")
    w1 = F.when(rc < 50, 0.8).when(rc < 150, 0.9).otherwise(1.0)
    w2 = F.when((F.col("past_reviews") > 0) & (F.col("recent_reviews") / F.col("past_reviews") >= 1), 0.9).otherwise(1.0)
    w3 = F.when(F.col("min_topic") <= 80, 0.9).otherwise(1.0)
    ar = F.col("avg_rating")
    w4 = F.when(ar.isNotNull() & (ar != 0) & (ar < 4.7), 0.95).otherwise(1.0)
    raw = F.col("sent_sum") / n * 50 * w1 * w2 * w3 * w4
    score = F.when(F.col("min_topic").isNull(), F.lit(None)).otherwise(_cap_round(raw))
    return j.select("product_id", "product_name", "brand", score.alias("overall_score"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """REPLACE INTO semantics on an immutable table: old rows without a new twin, plus new."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def brand_ranking(brand_scores_df: DataFrame, min_reviews: int = K.MIN_BRAND_REVIEWS) -> DataFrame:
    return (brand_scores_df.where(F.col("review_count") >= min_reviews)
            .orderBy(F.col("overall_score").desc(), F.col("brand")))


def product_ranking(product_scores_df: DataFrame) -> DataFrame:
    return (product_scores_df.where(F.col("overall_score") > 0)
            .orderBy(F.col("overall_score").desc(), F.col("product_id")))


def _ends(df: DataFrame, key: str, kind: str, k: int) -> DataFrame:
    top = df.orderBy(F.col("overall_score").desc(), F.col(key).asc()).limit(k)
    bottom = df.orderBy(F.col("overall_score").asc(), F.col(key).desc()).limit(k)
    w_top = Window.orderBy(F.col("overall_score").desc(), F.col(key).asc())
    return (top.withColumn("pos", F.row_number().over(w_top)).withColumn("kind", F.lit(f"top_{kind}"))
            .unionByName(bottom.withColumn("pos", F.row_number().over(w_top))
                         .withColumn("kind", F.lit(f"bottom_{kind}"))))


def rankings_top_bottom(brand_scores_df: DataFrame, product_scores_df: DataFrame, k: int = 3,
                        min_reviews: int = K.MIN_BRAND_REVIEWS) -> DataFrame:
    """Top k and bottom k (bottom listed in descending order) of both rankings.
    Each score table (a row per entity) is written once, as both ends read it; each side is a
    TakeOrderedAndProject and the window only numbers k rows."""
    b = brand_scores_df.where(F.col("review_count") >= min_reviews).select(
        F.col("brand").alias("key"), "overall_score")
    p = product_scores_df.where(F.col("overall_score") > 0).select(
        F.col("product_id").cast("string").alias("key"), "overall_score")
    return _ends(stage(b, "brand-ends"), "key", "brands", k).unionByName(_ends(stage(p, "product-ends"), "key", "products", k))
