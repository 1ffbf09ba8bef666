"""Anomaly analytics over the daily analysis rows: day, week and month reports for
all days / weeks / months at once (``as_of`` filters are plain partition filters).

Every report is a grouped aggregation keyed by the period, so it partitions by
period (and entity), pre-aggregates map-side, and never funnels one period into
one task except for the final, already-aggregated rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.columns import code_label, is_anomaly, round_half_even, ymd
from ..functions.dates import as_date, month_start, week_start
from ..functions.text import WS

DAY = "review_date"


def _period(df: DataFrame, period: str) -> tuple[DataFrame, str]:
    if period == "day":
        return df.withColumn("_p", F.col(DAY)), "review_date"
    if period == "week":
        return df.withColumn("_p", week_start(DAY)), "week_start"
    if period == "month":
        return df.withColumn("_p", month_start(DAY)), "month_start"
    raise ValueError(period)


def in_week_of(df: DataFrame, day) -> DataFrame:
    """Monday..Sunday of ``day``'s week: a range filter the scan can prune on."""
    mon = F.to_date(F.date_trunc("week", as_date(day)))
    return df.where(F.col(DAY).between(mon, F.date_add(mon, 6)))


def sentiment_counts(daily: DataFrame, period: str = "day") -> DataFrame:
    d, name = _period(daily, period)
    return (d.groupBy("_p").agg(F.count_if(F.col("sentiment") == 0).alias("negative_reviews"),
                                F.count_if(F.col("sentiment") == 1).alias("neutral_reviews"),
                                F.count_if(F.col("sentiment") == 2).alias("positive_reviews"))
            .select(ymd("_p").alias(name), "negative_reviews", "neutral_reviews", "positive_reviews"))


def rating_distribution(daily: DataFrame) -> DataFrame:
    """Per day, rating truncated to int -> count (NULL ratings skipped)."""
    return (daily.where(F.col("rating").isNotNull())
            .groupBy(DAY, F.col("rating").cast("int").alias("rating")).agg(F.count(F.lit(1)).alias("count"))
            .select(ymd(DAY).alias(DAY), "rating", "count"))


def avg_rating(daily: DataFrame) -> DataFrame:
    return (daily.groupBy(DAY).agg(F.coalesce(F.avg("rating"), F.lit(0.0)).alias("avg_rating"))
            .select(ymd(DAY).alias(DAY), "avg_rating"))


def _topics_capped(cap: int | None, strip_all: bool) -> Column:
    """Topics of a row: the day report reads at most ``cap`` parts and trims spaces,
    the week report strips all whitespace. Trimming the whole string and splitting
    on a separator that swallows the surrounding blanks equals trimming each part,
    with no per-element lambda."""
    if strip_all:
        parts = F.split(F.regexp_replace(F.col("category"), f"^[{WS}]+|[{WS}]+$", ""), f"[{WS}]*,[{WS}]*")
    else:
        parts = F.split(F.trim(F.col("category")), " *, *")
    return F.slice(parts, 1, cap) if cap is not None else parts


def topic_counts(daily: DataFrame, period: str = "day", cap: int | None = 5,
                 negative_only: bool = False) -> DataFrame:
    """Per period and topic: mentions. The day report reads at most ``cap`` topics
    per row and trims spaces; the week report (cap=None) strips all whitespace."""
    d, name = _period(daily, period)
    if negative_only:
        d = d.where(F.col("sentiment") == 0)
    t = d.select("_p", F.explode(_topics_capped(cap, strip_all=cap is None)).alias("category"))
    return (t.where(F.col("category").isNotNull() & (F.col("category") != ""))
            .groupBy("_p", "category").agg(F.count(F.lit(1)).alias("count"))
            .select(ymd("_p").alias(name), "category", "count"))


def negative_reviews(daily: DataFrame) -> DataFrame:
    return daily.where(F.col("sentiment") == 0).select(
        "review_id", "product_id", "sentence", "category", ymd(DAY).alias(DAY), "rating", "sentiment")


ANOMALY_COLS = ("review_id", "product_id", "product_name", "brand", "price", "image_url", "sentence", "category",
                DAY, "rating", "sentiment")


def anomaly_rows(daily: DataFrame, products: DataFrame) -> DataFrame:
    """Anomalous rows with product attributes (inner); reports that need no size read the
    review table not at all."""
    p = products.select("product_id", "product_name", "brand", "price", "image_url")
    return daily.where(is_anomaly()).join(p, "product_id").select(*ANOMALY_COLS)


def anomaly_reviews(daily: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    """``anomaly_rows`` with the review's size: one left join by review id (two columns of the
    review table are shuffled; each table is scanned once)."""
    sizes = reviews.select("review_id", "review_size")
    return anomaly_rows(daily, products).join(sizes, "review_id", "left").select(*ANOMALY_COLS, "review_size")


def week_rating_distribution(daily: DataFrame, ratings: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    d, name = _period(daily, "week")
    return _rating_counts(d, F.col("_p"), name, ratings, lambda r: F.col("rating") == float(r))


def _rating_counts(df: DataFrame, group: Column, name: str, ratings: Sequence[int], is_rating) -> DataFrame:
    """One row per group and rating, absent ratings with 0: one conditional aggregation."""
    counts = df.groupBy(group.alias("_g")).agg(*(F.count_if(is_rating(r)).alias(f"_r{r}") for r in ratings))
    rows = F.array(*(F.struct(F.lit(r).alias("rating"), F.col(f"_r{r}").alias("count")) for r in ratings))
    return counts.select(ymd("_g").alias(name), F.inline(rows))


def week_avg_rating(daily: DataFrame) -> DataFrame:
    """Mean of daily means; days whose mean is NULL or 0 are skipped."""
    per_day = daily.groupBy(DAY).agg(F.avg("rating").alias("a"))
    d, name = _period(per_day, "week")
    ok = F.col("a").isNotNull() & (F.col("a") != 0)
    mean = F.sum(F.when(ok, F.col("a"))) / F.nullif(F.count_if(ok), F.lit(0))
    return (d.groupBy("_p").agg(F.coalesce(mean, F.lit(0.0)).alias("avg_rating"))
            .select(ymd("_p").alias(name), "avg_rating"))


def week_anomaly_reviews(daily: DataFrame, products: DataFrame, reviews: DataFrame) -> DataFrame:
    a = anomaly_reviews(daily, products, reviews)
    return a.select(ymd(week_start(DAY)).alias("week_start"), *[ymd(c).alias(c) if c == DAY else c for c in a.columns])


def month_anomaly_products(daily: DataFrame, products: DataFrame, top: int = 10) -> DataFrame:
    """Per month, the ``top`` products by anomalous rows (count desc, id asc)."""
    a = daily.where(is_anomaly()).withColumn("_m", month_start(DAY))
    per = (a.groupBy("_m", "product_id").agg(F.count(F.lit(1)).alias("anomaly_count"))
           .join(products.select("product_id", "product_name"), "product_id"))
    w = Window.partitionBy("_m").orderBy(F.col("anomaly_count").desc(), F.col("product_id"))
    return (per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(ymd("_m").alias("month_start"), "rank", "product_id", "product_name", "anomaly_count"))


def month_anomaly_categories(daily: DataFrame, products: DataFrame,
                             categories: Sequence[str] = K.SHOE_CATEGORIES) -> DataFrame:
    a = (daily.where(is_anomaly()).groupBy(month_start(DAY).alias("_m"), "product_id")
         .agg(F.count(F.lit(1)).alias("n")))                       # counts meet the dimension
    p = products.where(F.col("category").isin(list(categories))).select("product_id", "category")
    return (a.join(p, "product_id").groupBy("_m", "category").agg(F.sum("n").alias("anomaly_count"))
            .select(ymd("_m").alias("month_start"), "category", "anomaly_count"))


def anomaly_trend(daily: DataFrame, exclude_dates: Sequence[str] = K.EXCLUDED_TREND_DATES) -> DataFrame:
    """Per day: negative rows and 1-3 rated rows; listed dates excluded."""
    d = daily
    if exclude_dates:
        d = d.where(~F.col(DAY).isin([as_date(x) for x in exclude_dates]))
    return (d.groupBy(DAY).agg(F.count_if(F.col("sentiment") == 0).alias("negative_count"),
                               F.count_if(F.col("rating").isin(1.0, 2.0, 3.0)).alias("low_rating_count"))
            .select(ymd(DAY).alias(DAY), "negative_count", "low_rating_count"))


def sentiment_share(daily: DataFrame) -> DataFrame:
    """Per day and class: count and percent share (1 dp; NULL when the day total is 0)."""
    c = daily.where(F.col("sentiment").isin(0, 1, 2)).groupBy(DAY, "sentiment").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(DAY))
    return c.select(ymd(DAY).alias(DAY), "sentiment", "n",
                    F.when(tot == 0, F.lit(None)).otherwise(round_half_even(F.col("n") / tot * 100, 1)).alias("share"))


def anomaly_by_product(anomalies: DataFrame) -> DataFrame:
    """Group anomaly rows per day and product: product attributes and the total.
    The reviews themselves stay as rows (``anomaly_reviews``), never one list per
    product, so a product with a flood of anomalies is not one giant value."""
    return (anomalies.groupBy(F.col(DAY), "product_id", "product_name", "brand", "price", "image_url")
            .agg(F.count(F.lit(1)).alias("total_reviews"))
            .withColumn(DAY, ymd(DAY)))


def topic_total_vs_negative(daily: DataFrame, cap: int | None = 5) -> DataFrame:
    t = daily.select(DAY, "sentiment", F.explode(_topics_capped(cap, strip_all=cap is None)).alias("category"))
    return (t.where(F.col("category").isNotNull() & (F.col("category") != ""))
            .groupBy(DAY, "category").agg(F.count(F.lit(1)).alias("total"),
                                          F.count_if(F.col("sentiment") == 0).alias("negative"))
            .select(ymd(DAY).alias(DAY), "category", "total", "negative"))


def rating_vector(daily: DataFrame, ratings: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    return _rating_counts(daily, F.col(DAY), DAY, ratings, lambda r: F.col("rating").cast("int") == r)


def _js_number(c: Column) -> Column:
    """A double as a browser prints it (4.0 -> '4')."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def anomaly_detail(anomalies: DataFrame) -> DataFrame:
    r, s, z = F.col("rating"), F.col("sentence"), F.col("review_size")
    blank = lambda c: c.isNull() | (c == "")
    return anomalies.select(
        "review_id", "product_id",
        F.when(r.isNull() | (r == 0), F.lit(K.DETAIL_DEFAULTS["rating"])).otherwise(_js_number(r)).alias("rating_text"),
        F.when(blank(s), F.lit(K.DETAIL_DEFAULTS["sentence"])).otherwise(s).alias("sentence_text"),
        F.when(blank(z), F.lit(K.DETAIL_DEFAULTS["review_size"])).otherwise(z).alias("size_text"),
        F.coalesce(ymd(DAY), F.lit(K.DETAIL_DEFAULTS["review_date"])).alias("date_text"),
        code_label("sentiment", K.DETAIL_SENTIMENT_LABELS, "").alias("sentiment_text"))


def product_report_facts(anomalies: DataFrame, period: str = "week", top: int = 5) -> DataFrame:
    """Per period and product: n, class counts, average rating (missing ratings add
    0 but stay in the denominator), and the top topics as 'label(n회)'."""
    a, name = _period(anomalies, period)
    r = F.col("rating")
    facts = a.groupBy("_p", "product_id").agg(
        F.min("product_name").alias("product_name"),
        F.count(F.lit(1)).alias("n_reviews"),
        F.count_if(F.col("sentiment") == 0).alias("negative"),
        F.count_if(F.col("sentiment") == 1).alias("neutral"),
        F.count_if(F.col("sentiment") == 2).alias("positive"),
        round_half_even(F.sum(F.when(r.isNotNull() & (r != 0), r).otherwise(0.0)) / F.count(F.lit(1)), 2).alias("avg_rating"))
    t = (a.select("_p", "product_id", F.explode(_topics_capped(None, strip_all=True)).alias("topic"))
         .where(F.col("topic") != "")
         .groupBy("_p", "product_id", "topic").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("_p", "product_id").orderBy(F.col("n").desc(), F.col("topic"))
    t = t.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= top)
    top_txt = (t.groupBy("_p", "product_id")
               .agg(F.sort_array(F.collect_list(F.struct("rk", F.format_string("%s(%d" + K.TIMES_SUFFIX + ")",
                                                                               "topic", "n").alias("s")))).alias("l"))
               .select("_p", "product_id", F.array_join(F.transform("l", lambda x: x["s"]), ", ").alias("top_topics")))
    return (facts.join(top_txt, ["_p", "product_id"], "left")
            .select(ymd("_p").alias(name), "product_id", "product_name", "n_reviews", "negative", "neutral",
                    "positive", "avg_rating", F.coalesce("top_topics", F.lit("")).alias("top_topics")))


def product_report_lines(anomalies: DataFrame, period: str = "week") -> DataFrame:
    """One formatted line per anomalous review of each (period, product) with its
    sort keys (date desc, review id, sentence). The prompt text is assembled at
    the sink from a sorted scan; no per-product window or list, so a product with
    a third of all rows is still split over many tasks by the range sort."""
    a, name = _period(anomalies, period)
    label = code_label("sentiment", K.SENTIMENT_LABELS, K.UNKNOWN_SENTIMENT_LABEL)
    line = F.format_string('- "%s" (평점: %s, 감성: %s)', F.col("sentence"), F.col("rating").cast("string"), label)
    return a.select(ymd("_p").alias(name), "product_id", ymd(DAY).alias(DAY), "review_id", "sentence",
                    line.alias("line"))


def sorted_report_lines(lines: DataFrame, period_col: str = "week_start") -> DataFrame:
    """Lines in prompt order: a global range-partitioned sort."""
    return lines.orderBy(period_col, "product_id", F.col(DAY).desc(), "review_id", "sentence")


def month_report_lines(daily: DataFrame, products: DataFrame,
                       categories: Sequence[str] = K.SHOE_CATEGORIES,
                       exclude_dates: Sequence[str] = K.EXCLUDED_TREND_DATES, top: int = 10) -> DataFrame:
    """Per month, the three text sections of the monthly report (trend, categories,
    top products); every section is a bounded list (<= 31, #categories, ``top``)."""
    tr = anomaly_trend(daily, exclude_dates).withColumn("_m", F.substring(DAY, 1, 7))
    tr_l = tr.select("_m", F.struct(F.col(DAY).alias("k1"), F.lit(0).alias("k2"), F.lit("").alias("k3"),
                                    F.format_string("- %s: 부정 리뷰 %d건, 저평점 %d건", DAY, "negative_count",
                                                    "low_rating_count").alias("s")).alias("e"), F.lit("trend").alias("sec"))
    ca = month_anomaly_categories(daily, products, categories).withColumn("_m", F.substring("month_start", 1, 7))
    ca_l = ca.select("_m", F.struct(F.lit("").alias("k1"), (-F.col("anomaly_count")).alias("k2"), F.col("category").alias("k3"),
                                    F.format_string("- %s: %d건", "category", "anomaly_count").alias("s")).alias("e"),
                     F.lit("category").alias("sec"))
    pr = month_anomaly_products(daily, products, top).withColumn("_m", F.substring("month_start", 1, 7))
    pr_l = pr.select("_m", F.struct(F.lit("").alias("k1"), F.col("rank").alias("k2"), F.lit("").alias("k3"),
                                    F.format_string("- %s (ID: %s): %d건", "product_name", F.col("product_id").cast("string"),
                                                    "anomaly_count").alias("s")).alias("e"), F.lit("product").alias("sec"))
    allp = tr_l.unionByName(ca_l).unionByName(pr_l)
    g = allp.groupBy("_m").agg(*[
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("sec") == s, F.col("e")))), lambda x: x["s"]), "\n").alias(f"{s}_text")
        for s in ("trend", "category", "product")])
    heading = F.format_string("[%d년 %d월] 이상 감지 리뷰 통계 분석", F.substring("_m", 1, 4).cast("int"),
                              F.substring("_m", 6, 2).cast("int"))
    return g.select(F.col("_m").alias("month"), heading.alias("heading"), "trend_text", "category_text", "product_text")
