"""Reports from a maintained roll-up of the analysis rows.

``cells`` is the partial aggregate: per day, product, category text, sentiment and rating the number of rows (``n``) and of those
with a review id (``ids``). Cells merge by addition, so a batch of changes is the cells of the rows it adds less those of the rows it takes
away, added to the stored cells of the months (or days) it touches; cells that reach 0 go. A product with a third of all rows
has as many cells a day as it has different labels. Week, month and score reports add cells instead of reading sentences; the counts
are exact, and ratings and sentiments are small integers or halves, so their sums are too.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.columns import count_in, is_anomaly, topic_list, ymd
from ..functions.dates import as_date, month_start, week_start
from ..sources import io
from ..sources.store import Commit
from . import scores as S
from .anomalies import DAY, _topics_capped

KEYS = (DAY, "product_id", "category", "sentiment", "rating")
TABLE = "daily_cells"


def cells(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count("review_id").alias("ids"))


def merged(*parts: DataFrame) -> DataFrame:
    """Cells added up; those that reach 0 go."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).where(F.col("n") != 0)


def less(some: DataFrame) -> DataFrame:
    return some.withColumns({"n": -F.col("n"), "ids": -F.col("ids")})


#: a part of the stored cells holds the days of a month, or (for very many cells) one day
GRAINS = {"month": "yyyy-MM", "day": "yyyy-MM-dd"}


def _part(c: Column, grain: str) -> Column:
    return F.coalesce(F.date_format(c, GRAINS[grain]), F.lit("none"))


def apply_changes(commit: Commit, added: DataFrame | None, removed: DataFrame | None = None, table: str = TABLE,
                  grain: str = "month") -> list[str]:
    """Fold analysis rows that come and go into the stored cells; reads and rewrites the parts of the days they touch only."""
    parts = ([cells(added)] if added is not None else []) + ([less(cells(removed))] if removed is not None else [])
    delta = io.stage(merged(*parts), "cells")
    touched = sorted(r[0] for r in delta.select(_part(F.col(DAY), grain).alias("d")).distinct().collect())     # months or days of the batch
    old = commit.read(table, touched)
    if touched or old is None:
        rows = delta.count() + (0 if old is None else old.count())                            # from the files' footers
        spread = max(1, -(-rows // (io.PIECE_ROWS * max(1, len(touched)))))
        commit.put(table, delta if old is None else merged(old, delta), _part(F.col(DAY), grain), touched,
                   spread, io.pieces(delta.sparkSession, rows))
    return touched


def reset_day(commit: Commit, day: str, rows: DataFrame, table: str = TABLE, grain: str = "month") -> None:
    """The day's cells become those of ``rows``, whatever they were."""
    name = day[:7] if grain == "month" else day
    new, old = cells(rows.where(F.col(DAY) == as_date(day))), commit.read(table, [name])
    if old is not None:
        new = new.unionByName(old.where(F.col(DAY) != as_date(day)))
    commit.put(table, new, F.lit(name), [name])


# --- reports ---------------------------------------------------------------------------------
def _count(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))


def week_sentiment_counts(c: DataFrame) -> DataFrame:
    s = F.col("sentiment")
    return (c.groupBy(week_start(DAY).alias("_p")).agg(_count(s == 0).alias("negative_reviews"), _count(s == 1).alias("neutral_reviews"),
                                                       _count(s == 2).alias("positive_reviews"))
            .select(ymd("_p").alias("week_start"), "negative_reviews", "neutral_reviews", "positive_reviews"))


def week_rating_distribution(c: DataFrame, ratings: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    counts = c.groupBy(week_start(DAY).alias("_p")).agg(*(_count(F.col("rating") == float(r)).alias(f"_r{r}") for r in ratings))
    rows = F.array(*(F.struct(F.lit(r).alias("rating"), F.col(f"_r{r}").alias("count")) for r in ratings))
    return counts.select(ymd("_p").alias("week_start"), F.inline(rows))


def week_topic_counts(c: DataFrame, negative_only: bool = False) -> DataFrame:
    if negative_only:
        c = c.where(F.col("sentiment") == 0)
    t = c.select(week_start(DAY).alias("_p"), "n", F.explode(_topics_capped(None, strip_all=True)).alias("topic"))
    return (t.where(F.col("topic").isNotNull() & (F.col("topic") != "")).groupBy("_p", "topic").agg(F.sum("n").alias("count"))
            .select(ymd("_p").alias("week_start"), F.col("topic").alias("category"), "count"))


def week_avg_rating(c: DataFrame) -> DataFrame:
    """Mean of daily means; days whose mean is NULL or 0 are skipped."""
    rated = F.when(F.col("rating").isNotNull(), F.col("n"))
    day = c.groupBy(DAY).agg((F.sum(F.col("rating") * F.col("n")) / F.nullif(F.sum(rated), F.lit(0))).alias("a"))
    ok = F.col("a").isNotNull() & (F.col("a") != 0)
    mean = F.sum(F.when(ok, F.col("a"))) / F.nullif(F.count_if(ok), F.lit(0))
    return (day.groupBy(week_start(DAY).alias("_p")).agg(F.coalesce(mean, F.lit(0.0)).alias("avg_rating"))
            .select(ymd("_p").alias("week_start"), "avg_rating"))


def _month_anomalies(c: DataFrame) -> DataFrame:
    return c.where(is_anomaly()).groupBy(month_start(DAY).alias("_m"), "product_id").agg(F.sum("n").alias("anomaly_count"))


def month_anomaly_products(c: DataFrame, products: DataFrame, top: int = 10) -> DataFrame:
    per = _month_anomalies(c).join(products.select("product_id", "product_name"), "product_id")
    w = Window.partitionBy("_m").orderBy(F.col("anomaly_count").desc(), F.col("product_id"))
    return (per.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(ymd("_m").alias("month_start"), "rank", "product_id", "product_name", "anomaly_count"))


def month_anomaly_categories(c: DataFrame, products: DataFrame, categories: Sequence[str] = K.SHOE_CATEGORIES) -> DataFrame:
    p = products.where(F.col("category").isin(list(categories))).select("product_id", "category")
    return (_month_anomalies(c).join(p, "product_id").groupBy("_m", "category").agg(F.sum("anomaly_count").alias("anomaly_count"))
            .select(ymd("_m").alias("month_start"), "category", "anomaly_count"))


def anomaly_trend(c: DataFrame, exclude_dates: Sequence[str] = K.EXCLUDED_TREND_DATES) -> DataFrame:
    if exclude_dates:
        c = c.where(~F.col(DAY).isin([as_date(x) for x in exclude_dates]))
    return (c.groupBy(DAY).agg(_count(F.col("sentiment") == 0).alias("negative_count"),
                               _count(F.col("rating").isin(1.0, 2.0, 3.0)).alias("low_rating_count"))
            .select(ymd(DAY).alias(DAY), "negative_count", "low_rating_count"))


def product_stats(c: DataFrame, topics: Sequence[str] = K.SCORE_TOPICS, as_of=None) -> DataFrame:
    """The statistics of ``scores.product_stats`` from cells; with ``as_of`` also those of the product profile."""
    n, s, r, d = F.col("n"), F.col("sentiment"), F.col("rating"), F.col(DAY)
    ok = F.col("category").isNotNull() & s.isNotNull()
    lst, sums = topic_list("category"), []
    for i, t in enumerate(topics):
        hits = F.when(ok, count_in(lst, t)).otherwise(0) * n
        sums += [F.sum(hits).alias(f"tc{i}"), F.sum(hits * s).alias(f"ts{i}")]
    if as_of is not None:
        m3, m6 = F.add_months(as_date(as_of), -3), F.add_months(as_date(as_of), -6)
        sums += [F.sum("ids").alias("review_count"), F.sum(r * n).alias("rating_sum"), _count(r.isNotNull()).alias("rating_n"),
                 _count(d >= m3).alias("recent_reviews"), _count(d.between(m6, m3)).alias("past_reviews")]
    return c.groupBy("product_id").agg(F.sum("n").alias("n"), F.sum(s * n).alias("sent_sum"), _count(s >= 0.7).alias("pos_n"), *sums)


def topic_scores(c: DataFrame, products: DataFrame, entity: str = "brand", topics: Sequence[str] = K.SCORE_TOPICS) -> DataFrame:
    return S.topic_scores(c, products, entity, topics, stats=product_stats(c, topics))


def brand_scores(c: DataFrame, products: DataFrame, *, all_brands: bool = True, topics: Sequence[str] = K.SCORE_TOPICS) -> DataFrame:
    return S.brand_scores(c, products, all_brands=all_brands, topics=topics, stats=product_stats(c, topics))


def product_scores(c: DataFrame, products: DataFrame, as_of, topics: Sequence[str] = K.SCORE_TOPICS) -> DataFrame:
    return S.product_scores(c, products, as_of, topics, stats=product_stats(c, topics, as_of))
