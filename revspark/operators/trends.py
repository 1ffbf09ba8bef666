"""Time series over reviews and analysis rows: monthly trend, daily counts under the
five-way filter precedence, and daily sales proxies by category / gender.

Every operator is one grouped aggregation keyed by (entity, period): partial
aggregation runs before the shuffle, so a hot product or brand costs one
pre-aggregated row per map task, not a giant reducer. Date bounds are plain
range predicates on ``review_date``, which reach the Parquet scan as pushed
filters (and partition filters on a date-partitioned table). The product
dimension is joined without a forced broadcast: AQE broadcasts it only when its
measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.columns import ymd
from ..functions.dates import as_date

DAY = "review_date"


def _between(lo, hi) -> Column:
    return F.col(DAY).between(as_date(lo), as_date(hi))


def review_trend_monthly(reviews: DataFrame, as_of, months: int = 18) -> DataFrame:
    """Per product with rows since ``as_of - months``: review counts per 'yyyy-MM'
    on a zero-filled spine of ``months + 1`` calendar months ending at as_of's
    month. Months outside the spine that do have rows (future dates) are kept.
    Products without rows in the window get no rows at all."""
    a = as_date(as_of)
    recent = reviews.where(F.col(DAY) >= F.add_months(a, -months))
    counts = (recent.groupBy("product_id", F.date_format(DAY, "yyyy-MM").alias("review_month"))
              .agg(F.count(F.lit(1)).alias("review_count")))
    first = F.add_months(F.trunc(a, "month"), -months)
    spine_months = F.transform(F.sequence(F.lit(0), F.lit(months)),
                               lambda i: F.date_format(F.add_months(first, i), "yyyy-MM"))
    spine = (counts.select("product_id").distinct()
             .select("product_id", F.explode(spine_months).alias("review_month")))
    return (spine.join(counts, ["product_id", "review_month"], "full_outer")
            .select("product_id", "review_month",
                    F.coalesce("review_count", F.lit(0)).cast("bigint").alias("review_count")))


@dataclass(frozen=True)
class DateFilter:
    """The date-analysis request: any of brand, product, start/end date."""
    start_date: str | None = None
    end_date: str | None = None
    product_id: object = None
    brand: str | None = None


def _clamped(df: DataFrame, clamp) -> DataFrame:
    return df if clamp is None else df.where(_between(*clamp))


def daily_counts_by(analysis: DataFrame, products: DataFrame, by: str | None,
                    start_date=None, end_date=None, clamp=K.DATE_CLAMP) -> DataFrame:
    """Daily analysis-row counts for every brand (``by='brand'``), every product
    (``by='product_id'``) or overall (``by=None``); optional date range (both
    ends needed) and the fixed clamp."""
    a = _clamped(analysis, clamp)
    if start_date and end_date:
        a = a.where(_between(start_date, end_date))
    if by == "brand":          # per (product, day) first; only counts meet the dimension
        per = a.groupBy("product_id", DAY).agg(F.count(F.lit(1)).alias("n"))
        out = (per.join(products.select("product_id", "brand"), "product_id")
               .groupBy("brand", DAY).agg(F.sum("n").alias("count")))
        return out.select("brand", ymd(DAY).alias("date"), "count")
    if by not in ("product_id", None):
        raise ValueError(by)
    keys = [by] if by else []
    out = a.groupBy(*keys, DAY).agg(F.count(F.lit(1)).alias("count"))
    return out.select(*keys, ymd(DAY).alias("date"), "count")


def daily_counts(analysis: DataFrame, products: DataFrame, flt: DateFilter,
                 clamp=K.DATE_CLAMP) -> DataFrame:
    """Filter precedence: brand (+dates), brand, product + dates, product, dates.
    A brand makes the product ignored; a lone start or end date is ignored; no
    usable filter raises ``ValueError``."""
    dates = bool(flt.start_date and flt.end_date)
    rng = (flt.start_date, flt.end_date) if dates else (None, None)
    if flt.brand:
        out = daily_counts_by(analysis.join(products.where(F.col("brand") == flt.brand)
                                            .select("product_id"), "product_id", "left_semi"),
                              products, None, *rng, clamp=clamp)
    elif flt.product_id is not None:
        out = daily_counts_by(analysis.where(F.col("product_id") == F.lit(flt.product_id)),
                              products, None, *rng, clamp=clamp)
    elif dates:
        out = daily_counts_by(analysis, products, None, *rng, clamp=clamp)
    else:
        raise ValueError("a brand, a product id or both dates are required")
    return out.orderBy("date")


def _daily_sales(reviews: DataFrame, products: DataFrame | None, attr: str | None,
                 start_date, end_date, clamp) -> DataFrame:
    r = _clamped(reviews, clamp)
    if start_date and end_date:
        r = r.where(_between(start_date, end_date))
    if attr is None:
        out = r.groupBy(DAY).agg(F.count(F.lit(1)).alias("sales"))
        return out.select(ymd(DAY).alias("date"), "sales")
    per = r.groupBy("product_id", DAY).agg(F.count(F.lit(1)).alias("n"))   # counts meet the dimension
    j = per.join(products.select("product_id", attr), "product_id")
    v = F.col(attr)
    label = F.when(v.isNull() | (v == ""), F.lit(K.FALLBACK_TOPIC)).otherwise(v)
    out = j.groupBy(DAY, label.alias(attr)).agg(F.sum("n").alias("sales"))
    return out.select(ymd(DAY).alias("date"), attr, "sales")


def total_sales(reviews: DataFrame, start_date=None, end_date=None, clamp=K.DATE_CLAMP) -> DataFrame:
    """Daily review counts (the sales proxy)."""
    return _daily_sales(reviews, None, None, start_date, end_date, clamp)


def category_sales(reviews: DataFrame, products: DataFrame, start_date=None, end_date=None,
                   clamp=K.DATE_CLAMP) -> DataFrame:
    """Daily review counts per product category; NULL/blank category -> '기타'."""
    return _daily_sales(reviews, products, "category", start_date, end_date, clamp)


def gender_sales(reviews: DataFrame, products: DataFrame, start_date=None, end_date=None,
                 clamp=K.DATE_CLAMP) -> DataFrame:
    return _daily_sales(reviews, products, "gender", start_date, end_date, clamp)


def nest_by_date(long: DataFrame, key: str, value: str = "sales") -> DataFrame:
    """Sink shape {date: {key: value}}: one map per date. Each map is bounded by the
    number of distinct keys (categories / genders), never by the row count."""
    return long.groupBy("date").agg(F.map_from_entries(F.sort_array(
        F.collect_list(F.struct(F.col(key), F.col(value))))).alias(value))
