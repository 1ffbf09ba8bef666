"""Registered time-series queries."""
from __future__ import annotations

import datetime as dt

from ..operators import trends as T
from ..sources import fixture
from .params import AS_OF, DATE_CLAMP_TEST, JULY_2001
from .registry import register

CL = f"BETWEEN DATE '{DATE_CLAMP_TEST[0]}' AND DATE '{DATE_CLAMP_TEST[1]}'"
JU = f"BETWEEN DATE '{JULY_2001[0]}' AND DATE '{JULY_2001[1]}'"
D = "strftime(review_date, '%Y-%m-%d')"


def _first_month(as_of: str, months: int) -> str:
    d = dt.date.fromisoformat(as_of)
    m = d.year * 12 + d.month - 1 - months
    return f"{m // 12:04d}-{m % 12 + 1:02d}-01"


@register("review_trend_monthly", f"""
 c AS (SELECT product_id, strftime(review_date, '%Y-%m') AS review_month, count(*) AS review_count FROM reviews
       WHERE review_date >= DATE '{AS_OF}' - INTERVAL 18 MONTH GROUP BY 1, 2),
 months AS (SELECT strftime(CAST(DATE '{_first_month(AS_OF, 18)}' + to_months(CAST(i AS INTEGER)) AS DATE), '%Y-%m') AS review_month
            FROM range(0, 19) t(i)),
 spine AS (SELECT product_id, review_month FROM (SELECT DISTINCT product_id FROM c) p, months)
SELECT coalesce(s.product_id, c.product_id) AS product_id, coalesce(s.review_month, c.review_month) AS review_month,
       CAST(coalesce(c.review_count, 0) AS BIGINT) AS review_count
FROM spine s FULL OUTER JOIN c ON s.product_id = c.product_id AND s.review_month = c.review_month""")
def q_review_trend_monthly(spark, sf):
    return T.review_trend_monthly(fixture(spark, sf).reviews, AS_OF)


def _daily_sql(by: str | None, dates: bool) -> str:
    key = {"brand": "p.brand, ", "product_id": "a.product_id, ", None: ""}[by]
    join = "JOIN products p ON a.product_id = p.product_id" if by == "brand" else ""
    rng = f"AND a.review_date {JU}" if dates else ""
    n = 2 if by else 1
    return f"""
SELECT {key}strftime(a.review_date, '%Y-%m-%d') AS date, count(*) AS count
FROM review_analysis a {join} WHERE a.review_date {CL} {rng} GROUP BY {', '.join(str(i + 1) for i in range(n))}"""


def _daily(by, dates):
    def q(spark, sf):
        fx = fixture(spark, sf)
        rng = JULY_2001 if dates else (None, None)
        return T.daily_counts_by(fx.review_analysis, fx.products, by, *rng, clamp=DATE_CLAMP_TEST)
    return q


register("daily_reviews_brand_dates", _daily_sql("brand", True))(_daily("brand", True))
register("daily_reviews_brand", _daily_sql("brand", False))(_daily("brand", False))
register("daily_reviews_product_dates", _daily_sql("product_id", True))(_daily("product_id", True))
register("daily_reviews_product", _daily_sql("product_id", False))(_daily("product_id", False))
register("daily_reviews_dates", _daily_sql(None, True))(_daily(None, True))


@register("daily_reviews_filter_precedence", f"""
SELECT strftime(a.review_date, '%Y-%m-%d') AS date, count(*) AS count
FROM review_analysis a WHERE a.product_id IN (SELECT product_id FROM products WHERE brand = 'Brand#7')
  AND a.review_date {CL} GROUP BY 1""")
def q_daily_reviews_filter_precedence(spark, sf):
    """Brand wins over the product id; a lone start date is ignored."""
    fx = fixture(spark, sf)
    flt = T.DateFilter(start_date=JULY_2001[0], product_id=7, brand="Brand#7")
    return T.daily_counts(fx.review_analysis, fx.products, flt, clamp=DATE_CLAMP_TEST)


@register("total_sales", f"""
SELECT {D} AS date, count(*) AS sales FROM reviews WHERE review_date {CL} GROUP BY 1""")
def q_total_sales(spark, sf):
    return T.total_sales(fixture(spark, sf).reviews, clamp=DATE_CLAMP_TEST)


@register("total_sales_dates", f"""
SELECT {D} AS date, count(*) AS sales FROM reviews WHERE review_date {CL} AND review_date {JU} GROUP BY 1""")
def q_total_sales_dates(spark, sf):
    return T.total_sales(fixture(spark, sf).reviews, *JULY_2001, clamp=DATE_CLAMP_TEST)


def _attr_sql(attr: str) -> str:
    return f"""
SELECT strftime(r.review_date, '%Y-%m-%d') AS date,
       CASE WHEN p.{attr} IS NULL OR p.{attr} = '' THEN '기타' ELSE p.{attr} END AS {attr}, count(*) AS sales
FROM reviews r JOIN products p ON r.product_id = p.product_id WHERE r.review_date {CL} GROUP BY 1, 2"""


@register("category_sales", _attr_sql("category"))
def q_category_sales(spark, sf):
    fx = fixture(spark, sf)
    return T.category_sales(fx.reviews, fx.products, clamp=DATE_CLAMP_TEST)


@register("gender_sales", _attr_sql("gender"))
def q_gender_sales(spark, sf):
    fx = fixture(spark, sf)
    return T.gender_sales(fx.reviews, fx.products, clamp=DATE_CLAMP_TEST)
