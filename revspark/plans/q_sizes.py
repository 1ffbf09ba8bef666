"""Registered size-analysis queries."""
from __future__ import annotations

from ..functions.sizes import normalise_size
from ..operators import sizes as Z
from ..sources import fixture
from ..sources.io import pieces, stage
from .params import rounded
from .registry import register

# DuckDB's regex engine has no Unicode \b; a word boundary before/after a match
# is spelled as "start or a non-word char" / "a non-word char or end".
NW = r"[^\pL\pN_]"
LARGEST = "list_reduce({l}, lambda a, x: CASE WHEN CAST(x AS HUGEINT) > CAST(a AS HUGEINT) THEN x ELSE a END)"


def size_norm_sql(c: str) -> str:
    br = rf"regexp_extract_all({c}, '\((\d+)\)', 1)"
    dg = rf"regexp_extract_all({c}, '\d{{2,3}}', 0)"
    return f"""CASE WHEN {c} IS NULL THEN NULL
 WHEN len({br}) > 0 THEN {LARGEST.format(l=br)}
 ELSE coalesce(nullif(regexp_extract({c}, '(\\d+)~\\d+', 1), ''),
               nullif(regexp_extract({c}, '(?:^|{NW})(\\d+(?:\\.\\d+)?)(?:{NW}|$)', 1), ''),
               upper(nullif(regexp_extract({c}, '(?i)(?:^|{NW})(M|L|S|XS|XL|XXL)(?:{NW}|$)', 1), '')),
               nullif(regexp_extract({c}, '(\\d{{2,3}})\\s*구매', 1), ''),
               CASE WHEN len({dg}) > 0 THEN {LARGEST.format(l=dg)} END,
               '-') END"""


STATS = """
 sz AS (SELECT a.product_id, r.review_size, count(*) AS total_reviews, avg(a.rating) AS avg_rating,
               count_if(a.sentiment = 2) AS positive_count, count_if(a.sentiment = 1) AS neutral_count,
               count_if(a.sentiment = 0) AS negative_count,
               CAST(count_if(a.sentiment = 0) AS DOUBLE) * 100.0 / count(*) AS negative_ratio
        FROM review_analysis a JOIN reviews r ON a.review_id = r.review_id
        WHERE list_contains(list_transform(string_split(a.category, ','), lambda x: trim(x)), '사이즈')
        GROUP BY a.product_id, r.review_size)"""

DETAIL = f"""{STATS},
 det AS (SELECT sz.product_id, {size_norm_sql('sz.review_size')} AS review_size, total_reviews, avg_rating, negative_ratio,
                p.product_name, p.brand, p.category, p.gender, p.price, p.image_url
         FROM sz JOIN products p ON sz.product_id = p.product_id)"""


def _stats(spark, sf):
    fx = fixture(spark, sf)
    return Z.size_stats(fx.review_analysis, fx.reviews, pieces=pieces(spark, fx.reviews.count()))


def _detail(spark, sf):
    return Z.size_detail(_stats(spark, sf), fixture(spark, sf).products)


def _detail_staged(spark, sf):
    """The detail rows (one per product and size option) computed once, for the
    reports that read them in several branches (rows and their global maximum)."""
    return stage(_detail(spark, sf), "size-detail")


@register("size_normalise", f"""
SELECT review_id, review_size, {size_norm_sql('review_size')} AS size_norm FROM reviews""")
def q_size_normalise(spark, sf):
    r = fixture(spark, sf).reviews
    return r.select("review_id", "review_size", normalise_size("review_size").alias("size_norm"))


@register("size_stats", f"""{STATS}
SELECT * FROM sz""")
def q_size_stats(spark, sf):
    return _stats(spark, sf)


@register("size_detail", f"""{DETAIL}
SELECT * FROM det""")
def q_size_detail(spark, sf):
    return _detail(spark, sf)


@register("size_sentences", f"""{STATS}
SELECT product_id, sentence, max(review_id) AS last_review_id FROM review_analysis
WHERE contains(category, '사이즈') AND sentiment IN (0, 1)
  AND product_id IN (SELECT sz.product_id FROM sz JOIN products p ON sz.product_id = p.product_id)
GROUP BY product_id, sentence""")
def q_size_sentences(spark, sf):
    fx = fixture(spark, sf)
    return Z.size_sentences(fx.review_analysis, _detail(spark, sf))


@register("size_neg_categories", f"""{DETAIL}
SELECT * FROM det WHERE negative_ratio >= 50 ORDER BY category, product_id, review_size""")
def q_size_neg_categories(spark, sf):
    return Z.negative_rows(_detail(spark, sf), "category")


@register("size_neg_brands", f"""{DETAIL}
SELECT * FROM det WHERE negative_ratio >= 50 ORDER BY brand, product_id, review_size""")
def q_size_neg_brands(spark, sf):
    return Z.negative_rows(_detail(spark, sf), "brand")


@register("size_max_negative", f"""{DETAIL}
SELECT * FROM det WHERE negative_ratio = (SELECT max(negative_ratio) FROM det)""")
def q_size_max_negative(spark, sf):
    return Z.most_negative_sizes(_detail_staged(spark, sf))


MODE = """
 mx AS (SELECT * FROM det WHERE negative_ratio = (SELECT max(negative_ratio) FROM det)),
 per AS (SELECT review_size, count(*) AS n FROM mx GROUP BY 1),
 md AS (SELECT coalesce((SELECT review_size FROM per ORDER BY n DESC, review_size LIMIT 1), 'N/A') AS most_frequent_size)"""


@register("size_mode", f"""{DETAIL},{MODE}
SELECT * FROM md""")
def q_size_mode(spark, sf):
    return Z.size_mode(Z.most_negative_sizes(_detail_staged(spark, sf)))


@register("size_summary", f"""{DETAIL},{MODE}
SELECT (SELECT count(*) FROM det WHERE negative_ratio >= 50) AS category_negative_count,
       (SELECT count(*) FROM det WHERE negative_ratio >= 50) AS brand_negative_count,
       most_frequent_size AS most_negative_count, most_frequent_size AS most_frequent_most_negative FROM md""")
def q_size_summary(spark, sf):
    return Z.size_summary(_detail_staged(spark, sf))


@register("size_donut_counts", f"""{DETAIL}
SELECT category AS key, count(*) AS count, 'category' AS chart FROM det WHERE negative_ratio >= 50 GROUP BY 1
UNION ALL
SELECT brand AS key, count(*) AS count, 'brand' AS chart FROM det WHERE negative_ratio >= 50 GROUP BY 1
UNION ALL
SELECT review_size AS key, count(*) AS count, 'size' AS chart FROM det
WHERE negative_ratio = (SELECT max(negative_ratio) FROM det) GROUP BY 1""")
def q_size_donut_counts(spark, sf):
    return Z.size_donut_counts(_detail_staged(spark, sf))


@register("size_satisfaction_topk", f"""{STATS},
 s AS (SELECT product_id, review_size, total_reviews,
              {rounded("(positive_count * 100 + neutral_count * 50) / total_reviews", 1)} AS satisfaction_score
       FROM sz WHERE total_reviews <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY satisfaction_score DESC, review_size) AS pos,
              row_number() OVER (PARTITION BY product_id ORDER BY satisfaction_score ASC, review_size DESC) AS back FROM s)
SELECT product_id, review_size, total_reviews, satisfaction_score, CAST(pos AS INTEGER) AS pos, 'top' AS kind FROM r WHERE pos <= 3
UNION ALL
SELECT product_id, review_size, total_reviews, satisfaction_score, CAST(pos AS INTEGER) AS pos, 'bottom' AS kind FROM r WHERE back <= 3""")
def q_size_satisfaction_topk(spark, sf):
    return Z.size_satisfaction_topk(_stats(spark, sf))
