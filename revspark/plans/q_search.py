"""Registered lookup / search queries."""
from __future__ import annotations

from ..operators import search as S
from ..sources import fixture
from .params import rounded
from .q_anomalies import WSC
from .registry import register

SEARCH = dict(category="", gender="남자", price_min=90000, price_max=95000, min_reviews=5)
TOPIC = "디자인"


@register("search_brands", """
SELECT DISTINCT brand FROM products WHERE lower(brand) LIKE '%#1%' ORDER BY brand LIMIT 10""")
def q_search_brands(spark, sf):
    return S.search_brands(fixture(spark, sf).products, "#1")


@register("suggest_products", """
SELECT product_id, product_name FROM products WHERE lower(product_name) LIKE '%ring%' ORDER BY product_id LIMIT 5""")
def q_suggest_products(spark, sf):
    return S.suggest_products(fixture(spark, sf).products, "RING")


@register("product_by_name", """
SELECT product_id, product_name FROM products WHERE product_name = 'small ring' ORDER BY product_id LIMIT 1""")
def q_product_by_name(spark, sf):
    return S.product_by_name(fixture(spark, sf).products, "small ring")


@register("product_exists", """
 req AS (SELECT DISTINCT product_id FROM reviews)
SELECT r.product_id, EXISTS (SELECT 1 FROM products p WHERE p.product_id = r.product_id) AS "exists" FROM req r""")
def q_product_exists(spark, sf):
    fx = fixture(spark, sf)
    return S.product_exists(fx.products, fx.reviews.select("product_id").distinct())


@register("brand_list", "SELECT DISTINCT brand FROM products ORDER BY brand")
def q_brand_list(spark, sf):
    return S.brand_list(fixture(spark, sf).products)


# Oracle twin of product_search: AVG as a 4-scale decimal rounded half up, times 50,
# then half-even at 2 dp, all in integer arithmetic (k = AVG in 1e-4 units).
def _search_sql(p) -> str:
    genders = "('남자', '공용')"
    return f"""
 fp AS (SELECT * FROM products WHERE ('{p["category"]}' = '' OR category = '{p["category"]}') AND gender IN {genders}
        AND TRY_CAST(replace(price, ',', '') AS BIGINT) BETWEEN {p["price_min"]} AND {p["price_max"]}),
 agg AS (SELECT a.product_id, count(a.review_id) AS review_count, sum(a.sentiment) AS s, count(a.sentiment) AS n
         FROM review_analysis a JOIN fp ON a.product_id = fp.product_id GROUP BY 1 HAVING count(a.review_id) >= {p["min_reviews"]}),
 k AS (SELECT *, CASE WHEN n = 0 THEN NULL ELSE (20000 * CAST(s AS BIGINT) + n) // (2 * n) END AS k FROM agg),
 found AS (SELECT fp.product_id, fp.product_name, fp.price, fp.category, fp.brand, fp.gender, fp.image_url, k.review_count,
                  coalesce(CASE WHEN k.k % 2 = 0 THEN k.k // 2 ELSE k.k // 2 + (k.k // 2) % 2 END / 100.0, 0.0) AS avg_sentiment
           FROM fp JOIN k ON fp.product_id = k.product_id)"""


TOPIC_ROWS = f"""
 tx AS (SELECT a.product_id, a.sentiment, regexp_replace(x, '^{WSC}+|{WSC}+$', '', 'g') AS topic
        FROM (SELECT product_id, sentiment, unnest(string_split(category, ',')) AS x FROM review_analysis
              WHERE category IS NOT NULL AND sentiment IS NOT NULL AND product_id IN (SELECT product_id FROM found)) a),
 ts AS (SELECT product_id, topic, {rounded("sum(sentiment) / count(*) * 50", 2)} AS score FROM tx GROUP BY 1, 2)"""


@register("product_search", f"""{_search_sql(SEARCH)}
SELECT * FROM found""")
def q_product_search(spark, sf):
    fx = fixture(spark, sf)
    return S.product_search(fx.products, fx.review_analysis, **SEARCH)


@register("product_search_topic_scores", f"""{_search_sql(SEARCH)},{TOPIC_ROWS}
SELECT * FROM ts""")
def q_product_search_topic_scores(spark, sf):
    fx = fixture(spark, sf)
    found = S.product_search(fx.products, fx.review_analysis, **SEARCH)
    return S.product_topic_scores(fx.review_analysis, found)


@register("product_search_topic", f"""{_search_sql(SEARCH)},{TOPIC_ROWS},
 best AS (SELECT product_id, max(score) AS mx, max(CASE WHEN topic = '{TOPIC}' THEN score END) AS topic_score FROM ts GROUP BY 1)
SELECT found.*, best.topic_score, '{TOPIC}' AS topic FROM found JOIN best ON found.product_id = best.product_id
WHERE best.topic_score IS NOT NULL AND (best.topic_score >= 93 OR best.topic_score = best.mx)""")
def q_product_search_topic(spark, sf):
    fx = fixture(spark, sf)
    return S.product_search_topic(fx.products, fx.review_analysis, TOPIC, **SEARCH)


RELATED_CATS = """
 st AS (SELECT product_id, category, sum(sentiment) AS s, count(sentiment) AS n, count(*) AS freq
        FROM review_analysis GROUP BY 1, 2),
 sc AS (SELECT product_id, category, freq,
               CASE WHEN n = 0 THEN NULL ELSE (((20000 * CAST(s AS BIGINT) + n) // (2 * n)) + 1) // 2 / 100.0 END AS score FROM st),
 rk AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY score ASC NULLS FIRST, category) AS rs,
               row_number() OVER (PARTITION BY product_id ORDER BY freq DESC, category) AS rf FROM sc),
 picked AS (SELECT product_id, category, score, freq FROM rk WHERE rs <= 3 OR rf <= 3)"""


@register("related_categories", f"""{RELATED_CATS}
SELECT * FROM picked""")
def q_related_categories(spark, sf):
    return S.related_categories(fixture(spark, sf).review_analysis)


@register("related_reviews", f"""{RELATED_CATS},
 cand AS (SELECT DISTINCT ON (a.rid) a.review_id, a.product_id, a.sentiment FROM (SELECT *, row_number() OVER () AS rid FROM review_analysis) a
          JOIN picked pk ON a.product_id = pk.product_id AND contains(a.category, pk.category)
          WHERE a.sentiment IN (0, 1) AND pk.category IS NOT NULL),
 rows AS (SELECT c.product_id, c.review_id, r.review_text, r.rating, r.review_date, c.sentiment,
                 row_number() OVER (PARTITION BY c.product_id ORDER BY c.sentiment ASC, length(r.review_text) DESC NULLS LAST, c.review_id) AS rank
          FROM cand c JOIN reviews r ON c.review_id = r.review_id)
SELECT product_id, CAST(rank AS INTEGER) AS rank, review_id, review_text, rating, strftime(review_date, '%Y-%m-%d') AS review_date, sentiment
FROM rows WHERE rank <= 50""")
def q_related_reviews(spark, sf):
    fx = fixture(spark, sf)
    return S.related_reviews(fx.review_analysis, fx.reviews)
