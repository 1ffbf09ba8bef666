"""Registered score / ranking queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ymd  # noqa: F401
from ..operators import scores as S
from ..sources import fixture
from .params import AS_OF, H1_2001, JULY_2001, TOPICS_SQL, rounded
from .registry import register


def _slice(df, rng):
    return df if rng is None else df.where(F.col("review_date").between(F.lit(rng[0]).cast("date"), F.lit(rng[1]).cast("date")))


def _where(rng):
    return "" if rng is None else f"WHERE review_date BETWEEN DATE '{rng[0]}' AND DATE '{rng[1]}'"


# ---- oracle building blocks (DuckDB) -------------------------------------------------------
def _topic_rows(entity: str, rng) -> str:
    ent = "p.brand" if entity == "brand" else "a.product_id"
    return f"""
 ra_{entity} AS (SELECT {ent} AS {entity}, a.category, a.sentiment FROM (SELECT * FROM review_analysis {_where(rng)}) a
                 JOIN products p ON a.product_id = p.product_id),
 tx_{entity} AS (SELECT {entity}, sentiment, trim(x) AS topic FROM
                 (SELECT {entity}, sentiment, unnest(string_split(category, ',')) AS x FROM ra_{entity}
                  WHERE category IS NOT NULL AND sentiment IS NOT NULL) u),
 ts_{entity} AS (SELECT {entity}, topic, {rounded("sum(sentiment) / count(*) * 50", 2)} AS score, count(*) AS cnt
                 FROM tx_{entity} WHERE topic IN {TOPICS_SQL} GROUP BY {entity}, topic)"""


W_N = "CAST(CASE WHEN n < 30 THEN 0.7 WHEN n < 100 THEN 0.85 WHEN n < 300 THEN 0.95 ELSE 1.0 END AS DOUBLE)"
W_POS = ("CAST(CASE WHEN pos / n < CAST(0.3 AS DOUBLE) THEN 0.85 WHEN pos / n < CAST(0.5 AS DOUBLE) THEN 0.95 "
         "ELSE 1.0 END AS DOUBLE)")


def _w_topic(m):
    return f"CAST(CASE WHEN {m} < 60 THEN 0.8 WHEN {m} < 75 THEN 0.9 ELSE 1.0 END AS DOUBLE)"


GRADE = "CASE WHEN overall_score < 60 THEN '미흡' WHEN overall_score < 80 THEN '보통' ELSE '좋음' END"


def brand_scores_all_ctes(rng=None) -> str:
    return f"""
{_topic_rows('brand', rng)},
 mt AS (SELECT brand, min(score) AS mn FROM ts_brand WHERE score > 0 GROUP BY brand),
 b AS (SELECT p.brand, count(a.product_id) AS n, sum(a.sentiment) AS s, count_if(a.sentiment >= 0.7) AS pos
       FROM products p LEFT JOIN (SELECT * FROM review_analysis {_where(rng)}) a ON a.product_id = p.product_id
       WHERE p.brand IS NOT NULL GROUP BY p.brand),
 sc AS (SELECT b.brand, b.n, CASE WHEN n = 0 THEN CAST(0.0 AS DOUBLE) ELSE
          least(CAST(100 AS DOUBLE), {rounded(f'''(s / n * 50) * {W_N} * {W_POS} * {_w_topic('coalesce(mt.mn, 0)')}''', 2)}) END AS overall_score
        FROM b LEFT JOIN mt ON b.brand = mt.brand),
 bs AS (SELECT brand, overall_score, {GRADE} AS rating, CAST(n AS BIGINT) AS review_count FROM sc)"""


def brand_scores_all_sql(rng=None) -> str:
    return brand_scores_all_ctes(rng) + "\nSELECT * FROM bs"


def brand_score_single_sql(rng=None) -> str:
    return f"""
{_topic_rows('brand', rng)},
 mt AS (SELECT brand, min(score) AS mn FROM ts_brand WHERE cnt > 0 GROUP BY brand),
 b AS (SELECT p.brand, count(*) AS n, sum(a.sentiment) AS s, count_if(a.sentiment >= 0.7) AS pos
       FROM (SELECT * FROM review_analysis {_where(rng)}) a JOIN products p ON a.product_id = p.product_id
       WHERE p.brand IS NOT NULL GROUP BY p.brand),
 sc AS (SELECT b.brand, b.n, CASE WHEN mt.mn IS NULL THEN NULL ELSE
          least(CAST(100 AS DOUBLE), {rounded(f'''(s / n * 50) * {W_N} * {W_POS} * {_w_topic('mt.mn')}''', 2)}) END AS overall_score
        FROM b LEFT JOIN mt ON b.brand = mt.brand)
SELECT brand, overall_score, CASE WHEN overall_score IS NULL THEN NULL ELSE {GRADE} END AS rating,
       CAST(n AS BIGINT) AS review_count FROM sc"""


def topic_scores_sql(entity: str) -> str:
    return f"""
{_topic_rows(entity, None)},
 ents AS (SELECT DISTINCT {entity} FROM ra_{entity}),
 grid AS (SELECT {entity}, unnest({TOPICS_SQL.replace('(', '[').replace(')', ']')}) AS topic FROM ents)
SELECT g.{entity}, g.topic, coalesce(t.score, CAST(0 AS DOUBLE)) AS score, CAST(coalesce(t.cnt, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN ts_{entity} t ON g.{entity} = t.{entity} AND g.topic = t.topic"""


def product_profile_sql(as_of: str) -> str:
    return f"""
 per AS (SELECT product_id, count(review_id) AS review_count, avg(rating) AS avg_rating,
                count_if(review_date >= DATE '{as_of}' - INTERVAL 3 MONTH) AS recent_reviews,
                count_if(review_date BETWEEN DATE '{as_of}' - INTERVAL 6 MONTH AND DATE '{as_of}' - INTERVAL 3 MONTH) AS past_reviews
         FROM review_analysis GROUP BY product_id),
 prof AS (SELECT p.product_id, p.product_name, p.brand, CAST(coalesce(per.review_count, 0) AS BIGINT) AS review_count,
                 per.avg_rating, CAST(coalesce(per.recent_reviews, 0) AS BIGINT) AS recent_reviews,
                 CAST(coalesce(per.past_reviews, 0) AS BIGINT) AS past_reviews
          FROM products p LEFT JOIN per ON p.product_id = per.product_id)"""


def product_scores_sql(as_of: str) -> str:
    return f"""
{_topic_rows('product_id', None)},
{product_profile_sql(as_of)},
 pmt AS (SELECT product_id, min(score) AS mn FROM ts_product_id WHERE cnt > 0 GROUP BY product_id),
 st AS (SELECT product_id, count(*) AS n, sum(sentiment) AS s FROM review_analysis GROUP BY product_id),
 psc AS (SELECT prof.product_id, prof.product_name, prof.brand,
          CASE WHEN pmt.mn IS NULL THEN NULL ELSE least(CAST(100 AS DOUBLE), {rounded(f'''(st.s / st.n * 50)
            * CAST(CASE WHEN prof.review_count < 50 THEN 0.8 WHEN prof.review_count < 150 THEN 0.9 ELSE 1.0 END AS DOUBLE)
            * CAST(CASE WHEN prof.past_reviews > 0 AND prof.recent_reviews / prof.past_reviews >= 1 THEN 0.9 ELSE 1.0 END AS DOUBLE)
            * CAST(CASE WHEN pmt.mn <= 80 THEN 0.9 ELSE 1.0 END AS DOUBLE)
            * CAST(CASE WHEN prof.avg_rating IS NOT NULL AND prof.avg_rating <> 0 AND prof.avg_rating < CAST(4.7 AS DOUBLE) THEN 0.95 ELSE 1.0 END AS DOUBLE)''', 2)}) END AS overall_score
        FROM st JOIN prof ON st.product_id = prof.product_id LEFT JOIN pmt ON st.product_id = pmt.product_id)"""


# ---- registered queries ------------------------------------------------------------------------
def _brand_scores_all(rng):
    def q(spark, sf):
        fx = fixture(spark, sf)
        return S.brand_scores(_slice(fx.review_analysis, rng), fx.products, all_brands=True)
    return q


register("brand_scores_all", brand_scores_all_sql())(_brand_scores_all(None))
register("brand_scores_all_2001h1", brand_scores_all_sql(H1_2001))(_brand_scores_all(H1_2001))
register("brand_scores_all_2001_07", brand_scores_all_sql(JULY_2001))(_brand_scores_all(JULY_2001))


def _brand_score(rng):
    def q(spark, sf):
        fx = fixture(spark, sf)
        return S.brand_scores(_slice(fx.review_analysis, rng), fx.products, all_brands=False)
    return q


register("brand_score", brand_score_single_sql())(_brand_score(None))
register("brand_score_2001h1", brand_score_single_sql(H1_2001))(_brand_score(H1_2001))
register("brand_score_2001_07", brand_score_single_sql(JULY_2001))(_brand_score(JULY_2001))


@register("topic_scores_brand", topic_scores_sql("brand"))
def q_topic_scores_brand(spark, sf):
    fx = fixture(spark, sf)
    return S.topic_scores(fx.review_analysis, fx.products, "brand")


@register("topic_scores_product", topic_scores_sql("product_id"))
def q_topic_scores_product(spark, sf):
    fx = fixture(spark, sf)
    return S.topic_scores(fx.review_analysis.join(fx.products.select("product_id"), "product_id", "left_semi"),
                          fx.products, "product_id")


@register("topic_sentiment_pivot", f"""
 ra AS (SELECT p.brand, a.category, a.sentiment FROM review_analysis a JOIN products p ON a.product_id = p.product_id),
 brands AS (SELECT DISTINCT brand FROM ra),
 grid AS (SELECT brand, unnest({TOPICS_SQL.replace('(', '[').replace(')', ']')}) AS topic FROM brands),
 c AS (SELECT brand, category AS topic, count_if(sentiment = 2) AS positive, count_if(sentiment = 0) AS neutral,
              count_if(sentiment = 1) AS negative FROM ra WHERE category IN {TOPICS_SQL} GROUP BY brand, category)
SELECT g.brand, g.topic, CAST(coalesce(positive, 0) AS BIGINT) AS positive, CAST(coalesce(neutral, 0) AS BIGINT) AS neutral,
       CAST(coalesce(negative, 0) AS BIGINT) AS negative,
       CAST(coalesce(positive, 0) + coalesce(neutral, 0) + coalesce(negative, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN c ON g.brand = c.brand AND g.topic = c.topic""")
def q_topic_sentiment_pivot(spark, sf):
    fx = fixture(spark, sf)
    return S.topic_sentiment_pivot(fx.review_analysis, fx.products)


@register("brand_yearly_reviews", """
SELECT p.brand, CAST(year(r.review_date) AS INTEGER) AS review_year, count(*) AS total_reviews
FROM reviews r JOIN products p ON r.product_id = p.product_id GROUP BY 1, 2""")
def q_brand_yearly_reviews(spark, sf):
    fx = fixture(spark, sf)
    return S.brand_yearly_reviews(fx.reviews, fx.products)


@register("brand_of_product_score", brand_score_single_sql().replace(
    "SELECT brand, overall_score, CASE", "SELECT p2.product_id, sc.brand, overall_score, CASE").replace(
    "CAST(n AS BIGINT) AS review_count FROM sc", "CAST(n AS BIGINT) AS review_count FROM sc JOIN products p2 ON p2.brand = sc.brand"))
def q_brand_of_product_score(spark, sf):
    fx = fixture(spark, sf)
    return S.brand_of_product_score(fx.review_analysis, fx.products)


@register("product_profile", f"""
{product_profile_sql(AS_OF)}
SELECT product_id, product_name, brand, review_count, avg_rating, recent_reviews, past_reviews FROM prof""")
def q_product_profile(spark, sf):
    fx = fixture(spark, sf)
    return S.product_profile(fx.review_analysis, fx.products, AS_OF)


@register("product_score", f"""
{product_scores_sql(AS_OF)}
SELECT product_id, product_name, brand, overall_score FROM psc""")
def q_product_score(spark, sf):
    fx = fixture(spark, sf)
    return S.product_scores(fx.review_analysis, fx.products, AS_OF)


@register("brand_ranking", f"""
{brand_scores_all_ctes()}
SELECT * FROM bs WHERE review_count >= 30""")
def q_brand_ranking(spark, sf):
    fx = fixture(spark, sf)
    return S.brand_ranking(S.brand_scores(fx.review_analysis, fx.products))


@register("product_ranking", f"""
{product_scores_sql(AS_OF)}
SELECT product_id, product_name, brand, overall_score FROM psc WHERE overall_score > 0""")
def q_product_ranking(spark, sf):
    fx = fixture(spark, sf)
    return S.product_ranking(S.product_scores(fx.review_analysis, fx.products, AS_OF))


def _ends_sql(src: str, key: str, kind: str) -> str:
    return f"""
SELECT key, overall_score, CAST(row_number() OVER (ORDER BY overall_score DESC, key ASC) AS INTEGER) AS pos, 'top_{kind}' AS kind
FROM (SELECT {key} AS key, overall_score FROM {src} ORDER BY overall_score DESC, key ASC LIMIT 3) t
UNION ALL
SELECT key, overall_score, CAST(row_number() OVER (ORDER BY overall_score DESC, key ASC) AS INTEGER) AS pos, 'bottom_{kind}' AS kind
FROM (SELECT {key} AS key, overall_score FROM {src} ORDER BY overall_score ASC, key DESC LIMIT 3) t"""


@register("rankings_top_bottom", f"""
{brand_scores_all_ctes()},
{product_scores_sql(AS_OF)}
{_ends_sql("(SELECT * FROM bs WHERE review_count >= 30)", "brand", "brands")}
UNION ALL
{_ends_sql("(SELECT * FROM psc WHERE overall_score > 0)", "CAST(product_id AS VARCHAR)", "products")}""")
def q_rankings_top_bottom(spark, sf):
    fx = fixture(spark, sf)
    return S.rankings_top_bottom(S.brand_scores(fx.review_analysis, fx.products),
                                 S.product_scores(fx.review_analysis, fx.products, AS_OF))
