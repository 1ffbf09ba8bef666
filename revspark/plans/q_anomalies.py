"""Registered anomaly-report queries (H2-H19), all days / weeks / months at once."""
from __future__ import annotations

from ..functions.columns import round_half_even
from ..operators import anomalies as A
from ..sources import fixture
from .params import TEST_CATEGORIES, rounded
from .registry import register

D = "strftime(review_date, '%Y-%m-%d')"
WK = "CAST(date_trunc('week', review_date) AS DATE)"
MO = "CAST(date_trunc('month', review_date) AS DATE)"
ANOM = "(sentiment = 0 OR rating IN (1.0, 2.0, 3.0))"
CATS = "(" + ", ".join(f"'{c}'" for c in TEST_CATEGORIES) + ")"
# Python's str.strip() whitespace set, for the weekly (Python-side) topic split.
WSC = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _ra(spark, sf):
    return fixture(spark, sf).review_analysis


def _fx(spark, sf):
    return fixture(spark, sf)


@register("day_sentiment_counts", f"""
SELECT {D} AS review_date, CAST(count_if(sentiment = 0) AS BIGINT) AS negative_reviews,
       CAST(count_if(sentiment = 1) AS BIGINT) AS neutral_reviews, CAST(count_if(sentiment = 2) AS BIGINT) AS positive_reviews
FROM review_analysis GROUP BY review_date""")
def q_day_sentiment_counts(spark, sf):
    return A.sentiment_counts(_ra(spark, sf), "day")


@register("week_sentiment_counts", f"""
SELECT strftime({WK}, '%Y-%m-%d') AS week_start, CAST(count_if(sentiment = 0) AS BIGINT) AS negative_reviews,
       CAST(count_if(sentiment = 1) AS BIGINT) AS neutral_reviews, CAST(count_if(sentiment = 2) AS BIGINT) AS positive_reviews
FROM review_analysis GROUP BY 1""")
def q_week_sentiment_counts(spark, sf):
    return A.sentiment_counts(_ra(spark, sf), "week")


@register("day_rating_distribution", f"""
SELECT {D} AS review_date, CAST(trunc(rating) AS INTEGER) AS rating, count(*) AS count
FROM review_analysis WHERE rating IS NOT NULL GROUP BY 1, 2""")
def q_day_rating_distribution(spark, sf):
    return A.rating_distribution(_ra(spark, sf))


@register("day_avg_rating", f"""
SELECT {D} AS review_date, coalesce(avg(rating), 0.0) AS avg_rating FROM review_analysis GROUP BY 1""")
def q_day_avg_rating(spark, sf):
    return A.avg_rating(_ra(spark, sf))


def _day_topics(neg: bool) -> str:
    return f"""
 t AS (SELECT review_date, trim(string_split(category, ',')[n]) AS category
       FROM review_analysis, (SELECT unnest([1, 2, 3, 4, 5]) AS n) nums
       WHERE len(string_split(category, ',')) >= n {'AND sentiment = 0' if neg else ''})
SELECT {D} AS review_date, category, count(*) AS count FROM t
WHERE category IS NOT NULL AND category <> '' GROUP BY 1, 2"""


@register("day_topic_counts", _day_topics(False))
def q_day_topic_counts(spark, sf):
    return A.topic_counts(_ra(spark, sf), "day", cap=5)


@register("day_negative_topic_counts", _day_topics(True))
def q_day_negative_topic_counts(spark, sf):
    return A.topic_counts(_ra(spark, sf), "day", cap=5, negative_only=True)


def _week_topics(neg: bool) -> str:
    return f"""
 t AS (SELECT {WK} AS wk, regexp_replace(x, '^{WSC}+|{WSC}+$', '', 'g') AS category
       FROM (SELECT review_date, unnest(string_split(category, ',')) AS x FROM review_analysis
             WHERE category IS NOT NULL {'AND sentiment = 0' if neg else ''}) u)
SELECT strftime(wk, '%Y-%m-%d') AS week_start, category, count(*) AS count FROM t
WHERE category <> '' GROUP BY 1, 2"""


@register("week_topic_counts", _week_topics(False))
def q_week_topic_counts(spark, sf):
    return A.topic_counts(_ra(spark, sf), "week", cap=None)


@register("week_negative_topic_counts", _week_topics(True))
def q_week_negative_topic_counts(spark, sf):
    return A.topic_counts(_ra(spark, sf), "week", cap=None, negative_only=True)


@register("day_negative_reviews", f"""
SELECT review_id, product_id, sentence, category, {D} AS review_date, rating, sentiment
FROM review_analysis WHERE sentiment = 0""")
def q_day_negative_reviews(spark, sf):
    return A.negative_reviews(_ra(spark, sf))


ANOM_ROWS = f"""
 an AS (SELECT r.review_id, r.product_id, p.product_name, p.brand, p.price, p.image_url, r.sentence, r.category,
               r.review_date, r.rating, r.sentiment, rv.review_size
        FROM review_analysis r JOIN products p ON r.product_id = p.product_id
        LEFT JOIN reviews rv ON r.review_id = rv.review_id
        WHERE r.sentiment = 0 OR r.rating IN (1.0, 2.0, 3.0))"""


@register("day_anomaly_reviews", f"""{ANOM_ROWS}
SELECT review_id, product_id, product_name, brand, price, image_url, sentence, category, review_date, rating,
       sentiment, review_size FROM an""")
def q_day_anomaly_reviews(spark, sf):
    fx = _fx(spark, sf)
    return A.anomaly_reviews(fx.review_analysis, fx.products, fx.reviews).withColumn(
        "review_date", A.ymd("review_date"))


@register("week_anomaly_reviews", f"""{ANOM_ROWS}
SELECT strftime({WK}, '%Y-%m-%d') AS week_start, review_id, product_id, product_name, brand, price, image_url, sentence,
       category, {D} AS review_date, rating, sentiment, review_size FROM an""")
def q_week_anomaly_reviews(spark, sf):
    fx = _fx(spark, sf)
    return A.week_anomaly_reviews(fx.review_analysis, fx.products, fx.reviews)


@register("week_rating_distribution", f"""
 weeks AS (SELECT DISTINCT {WK} AS wk FROM review_analysis),
 spine AS (SELECT wk, unnest([1, 2, 3, 4, 5]) AS rating FROM weeks),
 c AS (SELECT {WK} AS wk, CAST(rating AS INTEGER) AS rating, count(*) AS n FROM review_analysis
       WHERE rating IN (1.0, 2.0, 3.0, 4.0, 5.0) GROUP BY 1, 2)
SELECT strftime(s.wk, '%Y-%m-%d') AS week_start, s.rating, coalesce(c.n, 0) AS count
FROM spine s LEFT JOIN c ON s.wk = c.wk AND s.rating = c.rating""")
def q_week_rating_distribution(spark, sf):
    return A.week_rating_distribution(_ra(spark, sf))


@register("week_avg_rating", f"""
 d AS (SELECT review_date, avg(rating) AS a FROM review_analysis GROUP BY review_date)
SELECT strftime({WK}, '%Y-%m-%d') AS week_start,
       coalesce({rounded("sum(CASE WHEN a IS NOT NULL AND a <> 0 THEN a END) / count_if(a IS NOT NULL AND a <> 0)", 6)}, 0.0) AS avg_rating
FROM d GROUP BY 1""")
def q_week_avg_rating(spark, sf):
    # sums of doubles depend on their order: both sides leave at 6 places
    return A.week_avg_rating(_ra(spark, sf)).withColumn("avg_rating", round_half_even("avg_rating", 6))


@register("month_anomaly_products", f"""
 per AS (SELECT {MO} AS m, product_id, count(*) AS anomaly_count FROM review_analysis WHERE {ANOM} GROUP BY 1, 2),
 j AS (SELECT per.*, p.product_name, row_number() OVER (PARTITION BY m ORDER BY anomaly_count DESC, per.product_id) AS rank
       FROM per JOIN products p ON per.product_id = p.product_id)
SELECT strftime(m, '%Y-%m-%d') AS month_start, CAST(rank AS INTEGER) AS rank, product_id, product_name, anomaly_count
FROM j WHERE rank <= 10""")
def q_month_anomaly_products(spark, sf):
    fx = _fx(spark, sf)
    return A.month_anomaly_products(fx.review_analysis, fx.products)


@register("month_anomaly_categories", f"""
SELECT strftime(CAST(date_trunc('month', r.review_date) AS DATE), '%Y-%m-%d') AS month_start, p.category, count(*) AS anomaly_count
FROM review_analysis r JOIN products p ON r.product_id = p.product_id
WHERE (r.sentiment = 0 OR r.rating IN (1, 2, 3)) AND p.category IN {CATS} GROUP BY 1, 2""")
def q_month_anomaly_categories(spark, sf):
    fx = _fx(spark, sf)
    return A.month_anomaly_categories(fx.review_analysis, fx.products, TEST_CATEGORIES)


@register("month_anomaly_trend", f"""
SELECT {D} AS review_date, count_if(sentiment = 0) AS negative_count, count_if(rating IN (1.0, 2.0, 3.0)) AS low_rating_count
FROM review_analysis WHERE review_date <> DATE '2025-03-04' GROUP BY 1""".replace(
    "count_if(sentiment = 0) AS", "CAST(count_if(sentiment = 0) AS BIGINT) AS").replace(
    "count_if(rating IN (1.0, 2.0, 3.0)) AS", "CAST(count_if(rating IN (1.0, 2.0, 3.0)) AS BIGINT) AS"))
def q_month_anomaly_trend(spark, sf):
    return A.anomaly_trend(_ra(spark, sf))


@register("sentiment_share", f"""
 c AS (SELECT review_date, sentiment, count(*) AS n FROM review_analysis WHERE sentiment IN (0, 1, 2) GROUP BY 1, 2)
SELECT {D} AS review_date, sentiment, n,
       CASE WHEN sum(n) OVER (PARTITION BY review_date) = 0 THEN NULL
            ELSE {rounded("n / sum(n) OVER (PARTITION BY review_date) * 100", 1)} END AS share FROM c""")
def q_sentiment_share(spark, sf):
    return A.sentiment_share(_ra(spark, sf))


@register("anomaly_by_product", f"""{ANOM_ROWS}
SELECT {D} AS review_date, product_id, product_name, brand, price, image_url, count(*) AS total_reviews
FROM an GROUP BY review_date, product_id, product_name, brand, price, image_url""")
def q_anomaly_by_product(spark, sf):
    fx = _fx(spark, sf)
    return A.anomaly_by_product(A.anomaly_rows(fx.review_analysis, fx.products))


@register("topic_total_vs_negative", f"""
 t AS (SELECT review_date, sentiment, trim(string_split(category, ',')[n]) AS category
       FROM review_analysis, (SELECT unnest([1, 2, 3, 4, 5]) AS n) nums
       WHERE len(string_split(category, ',')) >= n)
SELECT {D} AS review_date, category, count(*) AS total, CAST(count_if(sentiment = 0) AS BIGINT) AS negative FROM t
WHERE category IS NOT NULL AND category <> '' GROUP BY 1, 2""")
def q_topic_total_vs_negative(spark, sf):
    return A.topic_total_vs_negative(_ra(spark, sf))


@register("rating_vector", f"""
 days AS (SELECT DISTINCT review_date FROM review_analysis),
 spine AS (SELECT review_date, unnest([1, 2, 3, 4, 5]) AS rating FROM days),
 c AS (SELECT review_date, CAST(trunc(rating) AS INTEGER) AS rating, count(*) AS n FROM review_analysis
       WHERE rating IS NOT NULL GROUP BY 1, 2)
SELECT strftime(s.review_date, '%Y-%m-%d') AS review_date, s.rating, coalesce(c.n, 0) AS count
FROM spine s LEFT JOIN c ON s.review_date = c.review_date AND s.rating = c.rating""")
def q_rating_vector(spark, sf):
    return A.rating_vector(_ra(spark, sf))


@register("anomaly_detail", f"""{ANOM_ROWS}
SELECT review_id, product_id,
       CASE WHEN rating IS NULL OR rating = 0 THEN 'N/A' ELSE regexp_replace(CAST(rating AS VARCHAR), '\\.0$', '') END AS rating_text,
       CASE WHEN sentence IS NULL OR sentence = '' THEN '내용 없음' ELSE sentence END AS sentence_text,
       CASE WHEN review_size IS NULL OR review_size = '' THEN '미지정' ELSE review_size END AS size_text,
       coalesce({D}, '날짜 없음') AS date_text,
       CASE sentiment WHEN 0 THEN '부정 감성 🔴' WHEN 1 THEN '중립 감성 🟡' WHEN 2 THEN '긍정 감성 🟢' ELSE '' END AS sentiment_text
FROM an""")
def q_anomaly_detail(spark, sf):
    fx = _fx(spark, sf)
    return A.anomaly_detail(A.anomaly_reviews(fx.review_analysis, fx.products, fx.reviews))


@register("product_report_facts", f"""{ANOM_ROWS},
 f AS (SELECT {WK} AS wk, product_id, min(product_name) AS product_name, count(*) AS n_reviews,
              CAST(count_if(sentiment = 0) AS BIGINT) AS negative, CAST(count_if(sentiment = 1) AS BIGINT) AS neutral,
              CAST(count_if(sentiment = 2) AS BIGINT) AS positive,
              {rounded("sum(CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 0.0 END) / count(*)", 2)} AS avg_rating
       FROM an GROUP BY 1, 2),
 tx AS (SELECT {WK} AS wk, product_id, regexp_replace(x, '^{WSC}+|{WSC}+$', '', 'g') AS topic
        FROM (SELECT review_date, product_id, unnest(string_split(category, ',')) AS x FROM an) u),
 tc AS (SELECT wk, product_id, topic, count(*) AS n FROM tx WHERE topic <> '' GROUP BY 1, 2, 3),
 tr AS (SELECT *, row_number() OVER (PARTITION BY wk, product_id ORDER BY n DESC, topic) AS rk FROM tc),
 tt AS (SELECT wk, product_id, string_agg(topic || '(' || CAST(n AS VARCHAR) || '회)', ', ' ORDER BY rk) AS top_topics
        FROM tr WHERE rk <= 5 GROUP BY 1, 2)
SELECT strftime(f.wk, '%Y-%m-%d') AS week_start, f.product_id, f.product_name, f.n_reviews, f.negative, f.neutral,
       f.positive, f.avg_rating, coalesce(tt.top_topics, '') AS top_topics
FROM f LEFT JOIN tt ON f.wk = tt.wk AND f.product_id = tt.product_id""")
def q_product_report_facts(spark, sf):
    fx = _fx(spark, sf)
    return A.product_report_facts(A.anomaly_rows(fx.review_analysis, fx.products), "week")


@register("product_report_lines", f"""{ANOM_ROWS}
SELECT strftime({WK}, '%Y-%m-%d') AS week_start, product_id, {D} AS review_date, review_id, sentence,
       '- "' || sentence || '" (평점: ' || CAST(rating AS VARCHAR) || ', 감성: ' ||
       CASE sentiment WHEN 0 THEN '부정' WHEN 1 THEN '중립' WHEN 2 THEN '긍정' ELSE '알 수 없음' END || ')' AS line
FROM an""")
def q_product_report_lines(spark, sf):
    fx = _fx(spark, sf)
    return A.product_report_lines(A.anomaly_rows(fx.review_analysis, fx.products), "week")


@register("month_report_lines", f"""
 tr AS (SELECT review_date, count_if(sentiment = 0) AS neg, count_if(rating IN (1.0, 2.0, 3.0)) AS low
        FROM review_analysis WHERE review_date <> DATE '2025-03-04' GROUP BY 1),
 trl AS (SELECT strftime(review_date, '%Y-%m') AS m,
                string_agg('- ' || strftime(review_date, '%Y-%m-%d') || ': 부정 리뷰 ' || CAST(neg AS VARCHAR) || '건, 저평점 '
                           || CAST(low AS VARCHAR) || '건', chr(10) ORDER BY review_date) AS trend_text FROM tr GROUP BY 1),
 ca AS (SELECT strftime(r.review_date, '%Y-%m') AS m, p.category, count(*) AS c
        FROM review_analysis r JOIN products p ON r.product_id = p.product_id
        WHERE (r.sentiment = 0 OR r.rating IN (1, 2, 3)) AND p.category IN {CATS} GROUP BY 1, 2),
 cal AS (SELECT m, string_agg('- ' || category || ': ' || CAST(c AS VARCHAR) || '건', chr(10) ORDER BY c DESC, category) AS category_text
         FROM ca GROUP BY 1),
 per AS (SELECT strftime(review_date, '%Y-%m') AS m, product_id, count(*) AS c FROM review_analysis WHERE {ANOM} GROUP BY 1, 2),
 pj AS (SELECT per.*, p.product_name, row_number() OVER (PARTITION BY m ORDER BY c DESC, per.product_id) AS rk
        FROM per JOIN products p ON per.product_id = p.product_id),
 prl AS (SELECT m, string_agg('- ' || product_name || ' (ID: ' || CAST(product_id AS VARCHAR) || '): ' || CAST(c AS VARCHAR) || '건',
                              chr(10) ORDER BY rk) AS product_text FROM pj WHERE rk <= 10 GROUP BY 1),
 months AS (SELECT m FROM trl UNION SELECT m FROM cal UNION SELECT m FROM prl)
SELECT months.m AS month,
       '[' || CAST(CAST(substr(months.m, 1, 4) AS INTEGER) AS VARCHAR) || '년 ' || CAST(CAST(substr(months.m, 6, 2) AS INTEGER) AS VARCHAR)
           || '월] 이상 감지 리뷰 통계 분석' AS heading,
       coalesce(trend_text, '') AS trend_text, coalesce(category_text, '') AS category_text, coalesce(product_text, '') AS product_text
FROM months LEFT JOIN trl ON months.m = trl.m LEFT JOIN cal ON months.m = cal.m LEFT JOIN prl ON months.m = prl.m""")
def q_month_report_lines(spark, sf):
    fx = _fx(spark, sf)
    return A.month_report_lines(fx.review_analysis, fx.products, TEST_CATEGORIES)


@register("product_report_facts_day", f"""{ANOM_ROWS},
 f AS (SELECT review_date AS d, product_id, min(product_name) AS product_name, count(*) AS n_reviews,
              CAST(count_if(sentiment = 0) AS BIGINT) AS negative, CAST(count_if(sentiment = 1) AS BIGINT) AS neutral,
              CAST(count_if(sentiment = 2) AS BIGINT) AS positive,
              {rounded("sum(CASE WHEN rating IS NOT NULL AND rating <> 0 THEN rating ELSE 0.0 END) / count(*)", 2)} AS avg_rating
       FROM an GROUP BY 1, 2),
 tx AS (SELECT review_date AS d, product_id, regexp_replace(x, '^{WSC}+|{WSC}+$', '', 'g') AS topic
        FROM (SELECT review_date, product_id, unnest(string_split(category, ',')) AS x FROM an) u),
 tc AS (SELECT d, product_id, topic, count(*) AS n FROM tx WHERE topic <> '' GROUP BY 1, 2, 3),
 tr AS (SELECT *, row_number() OVER (PARTITION BY d, product_id ORDER BY n DESC, topic) AS rk FROM tc),
 tt AS (SELECT d, product_id, string_agg(topic || '(' || CAST(n AS VARCHAR) || '회)', ', ' ORDER BY rk) AS top_topics
        FROM tr WHERE rk <= 5 GROUP BY 1, 2)
SELECT strftime(f.d, '%Y-%m-%d') AS review_date, f.product_id, f.product_name, f.n_reviews, f.negative, f.neutral,
       f.positive, f.avg_rating, coalesce(tt.top_topics, '') AS top_topics
FROM f LEFT JOIN tt ON f.d = tt.d AND f.product_id = tt.product_id""")
def q_product_report_facts_day(spark, sf):
    fx = _fx(spark, sf)
    return A.product_report_facts(A.anomaly_rows(fx.review_analysis, fx.products), "day")
