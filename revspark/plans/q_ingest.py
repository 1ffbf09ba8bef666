"""Registered ingest / sink queries."""
from __future__ import annotations

import datetime as dt
import html.entities

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..functions.columns import ymd
from ..functions.dates import relative_date
from ..operators import ingest as I
from ..operators import scores as S
from ..session import scratch_path
from ..sources import fixture, io
from ..sources import pages as PAGE
from ..sources.io import balanced, json_ready
from ..sources.store import Store
from .params import AS_OF, H1_2001, JULY_2001
from .pipeline import PipelineConfig, run_batch, run_pipeline
from .q_labels import DOC_REVIEWS, STOP_TEST, WINDOW, sentiment_sql, topics_sql
from .q_scores import brand_scores_all_ctes
from .registry import ORACLE, register

SPLIT_DAY = "1998-01-01"          # rows before it are "stored", later ones arrive
CUTOFF = (dt.date.fromisoformat(AS_OF) - dt.timedelta(days=10)).isoformat()
RCOLS = "review_id, product_id, rating, review_text, review_date, review_size"

REL_DATE = f"""CASE WHEN date_text IS NULL THEN NULL
 WHEN contains(date_text, '오늘') THEN DATE '{AS_OF}'
 WHEN contains(date_text, '어제') THEN DATE '{AS_OF}' - 1
 WHEN contains(date_text, '일 전') THEN DATE '{AS_OF}' - TRY_CAST(trim(replace(date_text, '일 전', '')) AS INTEGER)
 WHEN contains(date_text, '.') THEN CAST(try_strptime('20' || date_text, '%Y.%m.%d') AS DATE) END"""

# Python's str.strip() whitespace for the size options.
WSC = r"[\t\n\x{0B}\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WSC}+|{WSC}+$', '', 'g')"


SIZE_PICK = f"""coalesce(
  CASE WHEN ends_with({_strip('size_opt1')}, ' 구매') THEN {_strip('size_opt1')} END,
  CASE WHEN ends_with({_strip('size_opt2')}, ' 구매') THEN {_strip('size_opt2')} END,
  CASE WHEN ends_with({_strip('size_opt3')}, ' 구매') THEN {_strip('size_opt3')} END, '사이즈 정보 없음')"""

LANDED = f"""
 landed AS (SELECT coalesce(CAST(review_id AS VARCHAR), '리뷰 ID 없음') AS review_id, CAST(product_id AS VARCHAR) AS product_id,
                   coalesce(rating, '0') AS rating, coalesce(review_text, '내용 없음') AS review_text,
                   CASE WHEN date_text IS NULL THEN '날짜 없음' ELSE strftime({REL_DATE}, '%Y-%m-%d') END AS review_date,
                   {SIZE_PICK} AS review_size, ord
            FROM landing)"""

BATCH = f"""{LANDED},
 lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord DESC) AS rn FROM landed
                       WHERE review_date IS NOT NULL) t WHERE rn = 1),
 nb AS (SELECT TRY_CAST(review_id AS BIGINT) AS review_id, TRY_CAST(product_id AS BIGINT) AS product_id,
               TRY_CAST(rating AS DOUBLE) AS rating, review_text, review_size FROM lb),
 ob AS (SELECT {RCOLS} FROM reviews WHERE review_date < DATE '{SPLIT_DAY}')"""


def _landed(fx):
    return I.landing_rows(fx.landing, AS_OF, None, extra=("ord",))


def _batch(fx):
    ids = fx.landing.select(F.coalesce("review_id", F.lit(K.DEFAULT_REVIEW_ID)).alias("review_id"))
    return I.typed_batch(I.dedup_keep_last(_landed(fx), "ord", counted=ids))


def _old(fx):
    return fx.reviews.where(F.col("review_date") < F.lit(SPLIT_DAY).cast("date"))


@register("dedup_count", "SELECT count(DISTINCT review_id) AS n FROM reviews_raw")
def q_dedup_count(spark, sf):
    return I.dedup_any(fixture(spark, sf).reviews_raw).agg(F.count(F.lit(1)).alias("n"))


@register("dedup_keep_last", f"""
SELECT {RCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord DESC) AS rn FROM reviews_raw) t WHERE rn = 1""")
def q_dedup_keep_last(spark, sf):
    raw = fixture(spark, sf).reviews_raw
    return I.dedup_keep_last(raw, "ord", counted=raw).select(*I.REVIEW_COLS)


@register("dedup_keep_first", f"""
SELECT {RCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord ASC) AS rn FROM reviews_raw) t WHERE rn = 1""")
def q_dedup_keep_first(spark, sf):
    raw = fixture(spark, sf).reviews_raw
    return I.dedup_keep_first(raw, "ord", counted=raw).select(*I.REVIEW_COLS)


@register("new_reviews_anti", f"""
 b AS (SELECT * FROM reviews_raw WHERE review_date >= DATE '{SPLIT_DAY}'),
 f AS (SELECT * FROM b WHERE review_id NOT IN (SELECT review_id FROM reviews WHERE review_date < DATE '{SPLIT_DAY}'))
SELECT {RCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord ASC) AS rn FROM f) t WHERE rn = 1""")
def q_new_reviews_anti(spark, sf):
    fx = fixture(spark, sf)
    batch = fx.reviews_raw.where(F.col("review_date") >= F.lit(SPLIT_DAY).cast("date"))
    return I.new_reviews(batch, _old(fx), "ord").select(*I.REVIEW_COLS)


@register("relative_dates", f"""
SELECT review_id, date_text, strftime({REL_DATE}, '%Y-%m-%d') AS parsed FROM landing""")
def q_relative_dates(spark, sf):
    lg = fixture(spark, sf).landing
    return lg.select("review_id", "date_text", ymd(relative_date("date_text", AS_OF)).alias("parsed"))


@register("field_defaults", f"""{LANDED}
SELECT review_id, product_id, rating, review_text, review_date, review_size FROM landed WHERE review_date IS NOT NULL""")
def q_field_defaults(spark, sf):
    return I.landing_rows(fixture(spark, sf).landing, AS_OF, None)


@register("cutoff_filter", f"""{LANDED}
SELECT review_id, product_id, rating, review_text, review_date, review_size FROM landed
WHERE review_date = '날짜 없음' OR review_date >= '{CUTOFF}'""")
def q_cutoff_filter(spark, sf):
    return I.landing_rows(fixture(spark, sf).landing, AS_OF, CUTOFF)


@register("size_option_pick", f"""
SELECT review_id, size_opt1, size_opt2, size_opt3, {SIZE_PICK} AS review_size FROM landing""")
def q_size_option_pick(spark, sf):
    lg = fixture(spark, sf).landing
    return lg.select("review_id", "size_opt1", "size_opt2", "size_opt3",
                     I.pick_size_option(("size_opt1", "size_opt2", "size_opt3")).alias("review_size"))


@register("reviews_upsert", f"""{BATCH}
SELECT coalesce(ob.review_id, nb.review_id) AS review_id, coalesce(ob.product_id, nb.product_id) AS product_id,
       CASE WHEN nb.review_id IS NOT NULL THEN nb.rating ELSE ob.rating END AS rating,
       CASE WHEN nb.review_id IS NOT NULL THEN nb.review_text ELSE ob.review_text END AS review_text,
       CASE WHEN nb.review_id IS NOT NULL THEN DATE '{AS_OF}' ELSE ob.review_date END AS review_date,
       CASE WHEN nb.review_id IS NOT NULL THEN nb.review_size ELSE ob.review_size END AS review_size
FROM ob FULL OUTER JOIN nb ON ob.review_id = nb.review_id""")
def q_reviews_upsert(spark, sf):
    fx = fixture(spark, sf)
    return I.upsert_reviews(_old(fx), _batch(fx), AS_OF)


@register("upsert_metrics", f"""{BATCH},
 m AS (SELECT (SELECT count(*) FROM ob) AS before_count, (SELECT count(*) FROM nb) AS batch_count,
              (SELECT count(*) FROM ob JOIN nb ON ob.review_id = nb.review_id) AS already_existing,
              (SELECT count(*) FROM ob JOIN nb ON ob.review_id = nb.review_id WHERE ob.rating = nb.rating
                 AND ob.review_text = nb.review_text AND ob.review_size = nb.review_size) AS unchanged,
              (SELECT count(*) FROM ob FULL OUTER JOIN nb ON ob.review_id = nb.review_id) AS after_count)
SELECT *, after_count - before_count AS inserted,
       CASE WHEN after_count - before_count > 0 THEN 'inserted' WHEN already_existing = batch_count THEN 'all_existing'
            WHEN unchanged = batch_count THEN 'all_unchanged' ELSE 'changes_not_inserted' END AS verdict FROM m""")
def q_upsert_metrics(spark, sf):
    fx = fixture(spark, sf)
    rows = fx.reviews.count() + fx.landing.count()          # both sides at most; from the files' footers
    return I.upsert_metrics(_old(fx), _batch(fx), io.pieces(spark, rows))


@register("score_table_replace", f"""
 old AS (WITH {brand_scores_all_ctes(H1_2001).strip()} SELECT * FROM bs),
 new AS (WITH {brand_scores_all_ctes(JULY_2001).strip()} SELECT * FROM bs WHERE review_count >= 30)
SELECT * FROM old WHERE brand NOT IN (SELECT brand FROM new) UNION ALL SELECT * FROM new""")
def q_score_table_replace(spark, sf):
    fx = fixture(spark, sf)
    ra = fx.review_analysis

    def sl(r):
        return ra.where(F.col("review_date").between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date")))
    old = S.brand_scores(sl(H1_2001), fx.products)
    new = S.brand_scores(sl(JULY_2001), fx.products).where(F.col("review_count") >= 30)
    return S.replace_by_key(old, new, ["brand"])


@register("json_projection", """
SELECT review_id, sentence, CAST(round_even(CAST(rating * 1.005 AS DECIMAL(12, 3)), 2) AS DOUBLE) AS rating,
       strftime(review_date, '%Y-%m-%d %H:%M:%S') AS review_date FROM review_analysis""")
def q_json_projection(spark, sf):
    ra = fixture(spark, sf).review_analysis
    return json_ready(ra.select("review_id", "sentence", (F.col("rating") * 1.005).cast("decimal(12,3)").alias("rating"),
                                "review_date"))


@register("reviews_merge_buckets", ORACLE["reviews_upsert"])
def q_reviews_merge_buckets(spark, sf):
    """B10 over a hashed table: the batch rewrites the buckets it touches; same rows as the whole-table upsert."""
    fx = fixture(spark, sf)
    store = Store(spark, scratch_path(spark, "reviews-store"))
    for name, rows, merge in (("stored", _old(fx), lambda old, new: new),
                              ("batch", _batch(fx), lambda old, new: I.upsert_reviews(old, new, AS_OF))):
        c = store.begin(name)
        c.merge("reviews", rows, "review_id", 32, merge)
        c.publish()
    return store.read("reviews")


@register("landing_accumulate", f"""{LANDED}
SELECT {RCOLS} FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord DESC) AS rn FROM landed WHERE review_date IS NOT NULL) t WHERE rn = 1""")
def q_landing_accumulate(spark, sf):
    """A4: three crawls of one day gathered by review id (last row wins), a bucket at a time. The landing rows, which
    each crawl reads twice (to count and to merge), are made once."""
    every = io.stage(I.landing_rows(balanced(fixture(spark, sf).landing), AS_OF, None, extra=("ord",)), "landed")
    store = Store(spark, scratch_path(spark, "landing-store"))
    for i in range(3):
        c = store.begin(f"crawl-{i}")
        io.accumulate_day(c, every.where(F.pmod(F.xxhash64("ord"), F.lit(3)) == i), "day", "ord", buckets=32)
        c.publish()
    return store.read("day").select(*I.REVIEW_COLS)


# B13 on prose: documents are the crawl's reviews (doc_id, source, text); every third one is stored already with another
# product and text, and the day's two crawls overlap.
CRAWLS = ("doc_id % 2 = 0", "doc_id % 2 = 1 OR doc_id % 5 = 0")
PROSE_SQL = DOC_REVIEWS.replace("source AS product_id", "CASE WHEN doc_id % 3 = 0 THEN 'old-' || source ELSE source END AS product_id")


def _prose_store(spark, sf):
    """The store after both crawls, and their metrics."""
    docs = balanced(fixture(spark, sf).table("documents"))
    base = scratch_path(spark, "prose")
    cfg = PipelineConfig(*[f"{base}/unused"] * 4, stopwords=STOP_TEST, id_type="string", keep=T.LATIN_TEST_CLASS, window=WINDOW)
    crawl = docs.select(F.col("doc_id").cast("string").alias("review_id"), F.col("source").alias("product_id"),
                        (F.col("n_chars") % 5 + 1).cast("string").alias("rating"), F.col("text").alias("review_text"),
                        F.lit(AS_OF).alias("review_date"), F.lit("M").alias("review_size"), "doc_id")
    store = Store(spark, f"{base}/store")
    first = store.begin("stored")
    stored = crawl.where("doc_id % 3 = 0").select("review_id", F.concat(F.lit("old-"), "product_id").alias("product_id"), F.lit(1.0).alias("rating"),
                                                  F.lit("old text").alias("review_text"), F.lit("2001-01-01").cast("date").alias("review_date"), "review_size")
    first.merge("reviews", stored, "review_id", 32, lambda old, new: new)
    first.publish()
    metrics = [run_batch(store, cfg, AS_OF, crawl.where(c).drop("doc_id"), f"crawl-{i}", 32).withColumn("crawl", F.lit(i))
               for i, c in enumerate(CRAWLS)]
    return store, metrics[0].unionByName(metrics[1])


def _prose_upsert(keys: str, value: str) -> str:
    return f"""{PROSE_SQL},
 lab AS (SELECT CAST(review_id AS VARCHAR) AS review_id, product_id, substr(sentence, 1, 255) AS sentence, {topics_sql('sentence')} AS category,
         {sentiment_sql('sentence')} AS sentiment, rating, review_date, pos FROM sent)
SELECT review_id, min(product_id) AS product_id, {value}, arg_max(sentiment, pos) AS sentiment, min(rating) AS rating,
       min(review_date) AS review_date FROM lab GROUP BY {keys}"""


@register("pipeline_day", _prose_upsert("review_id, category", "arg_min(sentence, pos) AS sentence, category"))
def q_pipeline_day(spark, sf):
    """B13 end to end on prose: the cumulative analysis after two crawls of a day."""
    return _prose_store(spark, sf)[0].read("analysis")


@register("pipeline_day_daily", _prose_upsert("review_id, sentence", "sentence, arg_max(category, pos) AS category"))
def q_pipeline_day_daily(spark, sf):
    """The same day's daily analysis table."""
    return _prose_store(spark, sf)[0].read("daily")


@register("pipeline_day_metrics", f"""
 d AS (SELECT doc_id, doc_id % 3 = 0 AS stored, {CRAWLS[0]} AS c0, {CRAWLS[1]} AS c1 FROM documents),
 m AS (SELECT 0 AS crawl, count(*) FILTER (stored) AS before_count, count(*) FILTER (c0) AS batch_count, count(*) FILTER (c0 AND stored) AS already_existing,
              0 AS unchanged, count(*) FILTER (stored OR c0) AS after_count FROM d
       UNION ALL SELECT 1, count(*) FILTER (stored OR c0), count(*) FILTER (c1), count(*) FILTER (c1 AND (stored OR c0)), count(*) FILTER (c1 AND c0),
              count(*) FILTER (stored OR c0 OR c1) FROM d)
SELECT crawl, before_count, batch_count, already_existing, CAST(unchanged AS BIGINT) AS unchanged, after_count, after_count - before_count AS inserted,
       CASE WHEN after_count > before_count THEN 'inserted' WHEN already_existing = batch_count THEN 'all_existing'
            WHEN unchanged = batch_count THEN 'all_unchanged' ELSE 'changes_not_inserted' END AS verdict FROM m""")
def q_pipeline_day_metrics(spark, sf):
    """B11 of both crawls: metrics over the touched buckets plus the rows of the others."""
    return _prose_store(spark, sf)[1]


@register("pipeline_day_tables")
def q_pipeline_day_tables(spark, sf):
    """B13 over three plain tables, end to end at AS_OF: the crawl's landing rows for the day are written
    as the landing folder, stored reviews are those before SPLIT_DAY; the result is
    the cumulative analysis table after labelling (rows-only check)."""
    fx = fixture(spark, sf)
    base = scratch_path(spark, "pipeline")
    cfg = PipelineConfig(landing_path=f"{base}/landing", reviews_path=f"{base}/reviews",
                         daily_path=f"{base}/daily", analysis_path=f"{base}/analysis", id_type="bigint", keep=T.LATIN_TEST_CLASS,
                         stopwords=())
    day = AS_OF.replace("-", "")
    I.landing_rows(fx.landing, AS_OF, AS_OF).write.parquet(f"{cfg.landing_path}/dt={day}")
    _old(fx).write.parquet(cfg.reviews_path)
    run_pipeline(spark, cfg, AS_OF)
    return spark.read.parquet(cfg.analysis_path)


def _page_text_sql(x: str) -> str:
    t = f"regexp_replace({x}, '{PAGE.TAG}', ' ', 'g')"
    for name in (*PAGE.FREQUENT[1:], PAGE.FREQUENT[0]):        # the given pages' names; &amp; last
        t = f"replace({t}, '&{name}', chr({ord(html.entities.html5[name])}))"
    return f"regexp_replace(regexp_replace({t}, '[{T.WS}]+', ' ', 'g'), '^ | $', '', 'g')"


# The given pages hold no review blocks and no numeric references: this twin covers the paragraphs of
# their articles; page_blocks covers blocks.
@register("page_reviews", f"""
 hs AS (SELECT page_id, regexp_replace(html, '{PAGE.UNSEEN}', ' ', 'g') AS h FROM pages),
 ar AS (SELECT page_id, h, regexp_extract_all(h, '{PAGE.scope_pattern("article")}', 1) AS a FROM hs),
 ps AS (SELECT page_id, flatten(list_transform(CASE WHEN len(a) > 0 THEN a ELSE [h] END,
                                               lambda s: regexp_split_to_array(s, '{PAGE.PARAGRAPH}')[2:])) AS p FROM ar),
 tx AS (SELECT page_id, list_transform(p, lambda x: {_page_text_sql(f"regexp_split_to_array(x, '{PAGE.PARAGRAPH_END}')[1]")}) AS t FROM ps),
 ix AS (SELECT page_id, t, i FROM tx, LATERAL (SELECT unnest(range(0, len(t))) AS i) r)
SELECT page_id, CAST(i AS INTEGER) AS block, page_id || '-' || i AS review_id, '{K.DEFAULT_RATING}' AS rating,
       CAST(NULL AS VARCHAR) AS date_text, t[i + 1] AS review_text, CAST(NULL AS VARCHAR) AS size_opt1, CAST(NULL AS VARCHAR) AS size_opt2
FROM ix WHERE t[i + 1] <> ''""")
def q_page_reviews(spark, sf):
    """B9 over the fetched pages: review blocks with their fields."""
    return PAGE.page_reviews(balanced(fixture(spark, sf).pages))


# Pages with review blocks in front of the job: documents as reviews, with nested elements of one name, named and
# numeric references, and a block without fields. The twin reads the documents, not the pages.
def _piece_sql(k: int) -> str:
    return f"substr(text, {k} * (length(text) // 3) + 1, {'length(text)' if k == 2 else 'length(text) // 3'})"


def _squeezed_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{T.WS}]+', ' ', 'g'), '^ | $', '', 'g')"


@register("page_blocks", f"""
 d AS (SELECT doc_id, n_chars, {_squeezed_sql(" || ' ' || ".join(_piece_sql(k) for k in range(3)) + " || ' caf' || chr(233) || ' ' || chr(8217) || chr(233)")} AS t FROM documents)
SELECT doc_id AS page_id, 0 AS block, CAST(doc_id AS VARCHAR) AS review_id, CAST(n_chars % 5 + 1 AS VARCHAR) AS rating,
       CASE WHEN doc_id % 2 = 0 THEN '3일 전' END AS date_text, t AS review_text, 'FREE' AS size_opt1, n_chars || ' 구매' AS size_opt2 FROM d
UNION ALL SELECT doc_id, 1, '{K.DEFAULT_REVIEW_ID}', '{K.DEFAULT_RATING}', NULL, '{K.DEFAULT_REVIEW_TEXT}', NULL, NULL FROM d""")
def q_page_blocks(spark, sf):
    d = balanced(fixture(spark, sf).table("documents").select("doc_id", "text", "n_chars"))
    third = F.floor(F.length("text") / 3).cast("int")
    piece = lambda k: F.replace(F.replace(F.substr(F.col("text"), third * k + 1, F.length("text") if k == 2 else third),
                                          F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(
        F.lit('<section><div data-content-id="'), F.col("doc_id").cast("string"), F.lit('"><div><span class="x review-rating">'),
        (F.col("n_chars") % 5 + 1).cast("string"), F.lit("</span>"),
        F.when(F.col("doc_id") % 2 == 0, F.lit('<span class="date"> 3일&nbsp;전 </span>')).otherwise(""),
        F.lit('</div><div class="review-content">'), piece(0), F.lit("<div>"), piece(1), F.lit("<div><DIV></DIV></div></div>"), piece(2),
        F.lit(' caf&eacute; &rsquo;&#233;<br></div><i>not this</i><span class="option">FREE</span><p class="option">'), F.col("n_chars").cast("string"),
        F.lit(' 구매</p></div><div data-content-id=""><p>no fields</p></div></section>'))
    return PAGE.page_reviews(d.select(F.col("doc_id").alias("page_id"), page.alias("html")))
