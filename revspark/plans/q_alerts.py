"""Registered alert queries (I2-I9, A10): batch twins with DuckDB oracles, and the
streaming jobs run with ``availableNow`` over the events staged as files."""
from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import constants as K
from ..operators import alerts as A
from ..session import scratch_path
from ..sources import fixture
from ..streaming import alerts as S
from .registry import ORACLE, register

EV_COLS = "review_id, event_id, product_id, category, sentence, sentiment, rating"
TYPE_SQL = (f"CASE WHEN sentiment = 0 THEN '{K.ALERT_NEGATIVE}' WHEN rating IN (1.0, 2.0, 3.0) "
            f"THEN '{K.ALERT_LOW_RATING}' END")
DISPLAY_SQL = (f"CASE WHEN sentiment = 0 AND rating IN (4.0, 5.0) THEN '{K.DISPLAY_NEGATIVE}' "
               f"WHEN rating IN (1.0, 2.0) THEN '{K.DISPLAY_LOW_RATING}' ELSE '{K.DISPLAY_GENERAL}' END")
STORED_SCHEMA = StructType([StructField("review_id", StringType()), StructField("category", StringType()),
                            StructField("sentiment", IntegerType())])


def _events(spark, sf):
    return fixture(spark, sf).review_events


@register("alert_types", f"""
SELECT {EV_COLS}, {TYPE_SQL} AS type, {DISPLAY_SQL} AS display_type FROM review_events
WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0)) AND {TYPE_SQL} IS NOT NULL""")
def q_alert_types(spark, sf):
    e = _events(spark, sf).select(*[c.strip() for c in EV_COLS.split(",")])
    return A.with_alert_types(e)


@register("alert_display_types", f"""
SELECT event_id, sentiment, rating, {DISPLAY_SQL} AS display_type FROM review_events""")
def q_alert_display_types(spark, sf):
    return _events(spark, sf).select("event_id", "sentiment", "rating", A.display_type().alias("display_type"))


@register("alert_records", f"""
 a AS (SELECT review_id, product_id, category, sentence, rating, sentiment, review_date, {TYPE_SQL} AS type
       FROM review_events WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0)))
SELECT a.review_id, a.product_id, coalesce(p.product_name, '상품명 없음') AS product_name,
       coalesce(p.brand, '브랜드 없음') AS brand, coalesce(p.price, '가격 정보 없음') AS price,
       coalesce(p.image_url, '') AS image_url, coalesce(a.category, '미분류') AS category,
       coalesce(a.sentence, '리뷰 내용 없음') AS sentence, a.rating, a.sentiment, a.type,
       coalesce(strftime(a.review_date, '%Y-%m-%d'), '날짜 없음') AS review_date, '{K.ALERT_PREFIX}' || a.type AS alert
FROM a LEFT JOIN products p ON a.product_id = p.product_id WHERE a.type IS NOT NULL""")
def q_alert_records(spark, sf):
    fx = fixture(spark, sf)
    return A.alert_records(A.with_alert_types(fx.review_events).drop("display_type"), fx.products)


RECENT = """
 neg AS (SELECT review_id, category, sentence, event_id FROM review_events WHERE sentiment = 0),
 firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id, category ORDER BY event_id) AS rn FROM neg) t
            WHERE rn = 1),
 lst AS (SELECT review_id, category, sentence, event_id, CAST(row_number() OVER (ORDER BY event_id DESC) AS INTEGER) AS pos
         FROM (SELECT * FROM firsts ORDER BY event_id DESC LIMIT 100) t)"""


def _recent(spark, sf):
    neg = _events(spark, sf).where(F.col("sentiment") == 0).select("review_id", "category", "sentence", "event_id")
    return A.recent_negatives(neg, "event_id")


@register("recent_negatives", f"""{RECENT}
SELECT * FROM lst""")
def q_recent_negatives(spark, sf):
    return _recent(spark, sf)


@register("recent_negatives_delete", f"""{RECENT},
 req AS (SELECT DISTINCT review_id FROM review_events
         WHERE sentiment = 0 AND review_date = (SELECT max(review_date) FROM review_events)),
 rk AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY pos) AS k FROM lst)
SELECT review_id, category, sentence, event_id, pos FROM rk
WHERE NOT (k = 1 AND review_id IN (SELECT review_id FROM req))""")
def q_recent_negatives_delete(spark, sf):
    e = _events(spark, sf)
    last_day = e.agg(F.max("review_date").alias("review_date"))
    req = e.where(F.col("sentiment") == 0).join(last_day, "review_date").select("review_id")
    return A.delete_first_match(_recent(spark, sf), req)


@register("parse_json_lenient", """
 f AS (SELECT event_id, CASE WHEN starts_with(stored, '{') THEN stored ELSE replace(stored, '''', '"') END AS j
       FROM stored_alerts)
SELECT event_id, json_extract_string(j, '$.review_id') AS review_id, json_extract_string(j, '$.category') AS category,
       CAST(json_extract(j, '$.sentiment') AS INTEGER) AS sentiment FROM f WHERE json_valid(j)""")
def q_parse_json_lenient(spark, sf):
    st = fixture(spark, sf).stored_alerts
    return A.parse_json_lenient(st, "stored", STORED_SCHEMA).drop("stored")


# --- streaming jobs ------------------------------------------------------------------------
def stage_events(spark, sf, files: int = 8) -> str:
    """Write the labelled events as a folder of Parquet files in event-time order
    (the landing folder the live job watches)."""
    path = scratch_path(spark, "events-src")
    ev = _events(spark, sf).select(*[f.name for f in S.EVENT_SCHEMA.fields])
    ev = ev.withColumn("event_time", F.col("event_time").cast("timestamp"))
    ev.repartitionByRange(files, "event_time", "event_id").sortWithinPartitions("event_time", "event_id") \
        .write.parquet(path)
    return path


def _stage_in_order(spark, sf, arrival, days: int) -> str:
    """Like ``stage_events``, a file per ``days`` days of arrival (seconds), written one after the other: the times of the
    files decide the order of the micro-batches."""
    path = scratch_path(spark, "arrivals")
    ev = _events(spark, sf).select(*[f.name for f in S.EVENT_SCHEMA.fields]).withColumn("event_time", F.col("event_time").cast("timestamp"))
    ev = ev.withColumn("slice", F.floor(arrival / (days * 86400)))
    for r in ev.select("slice").distinct().orderBy("slice").collect():
        ev.where(F.col("slice") == r.slice).drop("slice").repartition(1).write.mode("append").parquet(path)
    return path


# With every file in one micro-batch the send-once rule is a per-key greedy scan:
# first alert, then the first one at least an hour after the last sent. The twin
# walks it with a recursive CTE (one step per send) and keeps the lowest event id
# at each sent time, as the stream does.
TS_FMT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@register("alerts_send_once", f"""RECURSIVE
 a AS (SELECT event_time, event_id, review_id, product_id, category, sentence, sentiment, rating, {TYPE_SQL} AS type,
              review_id || chr(31) || CAST(product_id AS VARCHAR) || chr(31) || category AS k
       FROM review_events WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0))),
 s(k, t) AS (SELECT k, min(event_time) FROM a GROUP BY k
             UNION ALL
             SELECT a.k, min(a.event_time) FROM s JOIN a ON a.k = s.k AND a.event_time >= s.t + INTERVAL 1 HOUR
             GROUP BY a.k),
 pick AS (SELECT a.*, row_number() OVER (PARTITION BY a.k, a.event_time ORDER BY a.event_id) AS rn
          FROM a JOIN s ON a.k = s.k AND a.event_time = s.t)
SELECT strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time, event_id, review_id, product_id, category,
       sentence, sentiment, rating, type FROM pick WHERE rn = 1""")
def q_alerts_send_once(spark, sf):
    src = stage_events(spark, sf)
    out = scratch_path(spark, "alerts-sent")
    S.run_available_now(S.send_once(S.anomaly_stream(spark, src)), S.batch_writer(out), name="send-once")
    return (spark.read.parquet(out).drop("batch_id")
            .withColumn("event_time", F.date_format("event_time", TS_FMT)))


@register("alerts_send_once_batches", ORACLE["alerts_send_once"])
def q_alerts_send_once_batches(spark, sf):
    """The same stream over a micro-batch per ten days: same alerts, whatever the batches."""
    src, out = _stage_in_order(spark, sf, F.unix_seconds("event_time"), 10), scratch_path(spark, "alerts-sent")
    S.run_available_now(S.send_once(S.anomaly_stream(spark, src, max_files=1)), S.batch_writer(out), name="send-once-batches")
    return (spark.read.parquet(out).drop("batch_id")
            .withColumn("event_time", F.date_format("event_time", TS_FMT)))


# All keys expire together an hour after the last send: the twin walks from set to set (a set starts at the
# first alert after the one before it expired) and sends each key's first alert within a set.
@register("alerts_whole_set", f"""RECURSIVE
 a AS (SELECT *, epoch_us(event_time) AS t, review_id || chr(31) || CAST(product_id AS VARCHAR) || chr(31) || category AS k
       FROM review_events WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0))),
 e(n, t) AS (SELECT 0, min(t) FROM a UNION ALL
   SELECT n + 1, (SELECT min(a.t) FROM a WHERE a.t >= (
       SELECT min(x.t) + 3600000000 FROM (SELECT f.t, lead(f.t) OVER (ORDER BY f.t) AS nx
         FROM (SELECT min(a.t) AS t FROM a WHERE a.t >= e.t GROUP BY a.k) f) x WHERE x.nx - x.t >= 3600000000 OR x.nx IS NULL))
   FROM e WHERE e.t IS NOT NULL),
 p AS (SELECT a.*, row_number() OVER (PARTITION BY a.k, e.n ORDER BY a.t, a.event_id) AS rn
       FROM a ASOF JOIN (SELECT * FROM e WHERE t IS NOT NULL) e ON a.t >= e.t)
SELECT event_id, review_id, product_id, category FROM p WHERE rn = 1""")
def q_alerts_whole_set(spark, sf):
    src = stage_events(spark, sf)
    out = scratch_path(spark, "alerts-whole")
    S.run_available_now(S.anomaly_stream(spark, src), S.whole_set_sink(scratch_path(spark, "whole-set-state"), S.batch_writer(out)),
                        name="whole-set")
    return spark.read.parquet(out).select("event_id", "review_id", "product_id", "category")


# Arrival for the late-row jobs: every fifth event lands two days after it happened, and the landing folder gets one
# file per five days of arrival, each its own micro-batch.
DELAYED, DELAY_DAYS, SLICE_DAYS = 5, 2, 5
ARRIVALS = f"""
 arr AS (SELECT *, {TYPE_SQL} AS type,
           CAST(floor((epoch(event_time) + CASE WHEN event_id % {DELAYED} = 0 THEN {DELAY_DAYS * 86400} ELSE 0 END) / {SLICE_DAYS * 86400}) AS BIGINT) AS slice
         FROM review_events WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0))),
 bt AS (SELECT slice, row_number() OVER (ORDER BY slice) - 1 AS batch_id, max(event_time) AS hi FROM arr GROUP BY slice),
 wm AS (SELECT slice, batch_id, max(hi) OVER (ORDER BY batch_id) AS greatest,
               max(hi) OVER (ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS w FROM bt),
 sp AS (SELECT arr.*, wm.batch_id, wm.greatest, coalesce(arr.event_time < wm.w, false) AS late FROM arr JOIN wm USING (slice))"""


def _split(spark, sf) -> str:
    """Runs the job that splits late rows, a micro-batch per slice of arrival; the folder it writes."""
    arrival = F.unix_seconds("event_time") + F.when(F.col("event_id") % DELAYED == 0, DELAY_DAYS * 86400).otherwise(0)
    src, out = _stage_in_order(spark, sf, arrival, SLICE_DAYS), scratch_path(spark, "split")
    S.run_available_now(S.anomaly_stream(spark, src, max_files=1), S.split_late_sink(out), name="split-late")
    return out


@register("alerts_late_rows", f"""{ARRIVALS}
SELECT event_id, review_id, product_id, category, type, CAST(batch_id AS INTEGER) AS batch_id FROM sp WHERE late""")
def q_alerts_late_rows(spark, sf):
    return S.late_rows(spark, _split(spark, sf)).select("event_id", "review_id", "product_id", "category", "type", "batch_id")


@register("alerts_late_ledger", f"""{ARRIVALS}
SELECT CAST(batch_id AS INTEGER) AS batch_id, strftime(max(greatest), '%Y-%m-%d %H:%M:%S.%f') AS greatest,
       count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM sp GROUP BY batch_id""")
def q_alerts_late_ledger(spark, sf):
    return S.late_ledger(spark, _split(spark, sf)).select(
        "batch_id", F.date_format("greatest", TS_FMT).alias("greatest"), "on_time", "late")


@register("alerts_sent_on_time", f"""RECURSIVE {ARRIVALS},
 a AS (SELECT *, review_id || chr(31) || CAST(product_id AS VARCHAR) || chr(31) || category AS k FROM sp WHERE NOT late),
 s(k, t) AS (SELECT k, min(event_time) FROM a GROUP BY k UNION ALL
             SELECT a.k, min(a.event_time) FROM s JOIN a ON a.k = s.k AND a.event_time >= s.t + INTERVAL 1 HOUR GROUP BY a.k)
SELECT min(a.event_id) AS event_id, a.review_id, a.product_id, a.category FROM a JOIN s ON a.k = s.k AND a.event_time = s.t
GROUP BY a.review_id, a.product_id, a.category, a.event_time""")
def q_alerts_sent_on_time(spark, sf):
    """Late rows split off first, then the send-once state over what is on time: the stateful step drops nothing."""
    src, out = _split(spark, sf), scratch_path(spark, "alerts-sent")
    S.run_available_now(S.send_once(S.on_time_stream(spark, src)), S.batch_writer(out), name="send-on-time")
    return spark.read.parquet(out).select("event_id", "review_id", "product_id", "category")


@register("alerts_seen_once")
def q_alerts_seen_once(spark, sf):
    src = stage_events(spark, sf)
    out = scratch_path(spark, "alerts-seen")
    S.run_available_now(S.seen_once(S.anomaly_stream(spark, src)), S.batch_writer(out), name="seen-once")
    return spark.read.parquet(out).drop("batch_id")


def _json(*fields: str) -> str:
    """SQL text of a JSON object's fields; names ending in = are text."""
    return " || ',' || ".join(f"'\"{f[:-1]}\":\"' || {f[:-1]} || '\"'" if f.endswith("=") else f"'\"{f}\":' || CAST({f} AS VARCHAR)" for f in fields)


SENT_ALERTS = ORACLE["alerts_send_once"].split("SELECT strftime(event_time")[0].rstrip()


@register("alert_sink_messages", f"""{SENT_ALERTS},
 m AS (SELECT k.review_id, k.product_id, coalesce(p.product_name, '상품명 없음') AS product_name, coalesce(p.brand, '브랜드 없음') AS brand,
              coalesce(p.price, '가격 정보 없음') AS price, coalesce(p.image_url, '') AS image_url, k.category, k.sentence, k.rating, k.sentiment, k.type,
              strftime(k.event_time, '%Y-%m-%d') AS review_date, '{K.ALERT_PREFIX}' || k.type AS alert
       FROM pick k LEFT JOIN products p ON k.product_id = p.product_id WHERE k.rn = 1)
SELECT *, '{{' || {_json('alert=')} || ',"review":{{' || {_json('review_id=', 'product_id', 'product_name=', 'brand=', 'price=', 'image_url=', 'category=',
                                                                 'sentence=', 'rating', 'sentiment', 'type=', 'review_date=')} || '}}}}' AS message FROM m""")
def q_alert_sink_messages(spark, sf):
    fx = fixture(spark, sf)
    src = stage_events(spark, sf)
    out = scratch_path(spark, "alert-messages")
    S.run_available_now(S.send_once(S.anomaly_stream(spark, src)), S.alert_sink(fx.products, out), name="sink")
    return spark.read.parquet(out).drop("batch_id")
