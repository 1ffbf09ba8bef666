"""Registered source and sink queries (A1, A3, A5, A6, A8, B12, I2, I10, I11): each job writes what it names and reads it back."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as I
from ..session import scratch_path
from ..sources import fixture, io
from ..streaming import alerts as S
from ..streaming.ingest import ingest_stream, pipeline_sink
from .params import AS_OF
from .pipeline import PipelineConfig, run_pipeline
from .q_alerts import TYPE_SQL, _stage_in_order
from .q_ingest import LANDED, RCOLS
from .q_labels import STOP_TEST
from .registry import register

DAYS = ("2001-07-17", "2001-07-18")


def _landed_days(spark, sf) -> str:
    """The landing folder: landing rows under the day they came in (the review's own day here)."""
    path = scratch_path(spark, "landing")
    fx = fixture(spark, sf)
    for day in DAYS:
        rows = I.landing_rows(fx.landing.where(F.col("review_date") == F.lit(day).cast("date")), day, None)
        rows.write.parquet(f"{path}/dt={day.replace('-', '')}")
    io.empty_typed(spark, io.LANDING_SCHEMA).write.parquet(f"{path}/dt=20010719")          # A5: a day without rows
    return path


def _landed_sql(day: str) -> str:
    """``landed`` as of another day, of that day's rows."""
    return LANDED.replace(AS_OF, day).replace("FROM landing", f"FROM landing WHERE review_date = DATE '{day}'")


@register("landing_read_day", f"""{_landed_sql(DAYS[0])}
SELECT {RCOLS} FROM landed WHERE review_date IS NOT NULL""")
def q_landing_read_day(spark, sf):
    """A1: one day of the landing folder."""
    return io.read_landing(spark, _landed_days(spark, sf), DAYS[0].replace("-", ""))


@register("landing_read_all", f"""{_landed_sql(DAYS[0])}, {_landed_sql(DAYS[1]).strip().replace('landed AS', 'landed2 AS', 1)}
SELECT substr(dt, 1, 8) AS dt, {RCOLS} FROM (SELECT '{DAYS[0].replace('-', '')}' AS dt, * FROM landed UNION ALL
  SELECT '{DAYS[1].replace('-', '')}', * FROM landed2) t WHERE review_date IS NOT NULL""")
def q_landing_read_all(spark, sf):
    """A1, A5: the whole folder, with a typed empty day in it."""
    df = io.read_landing(spark, _landed_days(spark, sf))
    return df.withColumn("dt", F.regexp_extract(F.col("_metadata.file_path"), r"dt=(\d+)", 1)).select("dt", *I.REVIEW_COLS)


@register("staging_replace", "SELECT review_id, product_id, rating FROM reviews WHERE rating >= 4")
def q_staging_replace(spark, sf):
    """A3: the staging table holds the last batch only."""
    rows, path = fixture(spark, sf).reviews.select("review_id", "product_id", "rating"), scratch_path(spark, "staging")
    for batch in (rows.where("rating < 4"), rows.where("rating >= 4")):
        io.write_staging(batch, "parquet", path)
    return io.read_table(spark, "parquet", path=path)


@register("day_partitions_rewrite", f"""
SELECT review_id, product_id, sentence, CASE WHEN review_date = DATE '{AS_OF}' THEN 2 ELSE sentiment END AS sentiment, strftime(review_date, '%Y-%m-%d') AS review_date
FROM review_analysis WHERE review_date BETWEEN DATE '2001-07-12' AND DATE '{AS_OF}' AND review_date <> DATE '2001-07-13'""")
def q_day_partitions_rewrite(spark, sf):
    """A week by day; one day is written again, one is reset, the others stay."""
    path = scratch_path(spark, "days")
    week = fixture(spark, sf).review_analysis.where(F.col("review_date").between(F.lit("2001-07-12").cast("date"), F.lit(AS_OF).cast("date"))) \
        .select("review_id", "product_id", "sentence", "sentiment", "review_date")
    io.write_day_partitions(week, path)
    io.write_day_partitions(week.where(F.col("review_date") == F.lit(AS_OF).cast("date")).withColumn("sentiment", F.lit(2)), path)
    io.write_day_partitions(week.limit(0), path, day="2001-07-13")
    return spark.read.parquet(path).withColumn("review_date", F.date_format("review_date", "yyyy-MM-dd"))


@register("csv_exchange", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def q_csv_exchange(spark, sf):
    """Whole documents, with line breaks and quotes, through CSV files."""
    d, path = fixture(spark, sf).table("documents").select("doc_id", "text", "lang", "source", "n_chars"), scratch_path(spark, "csv")
    io.write_csv(d, path)
    return io.read_csv(spark, path, d.schema)


@register("pipeline_skips_empty_day", f"""
SELECT CAST(0 AS BIGINT) AS metrics_rows, count(*) AS reviews FROM reviews WHERE review_date < DATE '{AS_OF}'""")
def q_pipeline_skips_empty_day(spark, sf):
    """A day on which nothing landed leaves the tables as they are and reports nothing."""
    base = scratch_path(spark, "empty-day")
    cfg = PipelineConfig(*[f"{base}/{n}" for n in ("landing", "reviews", "daily", "analysis")], stopwords=STOP_TEST)
    stored = fixture(spark, sf).reviews.where(F.col("review_date") < F.lit(AS_OF).cast("date"))
    stored.write.parquet(cfg.reviews_path)
    io.empty_typed(spark, io.LANDING_SCHEMA).write.parquet(f"{cfg.landing_path}/dt={AS_OF.replace('-', '')}")
    m = run_pipeline(spark, cfg, AS_OF)
    return spark.read.parquet(cfg.reviews_path).agg(F.count(F.lit(1)).alias("reviews")).select(F.lit(m.count()).alias("metrics_rows"), "reviews")


# The exact seen-ids rule over three micro-batches (ten days each): the twin walks the batches as the job does.
SLICES = f"""
 a AS (SELECT review_id, event_id, event_time, CAST(floor(epoch(event_time) / 864000) AS BIGINT) AS slice FROM review_events
       WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0)) AND {TYPE_SQL} IS NOT NULL)"""


def _seen_twin(batches: int = 4) -> str:
    """One CTE pair per batch: what passes, and the list of the last 100 ids after it."""
    sql = SLICES + ",\n o AS (SELECT slice, row_number() OVER (ORDER BY slice) - 1 AS b FROM (SELECT DISTINCT slice FROM a) t)"
    sql += ",\n l0 AS (SELECT CAST(NULL AS VARCHAR) AS review_id, 0 AS pos WHERE false)"
    for b in range(batches):
        sql += f""",
 f{b} AS (SELECT a.*, {b} AS batch_id FROM a JOIN o USING (slice) WHERE o.b = {b} AND review_id NOT IN (SELECT review_id FROM l{b})),
 l{b + 1} AS (SELECT review_id, row_number() OVER (ORDER BY g, t, e DESC) AS pos FROM (
   SELECT review_id, 0 AS g, event_time AS t, event_id AS e FROM f{b} UNION ALL SELECT review_id, 1, NULL, -pos FROM l{b}) u QUALIFY pos <= 100)"""
    return sql + "\n" + " UNION ALL ".join(f"SELECT event_id, review_id, batch_id FROM f{b}" for b in range(batches))


@register("alerts_seen_ids", _seen_twin())
def q_alerts_seen_ids(spark, sf):
    """I2, exact: rows whose id is not among the last 100 processed ones, batch by batch."""
    src, out = _stage_in_order(spark, sf, F.unix_seconds("event_time"), 10), scratch_path(spark, "seen-out")
    S.run_available_now(S.anomaly_stream(spark, src, max_files=1), S.seen_ids_sink(scratch_path(spark, "seen-ids"), S.batch_writer(out)), name="seen-ids")
    return spark.read.parquet(out).select("event_id", "review_id", "batch_id")


@register("alerts_forgotten", f"""
 a AS (SELECT review_id, product_id, category, event_time FROM review_events WHERE (sentiment = 0 OR rating IN (1.0, 2.0, 3.0)) AND event_time < TIMESTAMP '2024-01-02')
SELECT run, review_id, product_id, category, strftime(min(event_time), '%Y-%m-%d %H:%M:%S.%f') AS first_sent
FROM a, (SELECT unnest([0, 1]) AS run) r GROUP BY ALL""")
def q_alerts_forgotten(spark, sf):
    """A new checkpoint forgets what was sent, so the first alert of each key goes out again."""
    src = _stage_in_order(spark, sf, F.unix_seconds("event_time"), 365)
    day = S.anomaly_stream(spark, src).where("event_time < timestamp'2024-01-02'")
    runs = []
    for run in range(2):
        out = scratch_path(spark, f"forgotten-{run}")
        S.run_available_now(S.send_once(day), S.batch_writer(out), name=f"forget-{run}")
        runs.append(spark.read.parquet(out).withColumn("run", F.lit(run)))
    return (runs[0].unionByName(runs[1]).groupBy("run", "review_id", "product_id", "category")
            .agg(F.date_format(F.min("event_time"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_sent")))


@register("ingest_stream_reviews", f"""{_landed_sql(DAYS[0])}, {_landed_sql(DAYS[1]).strip().replace('landed AS', 'landed2 AS', 1)},
 u AS (SELECT review_id FROM landed WHERE review_date IS NOT NULL UNION SELECT review_id FROM landed2 WHERE review_date IS NOT NULL)
SELECT CAST(review_id AS BIGINT) AS review_id, '{AS_OF}' AS review_date FROM u""")
def q_ingest_stream_reviews(spark, sf):
    """The landing folder as a stream into the pipeline; the stored reviews afterwards."""
    base = scratch_path(spark, "ingest")
    cfg = PipelineConfig(_landed_days(spark, sf), *[f"{base}/{n}" for n in ("reviews", "daily", "analysis")], stopwords=STOP_TEST)
    S.run_available_now(ingest_stream(spark, cfg, AS_OF), pipeline_sink(cfg, AS_OF), name="ingest")
    return spark.read.parquet(cfg.reviews_path).select("review_id", F.date_format("review_date", "yyyy-MM-dd").alias("review_date"))
