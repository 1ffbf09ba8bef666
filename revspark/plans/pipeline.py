"""The bulk-load pipeline (B13): landing Parquet -> de-duplicate -> upsert reviews
(+ load metrics) -> label the day's reviews -> daily and cumulative analysis.

``run_batch`` is the incremental form: its three tables are hashed by review_id in a ``Store``, a batch reads and
rewrites only the buckets it touches, and reviews, daily and cumulative analysis become visible together. ``run_pipeline`` is the form over
three plain Parquet tables.

One Spark application, one logical plan per step. Tables live as Parquet below
caller-given paths. Each step that replaces a table it has just read writes the new version beside it and
swaps them (``io.replace_table``); only a missing table counts as not created yet, an unreadable
one raises. Re-running a day is idempotent: the upsert is
keyed and the day's analysis partition is overwritten dynamically.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import ingest as I
from ..operators import labels as L
from ..sources import io
from ..sources.store import Store, bucket_of


METRICS_DDL = ("before_count long, batch_count long, already_existing long, unchanged long, "
               "after_count long, inserted long, verdict string")
METRICS = [c.split()[0] for c in METRICS_DDL.split(", ")]


@dataclass(frozen=True)
class PipelineConfig:
    landing_path: str               # day folders of crawler output (all-string rows)
    reviews_path: str               # the reviews table (Parquet)
    daily_path: str                 # daily analysis, partitioned by review_date
    analysis_path: str              # cumulative analysis
    stopwords: Sequence[str]        # tokens that the cleaner drops
    id_type: str = "bigint"         # ids of the stored tables; "string" where they are not numbers
    keep: str = T.HANGUL            # kept character class of the cleaner
    window: int = 12                # tokens per sentence window
    splitter: Callable[[Column], Column] | None = None       # cleaned text -> sentences, instead of windows
    topic_scorer: L.Scorer = T.lexicon_topic_logits
    sentiment_scorer: L.Scorer = T.lexicon_sentiment_logits
    labels: Sequence[str] = K.CLASSIFIER_TOPICS              # in the order of the topic scorer's logits
    threshold: float = 0.5


def load_batch(spark: SparkSession, landing: DataFrame, cfg: PipelineConfig, as_of) -> tuple[DataFrame, DataFrame]:
    """Upsert one landing batch into reviews; returns (metrics, reviews)."""
    # staged once: the metrics and the upsert must see the same survivors
    batch = io.stage(I.typed_batch(I.dedup_any(landing), cfg.id_type), "batch")
    old = io.read_if_exists(spark, cfg.reviews_path)
    if old is None:
        old = spark.createDataFrame([], batch.withColumn("review_date", F.lit(None).cast("date"))
                                    .select(*I.REVIEW_COLS).schema)
    # One row, taken before the table it describes is replaced.
    m = I.upsert_metrics(old, batch)
    metrics = spark.createDataFrame(m.collect(), m.schema)
    reviews = io.replace_table(I.upsert_reviews(old, batch, as_of), cfg.reviews_path)
    return metrics, reviews


def label_day(spark: SparkSession, reviews: DataFrame, cfg: PipelineConfig, as_of) -> DataFrame:
    """Label the reviews stored on ``as_of``; write the day's analysis partition
    (key review_id, sentence) and upsert the cumulative table (review_id, category)."""
    rows = L.analysis_rows(L.incremental_slice(reviews, as_of), stopwords=cfg.stopwords, keep=cfg.keep, window=cfg.window,
                           splitter=cfg.splitter, topic_scorer=cfg.topic_scorer, sentiment_scorer=cfg.sentiment_scorer,
                           labels=cfg.labels, threshold=cfg.threshold)
    daily = L.upsert_analysis(None, rows, ["review_id", "sentence"], "seq")
    io.write_day_partitions(daily, cfg.daily_path, day=as_of)
    old = io.read_if_exists(spark, cfg.analysis_path)
    cumulative = L.upsert_analysis(old, rows, ["review_id", "category"], "seq")
    return io.replace_table(cumulative, cfg.analysis_path)


def run_pipeline(spark: SparkSession, cfg: PipelineConfig, as_of, landing: DataFrame | None = None) -> DataFrame:
    """Land -> process -> label for one day. Returns the load metrics row."""
    if landing is None:
        day = str(as_of).replace("-", "")
        landing = io.read_landing(spark, cfg.landing_path, day)
    if landing.isEmpty():          # B12: nothing landed, nothing to do
        return spark.createDataFrame([], METRICS_DDL)
    metrics, reviews = load_batch(spark, landing, cfg, as_of)
    label_day(spark, reviews, cfg, as_of)
    return metrics


# --- incremental form: one commit for three tables -------------------------------------------
BUCKETS = 64                        # of each table; a bucket should stay below some hundred MB


def _no_reviews(spark: SparkSession, batch: DataFrame) -> DataFrame:
    return spark.createDataFrame([], batch.withColumn("review_date", F.lit(None).cast("date")).select(*I.REVIEW_COLS).schema)


def run_batch(store: Store, cfg: PipelineConfig, as_of, landing: DataFrame, batch_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Upsert one landing batch, label its reviews and publish the store's tables ``reviews``, ``daily``
    (parts day.bucket) and ``analysis`` together. Returns the load metrics row (none for an empty batch).

    A batch id that was published before changes nothing and returns its metrics. Only the batch's reviews are labelled: the
    day's other rows are kept, as labels depend on their own review alone. The caller must give a
    store always the same number of buckets."""
    spark = store.spark
    done = store.result_of(batch_id)
    if done is not None:
        return spark.createDataFrame([tuple(done[c] for c in METRICS)], METRICS_DDL)
    if landing.isEmpty():
        return spark.createDataFrame([], METRICS_DDL)
    batch = io.stage(I.typed_batch(I.dedup_any(landing), cfg.id_type), "batch")
    commit, merged = store.begin(batch_id), []

    def upsert(old: DataFrame | None, new: DataFrame) -> DataFrame:
        old = _no_reviews(spark, new) if old is None else old
        merged.append(I.upsert_metrics(old, new).first())
        return I.upsert_reviews(old, new, as_of)
    before = commit.base["tables"].get("reviews", {"parts": {}})["parts"]
    touched = commit.merge("reviews", batch, "review_id", buckets, upsert)
    rest = [p for p in before if p not in set(touched)]
    others = commit.read("reviews", rest).count() if rest else 0           # from file footers
    metrics = merged[0].asDict()
    metrics["before_count"] += others
    metrics["after_count"] += others

    ids = batch.select("review_id")
    reviews = commit.read("reviews", touched).join(ids, "review_id", "left_semi")
    rows = io.stage(L.analysis_rows(reviews, stopwords=cfg.stopwords, keep=cfg.keep, window=cfg.window, splitter=cfg.splitter,
                                    topic_scorer=cfg.topic_scorer, sentiment_scorer=cfg.sentiment_scorer, labels=cfg.labels,
                                    threshold=cfg.threshold), "labelled")
    day_part = lambda p: f"{as_of}.{p}"
    daily, old = L.upsert_analysis(None, rows, ["review_id", "sentence"], "seq"), commit.read("daily", [day_part(p) for p in touched])
    if old is not None:
        daily = daily.unionByName(old.join(ids, "review_id", "left_anti").select(*daily.columns))
    commit.put("daily", daily, F.concat(F.lit(f"{as_of}."), bucket_of("review_id", buckets)), [day_part(p) for p in touched])
    commit.merge("analysis", rows, "review_id", buckets,
                 lambda old, new: L.upsert_analysis(old, new, ["review_id", "category"], "seq"))
    commit.publish(metrics)
    return spark.createDataFrame([tuple(metrics[c] for c in METRICS)], METRICS_DDL)
