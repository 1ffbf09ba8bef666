"""Text labelling: clean review text, split it into sentences, score topics and
sentiment with an injected scorer, and upsert the sentence rows.

The whole path is column expressions (codegen, no Python) with the default
scorers. A model scorer is any ``Column -> Column`` returning an array of
logits; ``model_scorer`` builds one as an Iterator pandas UDF that loads the
model once per task and scores Arrow batches, so Python work stays vectorised and
parallel across partitions. Thresholding, softmax and argmax stay in Spark SQL.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import constants as K
from ..functions import text as T
from ..functions.columns import col, sentiment_label
from ..functions.dates import as_date

Scorer = Callable[[Column], Column]
ANALYSIS_COLS = ("review_id", "product_id", "sentence", "category", "sentiment", "rating", "review_date")


def incremental_slice(reviews: DataFrame, as_of) -> DataFrame:
    """Reviews stored on ``as_of`` (a partition / pushed filter on review_date)."""
    return reviews.where(F.col("review_date") == as_date(as_of))


def sentences(df: DataFrame, text_col: str = "review_text", *, stopwords: Sequence[str],
              keep: str = T.HANGUL, window: int = 12,
              splitter: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per sentence of the cleaned text (``pos`` = 0-based sentence number).
    Cleaning removes punctuation, so the default splitter cuts fixed windows of
    ``window`` tokens; pass ``splitter`` (Column -> array<string>) to replace it."""
    cleaned = T.clean_text(text_col, keep=keep, stopwords=stopwords)
    split = splitter(cleaned) if splitter else T.token_windows(cleaned, window, single_spaced=True)
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(split).alias("pos", "sentence"))


def label_sentences(df: DataFrame, topic_scorer: Scorer = T.lexicon_topic_logits,
                    sentiment_scorer: Scorer = T.lexicon_sentiment_logits,
                    labels: Sequence[str] = K.CLASSIFIER_TOPICS, threshold: float = 0.5) -> DataFrame:
    """Add ``category`` (comma-joined labels whose sigmoid > threshold, else the
    fallback) and ``sentiment`` (argmax of the softmax, first max wins).

    Logits and probabilities are projected as their own columns first: each is
    then computed once per sentence instead of being re-inlined into every
    expression that reads it."""
    s = F.col("sentence")
    lg = df.select("*", topic_scorer(s).alias("_tl"), sentiment_scorer(s).alias("_sl"))
    pr = lg.select("*", T.softmax("_sl").alias("_sp"))
    return pr.select(*df.columns, T.topics_from_logits("_tl", labels, threshold=threshold).alias("category"),
                     T.argmax("_sp").alias("sentiment"))


def analysis_rows(reviews: DataFrame, text_col: str = "review_text", *, stopwords: Sequence[str],
                  keep: str = T.HANGUL, window: int = 12,
                  splitter: Callable[[Column], Column] | None = None,
                  topic_scorer: Scorer = T.lexicon_topic_logits,
                  sentiment_scorer: Scorer = T.lexicon_sentiment_logits,
                  labels: Sequence[str] = K.CLASSIFIER_TOPICS, threshold: float = 0.5) -> DataFrame:
    """Reviews -> flat analysis rows (sentence cut to 255 chars), with ``seq`` as
    the emission order within a review for the order-dependent upsert."""
    s = sentences(reviews.select("review_id", "product_id", text_col, "rating", "review_date"),
                  text_col, stopwords=stopwords, keep=keep, window=window, splitter=splitter)
    lab = label_sentences(s, topic_scorer, sentiment_scorer, labels, threshold)
    return lab.select("review_id", "product_id", T.truncate255("sentence").alias("sentence"), "category",
                      "sentiment", "rating", "review_date", F.col("pos").alias("seq"))


def upsert_analysis(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Insert-or-update by ``keys``: on a hit only category and sentiment change.

    Inside the batch the first row (in ``order``) gives sentence, rating and date,
    the last row gives category and sentiment; a stored row keeps its own
    sentence, rating and date and takes the batch's category and sentiment."""
    keys = list(keys)
    updated = [c for c in ("category", "sentiment") if c not in keys]
    kept = [c for c in ANALYSIS_COLS if c not in keys and c not in updated]
    b = batch.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in kept],
                                 *[F.max_by(c, order).alias(c) for c in updated])
    if existing is None:
        return b.select(*ANALYSIS_COLS)
    e = existing.select(*ANALYSIS_COLS).withColumn("_e", F.lit(True))
    b = b.withColumn("_b", F.lit(True))
    j = e.alias("e").join(b.alias("b"), keys, "full_outer")
    has_e, has_b = F.col("_e").isNotNull(), F.col("_b").isNotNull()
    out = []
    for c in ANALYSIS_COLS:
        if c in keys:
            out.append(F.col(c))
        elif c in kept:
            out.append(F.when(has_e, F.col(f"e.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(has_b, F.col(f"b.{c}")).otherwise(F.col(f"e.{c}")).alias(c))
    return j.select(*out)


def with_sentiment_label(df: DataFrame, labels: dict = K.SENTIMENT_LABELS,
                         default: str = K.UNKNOWN_SENTIMENT_LABEL) -> DataFrame:
    return df.withColumn("sentiment_label", sentiment_label("sentiment", labels, default))


def class_centroids(df: DataFrame, vector: str, cls: Column, n_classes: int) -> list[list[float]]:
    """Mean vector of each class 0..n_classes-1 over all rows: the model of an embedding classifier
    (one map-side combined aggregation; the driver holds classes x dimensions numbers)."""
    parts = df.select(cls.alias("_c"), F.posexplode(vector).alias("_i", "_v")).where(F.col("_c").between(0, n_classes - 1))
    rows = parts.groupBy("_c", "_i").agg(F.avg(F.col("_v").cast("double")).alias("m")).collect()
    means = {(r["_c"], r["_i"]): r["m"] for r in rows}
    dim = 1 + max((i for _, i in means), default=-1)
    return [[means.get((c, i), 0.0) for i in range(dim)] for c in range(n_classes)]


def centroid_logits(vector, centroids: Sequence[Sequence[float]]) -> Column:
    """Per class, the dot product of the whole vector with the class's centroid."""
    def dot(m):
        terms = F.zip_with(col(vector), F.array(*[F.lit(float(x)) for x in m]), lambda v, w: v.cast("double") * w)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.array(*[dot(m) for m in centroids])


def model_scorer(load_model: Callable[[], Callable[[list[str]], list[list[float]]]],
                 batch_rows: int = 256) -> Scorer:
    """A scorer backed by any Python model: ``load_model()`` runs once per task
    and returns ``predict(list_of_sentences) -> list_of_logit_lists``. Sentences
    arrive as Arrow batches; nothing is scored row by row across the JVM boundary."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load_model()
        for s in batches:
            texts = s.fillna("").tolist()
            out: list = []
            for i in range(0, len(texts), batch_rows):
                out.extend(predict(texts[i:i + batch_rows]))
            yield pd.Series([list(map(float, r)) for r in out])
    return lambda c: score(c)
