"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 to 2: 0 for poor texts, 1 for good but toxic ones, 2 for good ones. One weight per
hashed word or word prefix is shared by all grades; ordered thresholds ``c_1 < c_2`` turn a text's
score s into tail probabilities ``P(grade >= k) = sigmoid(s - c_k)``. They give the expected grade, and
the tail probability by which texts are selected. Thresholds are fitted as a first one and positive
gaps, so they stay ordered.

Fitting takes at most ``FIT_ROWS`` labelled documents, chosen by a hash of doc_id; scoring reads whole texts
of all rows.

Cases: null and empty texts have no features and score 0; without ratings all are selected; a rating
without quality is no rating; null doc_ids and repeated rows are ordinary rows; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import one_text_each, table
from .features import Adam, Rows, linear, packed, sigmoid

BITS = 18
GRADES = 3
FIT_ROWS = 8000
MIN_TEXTS, STEPS, RATE, SHRINK = 5, 150, 0.05, 1e-5
SELECT_GRADE, SELECT_AT = 1, 0.5


def fit_ordinal(rows: Rows, grade: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by maximum likelihood with shrinkage."""
    weights, cuts = np.zeros(width), np.full(GRADES - 1, -40.0)
    if not len(grade):
        return weights, cuts
    size = np.sqrt(np.maximum(np.bincount(rows.row, minlength=rows.n), 1))
    chosen = np.flatnonzero(rows.counts(width) >= MIN_TEXTS)
    index = np.full(width, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    rows.keep(index)
    k = len(chosen)
    tail = np.array([np.clip((grade >= j).mean(), 0.01, 0.99) for j in range(1, GRADES)])
    start = -np.log(tail / (1 - tail))
    v = np.zeros(k + GRADES - 1)                  # weights, first threshold, logs of the gaps
    v[k], v[k + 1:] = start[0], np.log(np.maximum(np.diff(start), 0.05))
    adam = Adam(len(v), RATE)
    # bounds of the interval of a grade: sigmoid(s - c_g) - sigmoid(s - c_{g+1})
    for _ in range(STEPS):
        gap = np.exp(v[k + 1:])
        cuts = v[k] + np.concatenate([[0.0], np.cumsum(gap)])
        s = rows.dot(v[:k]) / size
        up = np.concatenate([[-np.inf], cuts])[grade]      # text is at or above this threshold
        down = np.concatenate([cuts, [np.inf]])[grade]     # and below this one
        a, b = sigmoid(s - up), sigmoid(s - down)
        like = np.maximum(a - b, 1e-9)
        da, db = a * (1 - a), b * (1 - b)
        ds = -(da - db) / like / rows.n                    # of the mean negative log likelihood
        dc = np.zeros(GRADES - 1)
        for j in range(GRADES - 1):
            dc[j] = ((da / like)[grade == j + 1].sum() - (db / like)[grade == j].sum()) / rows.n
        g = np.empty_like(v)
        g[:k] = rows.back(ds / size, k) + SHRINK * v[:k]
        g[k] = dc.sum()
        g[k + 1:] = gap * np.cumsum(dc[::-1])[::-1][1:]
        v = adam.step(v, g)
    weights[chosen] = v[:k]
    return weights, v[k] + np.concatenate([[0.0], np.cumsum(np.exp(v[k + 1:]))])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    grade = F.col("quality") * (2 - F.coalesce(F.col("toxic"), F.lit(0)))
    pick = (labels.filter("doc_id is not null and quality is not null").select("doc_id", grade.cast("int").alias("grade"))
            .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(FIT_ROWS))
    found = one_text_each(docs, pick, ["grade"])
    sample = found.mapInArrow(lambda it: packed(it, BITS, ["doc_id", "grade"]), "doc_id long, grade int, features binary").collect()
    sample.sort(key=lambda r: (r.doc_id, r.features))
    return fit_ordinal(Rows([r.features for r in sample]), np.array([r.grade for r in sample], np.int64), 1 << BITS)


def grade_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs -> doc_id, expected_grade, tail (P(grade >= SELECT_GRADE)), selected."""
    handle = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches):
        weights, cuts = handle.value
        weights = weights.astype(float)
        for b in batches:
            s = linear(b.column("text"), weights, BITS, scale=True)
            tails = sigmoid(s[:, None] - cuts[None, :])
            tail = tails[:, SELECT_GRADE - 1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tail),
                                              pa.array(tail >= SELECT_AT)], names=["doc_id", "expected_grade", "tail", "selected"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, expected_grade double, tail double, selected boolean")


def op3_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    return grade_texts(docs, train(docs, table(spark, sf_dir, "labels")))
