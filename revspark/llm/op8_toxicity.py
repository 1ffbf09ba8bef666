"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word prefixes is fitted from texts confirmed as toxic and from
unlabelled texts: any other document, with or without a label, toxic or not. With ``prior`` the share of toxic
documents, ``c`` that of confirmed ones and U the others, of which ``(prior - c) / (1 - c)`` are toxic, the risk is
``prior * R_P(+) + max(0, (1 - c) * R_U(-) - (prior - c) * R_P(-))``; where the second part turns negative the
step undoes it, as the non-negative estimator asks. Before, features are screened: those at least
``MIN_TOXIC`` toxic texts hold and that are ``LIFT`` times as frequent there as in texts that are not toxic (their
frequency in U less what its toxic part adds).

Fitting takes at most ``FIT_TOXIC`` + ``FIT_OTHER`` rows, chosen by a hash of doc_id, outside the held-out
third (crc32(doc_id) mod 3 = 1). The prior is a parameter; else it is counted over the labels outside the held-out
third where they hold texts known as not toxic, and estimated from the two samples where they hold confirmed
texts only (``toxic_share``). Scoring reads whole texts. Labels, language, source and doc_id are no inputs of a score.

Cases: null and empty texts get the score of no features (low); a null doc_id isn't held out and takes no
part in fitting; without toxic labels every score is 0; repeated rows are scored alike; extra columns
are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import one_text_each, table
from .features import Adam, Rows, linear, packed, sigmoid

BITS = 20
FIT_TOXIC, FIT_OTHER = 3000, 6000
MIN_TOXIC, LIFT = 4, 4.0
SURE = 4.0
STEPS, RATE = 600, 0.1
TOXIC_AT = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxic_share(toxic: Rows, other: Rows, width: int) -> float:
    """Share of toxic texts in ``other``: the least ratio of the shares of ``other`` and of ``toxic`` above
    a score (with the sampling errors of both), as toxic texts are above it as often in ``other``. The
    score of each half of the rows is taken from the other half, by features ``SURE`` standard errors more
    frequent in toxic texts; 0 where no feature is, or where the score tells nothing."""
    p, u, found = [], [], False
    for side in (0, 1):
        nt, no = (toxic.n + 1 - side) // 2, (other.n + 1 - side) // 2
        if not nt or not no:
            return 0.0
        ct, co = (np.bincount(r.col[r.row % 2 == side], minlength=width) for r in (toxic, other))
        a, b = ct / nt, co / no
        error = np.sqrt((ct + co + 1) / (nt + no) * (1 / nt + 1 / no))
        lift = np.log((ct + 0.5) / (nt + 1)) - np.log((co + 0.5) / (no + 1))
        weights = np.where((ct >= MIN_TOXIC) & (a - b >= SURE * error) & (a >= 2 * b), lift, 0.0)
        found = found or weights.any()
        p.append(toxic.dot(weights)[1 - side::2])
        u.append(other.dot(weights)[1 - side::2])
    if not found:
        return 0.0
    p, u = np.sort(np.concatenate(p)), np.sort(np.concatenate(u))
    above_p, above_u = 1 - np.searchsorted(p, p) / len(p), 1 - np.searchsorted(u, p) / len(u)
    error = 2 * np.sqrt(above_p * (1 - above_p) / len(p)) + 2 * np.sqrt((above_u * (1 - above_u) + 1 / len(u)) / len(u))
    best = np.argmin(np.where(above_p >= 0.1, (above_u + error) / above_p, np.inf))
    return float(min(above_u[best] / above_p[best], 1.0)) if above_u[best] < 1 else 0.0


def fit_nnpu(toxic: Rows, other: Rows, prior: float, confirmed: float, width: int) -> tuple[np.ndarray, float]:
    """Weights over ``width`` hashed features and a bias. ``prior``: the share of toxic documents in all;
    ``confirmed``: that of confirmed ones; ``other`` is drawn from the documents not confirmed."""
    weights = np.zeros(width)
    if not toxic.n:
        return weights, -40.0
    share = (prior - confirmed) / max(1 - confirmed, 1e-9)               # toxic ones in other
    ct, co = toxic.counts(width), other.counts(width)
    clean = np.maximum(co - share * other.n * ct / toxic.n, 0.0)
    lift = (ct / toxic.n) / ((clean + 1.0) / max(other.n * (1 - share), 1))
    chosen = np.flatnonzero((ct >= min(MIN_TOXIC, max(1, toxic.n // 4))) & (lift >= LIFT))
    index = np.full(width, -1, np.int64)
    index[chosen] = np.arange(len(chosen))
    toxic.keep(index)
    other.keep(index)
    k = len(chosen)
    w = np.zeros(k + 1)
    w[k] = -1.0
    adam = Adam(k + 1, RATE)
    for _ in range(STEPS):
        p = sigmoid(toxic.dot(w[:k]) + w[k])             # sigmoid loss: l(z, +) = 1 - p, l(z, -) = p
        u = sigmoid(other.dot(w[:k]) + w[k])
        dp, du = p * (1 - p) / toxic.n, u * (1 - u) / max(other.n, 1)
        gp = np.append(toxic.back(dp, k), dp.sum())
        gu = (1 - confirmed) * np.append(other.back(du, k), du.sum()) - (prior - confirmed) * gp
        negative = (1 - confirmed) * u.mean() - (prior - confirmed) * p.mean() if other.n else 0.0
        w = adam.step(w, gu - prior * gp if negative >= 0 else -gu)
    weights[chosen] = w[:k]
    return weights, float(w[k])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> tuple[np.ndarray, float]:
    """Fit on bounded samples of confirmed and of all other documents outside the held-out third."""
    free = ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    rows = labels.filter(free).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    n, hits = rows.agg(F.count("toxic"), F.count_if(F.col("toxic") == 1)).first()
    if not hits:
        return fit_nnpu(Rows([]), Rows([]), 0.0, 0.0, 1 << BITS)
    known = rows.filter("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(1))
    ids = docs.filter(free).select("doc_id").distinct().join(known, "doc_id", "left")
    n_docs, n_known = ids.agg(F.count(F.lit(1)), F.count("toxic")).first()
    order = F.xxhash64("doc_id", F.lit(8))
    pick = (ids.filter("toxic = 1").orderBy(order, "doc_id").limit(FIT_TOXIC)
            .union(ids.filter("toxic is null").orderBy(order, "doc_id").limit(FIT_OTHER)))
    found = one_text_each(docs, pick, ["toxic"])
    sample = found.mapInArrow(lambda it: packed(it, BITS, ["doc_id", "toxic"]), "doc_id long, toxic int, features binary").collect()
    sample.sort(key=lambda r: (r.doc_id, r.features))
    toxic, other = Rows([r.features for r in sample if r.toxic == 1]), Rows([r.features for r in sample if r.toxic is None])
    confirmed = n_known / n_docs if n_docs else 0.0
    if prior is None:
        prior = hits / n if hits < n else confirmed + (1 - confirmed) * toxic_share(toxic, other, 1 << BITS)
    return fit_nnpu(toxic, other, min(max(prior, confirmed), 1.0), confirmed, 1 << BITS)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """docs(doc_id, text, ...) -> the same columns and score."""
    weights, bias = model
    some = np.flatnonzero(weights)
    handle = docs.sparkSession.sparkContext.broadcast((some, weights[some], bias))

    def run(batches):
        at, w, b0 = handle.value
        full = np.zeros(1 << BITS)
        full[at] = w
        for b in batches:
            s = sigmoid(linear(b.column("text"), full, BITS) + b0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of ``docs`` that score below ``TOXIC_AT``, with all their columns."""
    weights, bias = model
    some = np.flatnonzero(weights)
    handle = docs.sparkSession.sparkContext.broadcast((some, weights[some], bias))

    def run(batches):
        at, w, b0 = handle.value
        full = np.zeros(1 << BITS)
        full[at] = w
        for b in batches:
            yield b.filter(pa.array(sigmoid(linear(b.column("text"), full, BITS) + b0) < TOXIC_AT))
    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
