"""Default text scorer: hashed words and a multinomial logistic regression of Spark ML.

Fitting is distributed; scoring is one projection over all rows (JVM-side). The result is a logit per
class, read by the same softmax and argmax as any injected scorer."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FIT_ROWS = 200_000            # rows a fit reads, in expectation; a table with fewer is used whole


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))


def fit_text_scorer(labelled: DataFrame, text: str = "text", label: str = "label", *, features: int = 1 << 16,
                    fit_rows: int = FIT_ROWS, max_iter: int = 20) -> PipelineModel:
    """Fit on rows with a label (classes 0, 1, ...; a class may be absent); NULL text counts as empty."""
    rows = _texts(labelled.where(F.col(label).isNotNull()).select(text, F.col(label).cast("double").alias("_label")), text)
    n = rows.count()
    if n == 0:
        raise ValueError("no labelled row to fit on")
    if n > fit_rows:
        rows = rows.sample(fraction=fit_rows / n, seed=1)
    steps = [RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+"),
             HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True),
             LogisticRegression(featuresCol="_features", labelCol="_label", rawPredictionCol="_raw", family="multinomial",
                                maxIter=max_iter, regParam=0.001)]
    return Pipeline(stages=steps).fit(rows)


def with_text_logits(df: DataFrame, model: PipelineModel, text: str = "text", out: str = "logits") -> DataFrame:
    """Every row with its logits (array<double>)."""
    scored = model.transform(_texts(df, text))
    return scored.select(*df.columns, vector_to_array("_raw").alias(out))


def text_sentiment(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """Every row with ``sentiment``: the first class of greatest probability."""
    return with_text_logits(df, model, text, "_logits").select(*df.columns, T.argmax(T.softmax("_logits")).alias("sentiment"))
