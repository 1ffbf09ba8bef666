"""Reusable Column expressions (all JVM-side, codegen-friendly)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def topic_list(category="category") -> Column:
    """Comma-joined topic string -> array of space-trimmed topics (blank entries
    kept). Trimming the whole string and splitting on ' *, *' equals splitting on
    ',' and trimming each part, without a per-element lambda (codegen-friendly)."""
    return F.split(F.trim(col(category)), " *, *")


def count_in(arr: Column, value) -> Column:
    """Occurrences of ``value`` in ``arr``: native array functions, no lambda."""
    return F.size(arr) - F.size(F.array_remove(arr, value))


def is_anomaly(sentiment="sentiment", rating="rating") -> Column:
    """Anomaly predicate: negative sentiment or a 1-3 rating."""
    return (col(sentiment) == 0) | col(rating).isin(1.0, 2.0, 3.0)


def code_label(code, labels: dict, default: str | None) -> Column:
    """Map a small integer code to a label, ``default`` when unknown."""
    m = F.create_map(*[x for k, v in sorted(labels.items()) for x in (F.lit(k), F.lit(v))])
    out = m[col(code)]
    return F.coalesce(out, F.lit(default)) if default is not None else out


def sentiment_label(code="sentiment", labels: dict = K.SENTIMENT_LABELS,
                    default: str = K.UNKNOWN_SENTIMENT_LABEL) -> Column:
    return code_label(code, labels, default)


def grade(score) -> Column:
    s = col(score)
    return F.when(s < 60, K.GRADE_LOW).when(s < 80, K.GRADE_MID).otherwise(K.GRADE_HIGH)


def ymd(c) -> Column:
    """Dates leave the engine as ``yyyy-MM-dd`` text."""
    return F.date_format(col(c), "yyyy-MM-dd")


def round_half_even(x, digits: int) -> Column:
    """A double rounded to ``digits`` places as Python's ``round`` does: by its exact binary value, so
    0.15 (just below the tie) gives 0.1 and 0.05 (just above) 0.1; true ties go to the even digit.

    ``bround`` decides ties on the shortest decimal text instead; the number formatter works on the
    exact value, and reading its text back gives the nearest double."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", col(x).cast("double"), F.lit(pattern)).cast("double")


def largest_number_string(arr) -> Column:
    """Among digit strings, the one with the largest value; first one wins ties."""
    a = col(arr)
    return F.aggregate(
        a, F.element_at(a, 1),
        lambda acc, x: F.when(x.try_cast("decimal(38,0)") > acc.try_cast("decimal(38,0)"), x)
        .otherwise(acc))


def nonempty(c) -> Column:
    """'' -> NULL (regexp_extract yields '' on no match)."""
    return F.nullif(col(c), F.lit(""))
