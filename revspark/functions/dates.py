"""Relative review-date text -> date, relative to an explicit ``as_of``."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .columns import col


# Of texts that 'yyyy.M.d' takes behind the century none is left out; others are told apart by it, as a parse that fails is dear.
YMD = r"^[0-9]{2}\.0*([1-9]|1[0-2])\.0*([1-9]|[12][0-9]|3[01])$"


def as_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = dt.date.fromisoformat(d)
    return F.lit(d)


def relative_date(text, as_of) -> Column:
    """Tests in order: contains today-word -> as_of; yesterday-word -> as_of-1;
    'N일 전' -> as_of-N (NULL when N is not an integer); yy.MM.dd ->
    20yy.MM.dd (NULL when invalid); else NULL."""
    t = col(text)
    a = as_date(as_of)
    n = F.trim(F.replace(t, F.lit(K.DAYS_AGO_SUFFIX), F.lit(""))).try_cast("int")
    return (F.when(t.contains(K.TODAY_WORD), a)
            .when(t.contains(K.YESTERDAY_WORD), F.date_sub(a, 1))
            .when(t.contains(K.DAYS_AGO_SUFFIX), F.date_sub(a, n))
            .when(t.rlike(YMD), F.try_to_date(F.concat(F.lit("20"), t), "yyyy.M.d"))
            .otherwise(F.lit(None).cast("date")))


def week_start(d) -> Column:
    """Monday of the ISO week."""
    return F.to_date(F.date_trunc("week", col(d)))


def month_start(d) -> Column:
    return F.trunc(col(d), "month")
