"""Literal edge cases per operator (FIXTURES.md §2) on tiny hand-made frames."""
import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from revspark.functions import constants as K
from revspark.functions import text as T
from revspark.functions.columns import round_half_even
from revspark.functions.dates import relative_date
from revspark.functions.sizes import normalise_size
from revspark.operators import alerts as A
from revspark.operators import anomalies as H
from revspark.operators import ingest as I
from revspark.operators import labels as L
from revspark.operators import scorers as SC
from revspark.operators import scores as S
from revspark.operators import search as Q
from revspark.operators import sizes as Z

D = dt.date


def one_col(spark, values, name="x", typ="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {typ}")


@pytest.mark.parametrize("raw,expected", [
    ("(19)Goofy Black · 225 구매", "19"), ("DARK GREY(401) · 225 구매", "401"), ("230~240", "230"),
    ("40.5", "40.5"), ("xl", "XL"), ("M 구매", "M"), ("블랙 225", "225"), ("225구매", "225"),
    ("블랙260", "260"), ("(90)(105)", "105"), ("", "-"), ("사이즈 정보 없음", "-"),
])
def test_size_rules(spark, raw, expected):
    got = one_col(spark, [raw]).select(normalise_size("x").alias("y")).first().y
    assert got == expected


def test_relative_dates(spark):
    cases = {"오늘": D(2025, 3, 17), "어제": D(2025, 3, 16), "3일 전": D(2025, 3, 14), "24.12.31": D(2024, 12, 31),
             "x일 전": None, "24.13.01": None, "방금": None}
    df = one_col(spark, list(cases)).select("x", relative_date("x", "2025-03-17").alias("d"))
    assert {r.x: r.d for r in df.collect()} == cases


def test_clean_text_hangul(spark):
    df = one_col(spark, ["좋아요ㅋㅋㅋ!! 100%", "너무 예뻐요", "abc", None])
    got = [r.y for r in df.select(T.clean_text("x", stopwords=("너무", "두 말")).alias("y")).collect()]
    assert got == ["좋아요", "예뻐요", "", ""]


def test_token_windows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = one_col(spark, [text, ""]).select(T.token_windows("x", 12).alias("w")).collect()
    assert [len(s.split()) for s in got[0].w] == [12, 12, 1]
    assert got[1].w == []


def test_topic_threshold(spark):
    df = spark.createDataFrame([([-1.0] * 6,), ([0.0] * 6,), ([2.0, -1.0, 3.0, -1.0, -1.0, -1.0],)], "l array<double>")
    got = [r.c for r in df.select(T.topics_from_logits("l").alias("c")).collect()]
    assert got == ["기타", "기타", "가성비,디자인"]


def test_argmax_first_max(spark):
    df = spark.createDataFrame([([1.0, 1.0, 0.0],), ([0.0, 0.5, 2.0],)], "l array<double>")
    assert [r.s for r in df.select(T.argmax(T.softmax("l")).alias("s")).collect()] == [0, 2]


def test_alert_types(spark):
    df = spark.createDataFrame([(0, 5.0), (0, 3.0), (1, 2.0), (2, 3.0), (1, 4.0)], "sentiment int, rating double")
    got = [r.t for r in df.select(A.alert_type().alias("t")).collect()]
    assert got == [K.ALERT_NEGATIVE, K.ALERT_NEGATIVE, K.ALERT_LOW_RATING, K.ALERT_LOW_RATING, None]


def test_topic_caps(spark):
    six = ",".join(K.SCORE_TOPICS)
    df = spark.createDataFrame([(six, 0, D(2001, 7, 18)), ("a,, b", 1, D(2001, 7, 18))],
                               "category string, sentiment int, review_date date")
    day = {r.category: r["count"] for r in H.topic_counts(df, "day", cap=5).collect()}
    week = {r.category: r["count"] for r in H.topic_counts(df, "week", cap=None).collect()}
    assert sum(v for k, v in day.items() if k in K.SCORE_TOPICS) == 5
    assert sum(v for k, v in week.items() if k in K.SCORE_TOPICS) == 6
    assert day["a"] == day["b"] == 1 and "" not in day


def _brand_rows(spark, n, sentiment=2, topic="디자인"):
    an = spark.createDataFrame([(i, 1, topic, sentiment) for i in range(n)],
                               "review_id long, product_id long, category string, sentiment int")
    pr = spark.createDataFrame([(1, "B")], "product_id long, brand string")
    return an, pr


@pytest.mark.parametrize("n,score", [(29, 70.0), (30, 85.0), (99, 85.0), (100, 95.0), (299, 95.0), (300, 100.0)])
def test_brand_count_ladder(spark, n, score):
    an, pr = _brand_rows(spark, n)
    assert S.brand_scores(an, pr).first().overall_score == score


def test_brand_all_negative_variants(spark):
    """All-negative brand: the topic score is 0; batch scoring ignores zero scores
    (minimum defaults to 0 -> 0.8), the single-brand page uses it (also 0.8)."""
    an, pr = _brand_rows(spark, 40, sentiment=0)
    assert S.brand_scores(an, pr, all_brands=True).first().overall_score == 0.0
    assert S.brand_scores(an, pr, all_brands=False).first().rating == K.GRADE_LOW


def test_brand_without_rows(spark):
    an, _ = _brand_rows(spark, 0)
    pr = spark.createDataFrame([(1, "B"), (2, "C")], "product_id long, brand string")
    an = spark.createDataFrame([(1, 1, "디자인", 2)] * 30, "review_id long, product_id long, category string, sentiment int")
    got = {r.brand: (r.overall_score, r.rating, r.review_count) for r in S.brand_scores(an, pr).collect()}
    assert got["C"] == (0.0, K.GRADE_LOW, 0)


def test_profile_three_month_day_counts_twice(spark):
    an = spark.createDataFrame([(1, 1, 5.0, D(2025, 2, 28)), (2, 1, 4.0, D(2025, 5, 28))],
                               "review_id long, product_id long, rating double, review_date date")
    pr = spark.createDataFrame([(1, "p", "B")], "product_id long, product_name string, brand string")
    r = S.product_profile(an, pr, "2025-05-28").first()
    assert (r.recent_reviews, r.past_reviews) == (2, 1)


def test_upsert_semantics(spark):
    old = spark.createDataFrame([(1, 10, 5.0, "a", D(2020, 1, 1), "M"), (2, 20, 4.0, "b", D(2020, 1, 1), "L")],
                                "review_id long, product_id long, rating double, review_text string, review_date date, review_size string")
    new = spark.createDataFrame([(1, 99, None, "a", "M"), (3, 30, 3.0, "c", "S")],
                                "review_id long, product_id long, rating double, review_text string, review_size string")
    got = {r.review_id: r for r in I.upsert_reviews(old, new, "2025-03-17").collect()}
    assert got[1].product_id == 10 and got[1].rating is None and got[1].review_date == D(2025, 3, 17)
    assert got[2].review_date == D(2020, 1, 1)
    assert got[3].review_date == D(2025, 3, 17)
    m = I.upsert_metrics(old, new).first()
    assert (m.before_count, m.already_existing, m.unchanged, m.after_count, m.inserted) == (2, 1, 0, 3, 1)


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([(1, 10, 5.0, "a", D(2020, 1, 1), "M")],
                                "review_id long, product_id long, rating double, review_text string, review_date date, review_size string")
    new = spark.createDataFrame([(1, 10, 4.0, "z", "M"), (2, 20, 3.0, "c", "S")],
                                "review_id long, product_id long, rating double, review_text string, review_size string")
    once = I.upsert_reviews(old, new, "2025-03-17")
    twice = I.upsert_reviews(once, new, "2025-03-17")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_analysis_upsert_order(spark):
    rows = spark.createDataFrame(
        [(1, 1, "first", "t", 0, 5.0, D(2025, 1, 1), 1), (1, 1, "second", "t", 2, 4.0, D(2025, 1, 2), 2)],
        "review_id long, product_id long, sentence string, category string, sentiment int, rating double, review_date date, seq int")
    r = L.upsert_analysis(None, rows, ["review_id", "category"], "seq").first()
    assert (r.sentence, r.sentiment, r.rating) == ("first", 2, 5.0)


def test_lenient_json(spark):
    df = one_col(spark, ['{"review_id": "1", "sentiment": 0}', "{'review_id': '2'}", '{"review_id": "3"',
                         " {'review_id': '4', 'sentiment': 1}"], "stored")
    schema = StructType([StructField("review_id", StringType()), StructField("sentiment", IntegerType())])
    got = sorted(r.review_id for r in A.parse_json_lenient(df, "stored", schema).collect())
    assert got == ["1", "4"]


def test_product_search_filters(spark):
    pr = spark.createDataFrame([(1, "n", "1,234,000", "C", "b", "공용", ""), (2, "n", "90,000", "C", "b", "여자", ""),
                                (3, "n", None, "C", "b", "남자", "")],
                               "product_id long, product_name string, price string, category string, brand string, gender string, image_url string")
    an = spark.createDataFrame([(i, p, 2) for p in (1, 2, 3) for i in range(3)], "review_id long, product_id long, sentiment int")
    men = {r.product_id for r in Q.product_search(pr, an, gender="남자").collect()}
    assert men == {1}                     # 공용 counts for men; NULL price never in range
    other = {r.product_id for r in Q.product_search(pr, an, gender="?", price_max=100000).collect()}
    assert other == {2}


def test_size_mode_empty(spark):
    empty = spark.createDataFrame([], "review_size string")
    assert Z.size_mode(empty).first().most_frequent_size == "N/A"


def test_recent_list_cap(spark):
    rows = spark.createDataFrame([(str(i % 150), "c", "s", i) for i in range(400)],
                                 "review_id string, category string, sentence string, event_id long")
    lst = A.recent_negatives(rows, "event_id").collect()
    assert len(lst) == 100 and lst[0].pos == 1
    assert max(r.event_id for r in lst) == 149        # first arrival per key only


def test_delete_reports_misses(spark):
    listing = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "pos int, review_id string")
    req = spark.createDataFrame([("a",), ("x",), ("x",)], "review_id string")
    assert [r.review_id for r in A.delete_misses(listing, req).collect()] == ["x"]
    assert sorted(r.pos for r in A.delete_first_match(listing, req).collect()) == [2, 3]


def test_no_python_in_column_operators(spark):
    df = one_col(spark, ["(19)x · 225 구매"]).select(normalise_size("x"), T.clean_text("x", stopwords=("너무",)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_rounding_equals_python(spark):
    ratios = [(a, b) for b in (7, 40, 64, 160, 1000, 2000, 3000, 9999, 10000) for a in range(0, b + 1)]
    df = spark.createDataFrame(ratios, "a long, b long").select("a", "b", (F.col("a") / F.col("b") * 100).alias("p"), (F.col("a") / F.col("b")).alias("q"))
    got = df.select("a", "b", round_half_even("p", 1).alias("r1"), round_half_even("q", 2).alias("r2"), round_half_even("p", 3).alias("r3")).collect()
    bad = [r for r in got if (r.r1, r.r2, r.r3) != (round(r.a / r.b * 100, 1), round(r.a / r.b, 2), round(r.a / r.b * 100, 3))]
    assert not bad
    odd = [0.05, 0.15, 0.25, 0.35, -0.05, -0.15, -0.25, 2.675, 1e300, 2.0 ** 53, 1e15 + 0.5]
    vals = [r.y for r in one_col(spark, odd, typ="double").select(round_half_even("x", 1).alias("y")).collect()]
    assert vals == [round(x, 1) for x in odd]
    assert one_col(spark, [None], typ="double").select(round_half_even("x", 1).alias("y")).first().y is None


def test_text_scorer(spark):
    rows = [("good shoe fits well", 2), ("very good and light", 2), ("bad sole broke", 0), ("bad smell and broke", 0), (None, None)]
    df = spark.createDataFrame(rows * 5, "text string, label int")
    got = SC.text_sentiment(df, SC.fit_text_scorer(df, features=1 << 10)).collect()
    assert len(got) == 25 and all(r.sentiment == r.label for r in got if r.label is not None)
    with pytest.raises(ValueError):
        SC.fit_text_scorer(df.where("label > 9"))


def test_centroid_logits_read_whole_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], 0), ([0.0, 0.0, 1.0], 1), ([0.0, 0.0, 3.0], 1)], "v array<double>, c int")
    model = L.class_centroids(df, "v", F.col("c"), 3)
    assert model == [[1.0, 0.0, 0.0], [0.0, 0.0, 2.0], [0.0, 0.0, 0.0]]
    assert [r.l for r in df.select(L.centroid_logits("v", model).alias("l")).collect()] == [[1.0, 0.0, 0.0], [0.0, 2.0, 0.0], [0.0, 6.0, 0.0]]


def test_dates_and_options_as_their_plain_forms(spark):
    """The pattern in front of the date's parse leaves out no text that it takes; trimming equals the regex over all white space."""
    part = ["", "0", "1", "01", "001", "9", "12", "012", "13", "1a", " 1", "-1", "+1", "28", "29", "30", "31", "031", "32", "٣"]
    texts = [f"{y}.{m}.{d}" for y in ("24", "25", "2", "025", " 24") for m in part for d in part] + ["24.3", "24.3.1.", "24.3.1\n", "24.3.1 10:00", "."]
    df = one_col(spark, texts).select(relative_date("x", "2025-03-17").alias("d"), F.try_to_date(F.concat(F.lit("20"), "x"), "yyyy.M.d").alias("p"))
    assert df.where("NOT d <=> p").count() == 0 and df.where("d IS NOT NULL").count() > 50
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    cases = [None, "", "a"] + [s + "a" + s + "b" + s + " " + s for s in spaces] + spaces + ["​a​", "﻿a"]
    got = one_col(spark, cases).select("x", T.strip_ws("x").alias("s")).collect()
    assert {r.x: r.s for r in got} == {c: c if c is None else c.strip() for c in cases}
