"""Sources and sinks (A1, A4-A6, A8, A9), page extraction (B9) and the pipeline."""
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revspark.functions import constants as K
from revspark.functions import text as T
from revspark.plans.pipeline import PipelineConfig, run_pipeline
from revspark.session import scratch_path
from revspark.sources import io
from revspark.sources.pages import page_reviews


def _landing(spark, rows):
    return spark.createDataFrame(rows, io.LANDING_SCHEMA)


def test_save_day_accumulates_keep_last(spark):
    path = scratch_path(spark, "t-day")
    schema = StructType(io.LANDING_SCHEMA.fields + [StructField("ord", LongType())])  # a copy: add() mutates
    b1 = spark.createDataFrame([("1", "p", "5", "a", "2025-03-17", "M", 1), ("2", "p", "4", "b", "2025-03-17", "L", 2)], schema)
    io.save_day(spark, b1, path, "ord", schema=schema)
    b2 = spark.createDataFrame([("1", "p", "3", "a2", "2025-03-17", "M", 3)], schema)
    out = {r.review_id: r.rating for r in io.save_day(spark, b2, path, "ord", schema=schema).collect()}
    assert out == {"1": "3", "2": "4"}


def test_empty_batch_writes_typed_file(spark):
    path = scratch_path(spark, "t-empty")
    io.empty_typed(spark, io.LANDING_SCHEMA).write.parquet(path)
    df = spark.read.parquet(path)
    assert df.count() == 0 and df.columns == [f.name for f in io.LANDING_SCHEMA.fields]


def test_read_landing_partition(spark):
    path = scratch_path(spark, "t-landing")
    _landing(spark, [("1", "p", "5", "a", "2025-03-17", "M")]).write.parquet(f"{path}/dt=20250317")
    _landing(spark, [("2", "p", "5", "a", "2025-03-18", "M")]).write.parquet(f"{path}/dt=20250318")
    assert [r.review_id for r in io.read_landing(spark, path, "20250318").collect()] == ["2"]


def test_day_partitions_and_existence(spark):
    path = scratch_path(spark, "t-parts")
    df = spark.createDataFrame([(1, dt.date(2025, 3, 17)), (2, dt.date(2025, 3, 18))], "review_id long, review_date date")
    io.write_day_partitions(df, path)
    io.write_day_partitions(spark.createDataFrame([(3, dt.date(2025, 3, 18))], "review_id long, review_date date"), path)
    got = sorted(r.review_id for r in spark.read.parquet(path).collect())
    assert got == [1, 3]                      # only the rewritten day changed
    assert io.day_exists(spark, path, "2025-03-17") and not io.day_exists(spark, path, "2025-03-19")


def test_csv_roundtrip_multiline(spark):
    path = scratch_path(spark, "t-csv")
    df = _landing(spark, [("1", "p", "5", 'line one\n"quoted", two', "2025-03-17", "M")])
    io.write_csv(df, path)
    back = io.read_csv(spark, path, io.LANDING_SCHEMA).first()
    assert back.review_text == 'line one\n"quoted", two'


def test_json_ready(spark):
    df = spark.createDataFrame([(1, dt.date(2025, 3, 17))], "id int, d date").withColumn(
        "x", F.lit(1.005).cast("decimal(10,3)"))
    row = json.loads(io.to_json_lines(df).first().json)
    assert row == {"id": 1, "d": "2025-03-17 00:00:00", "x": 1.0}


def test_json_ready_nested(spark):
    df = spark.range(1).select(F.struct(F.lit("1.256").cast("decimal(10,3)").alias("x"), F.lit("2025-03-17").cast("date").alias("d")).alias("s"),
                               F.array(F.struct(F.lit("2025-03-18").cast("date").alias("e"))).alias("a"),
                               F.create_map(F.lit("k"), F.lit("2.5").cast("decimal(4,1)")).alias("m"),
                               F.lit(None).cast("struct<d date>").alias("n"), F.lit(3).alias("b.c"))
    row = json.loads(io.to_json_lines(df).first().json)
    assert row == {"s": {"x": 1.26, "d": "2025-03-17 00:00:00"}, "a": [{"e": "2025-03-18 00:00:00"}], "m": {"k": 2.5}, "b.c": 3}


def test_pipeline_takes_scorers_and_splitter(spark):
    base = scratch_path(spark, "t-cfg")
    flag = lambda s: F.array(F.when(s.contains("good"), 1.0).otherwise(-1.0), F.lit(-1.0))
    cfg = PipelineConfig(f"{base}/landing", f"{base}/reviews", f"{base}/daily", f"{base}/analysis", stopwords=("the",),
                         keep=T.LATIN_TEST_CLASS, splitter=lambda c: F.split(c, " but "), topic_scorer=flag, sentiment_scorer=flag,
                         labels=("praise", "other"))
    _landing(spark, [("1", "10", "5", "the good shoe but bad fit", "2025-03-17", "260")]).write.parquet(f"{cfg.landing_path}/dt=20250317")
    run_pipeline(spark, cfg, "2025-03-17")
    got = {r.sentence: (r.category, r.sentiment) for r in spark.read.parquet(cfg.daily_path).collect()}
    assert got["good shoe"] == ("praise", 0) and got["bad fit"][0] != "praise" and len(got) == 2


def page_rows(spark, *htmls):
    df = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    return sorted(map(tuple, page_reviews(df).collect()))


def test_page_blocks_with_fallbacks(spark):
    html = ('<div data-content-id="r1"><span class="rating">4</span><span class="x date">오늘</span>'
            '<div class="review-text">좋아요 <b>정말</b> 커요</div><span class="option">FREE</span>'
            '<span class="option">260 구매</span></div>'
            '<div data-content-id="r2"><p>no fields</p></div>'
            '<div data-content-id=""><span class="review-content"></span><span class="review-text">later</span></div>')
    rows = page_rows(spark, html)
    assert rows[0] == (0, 0, "r1", "4", "오늘", "좋아요 정말 커요", "FREE", "260 구매")
    assert rows[1] == (0, 1, "r2", K.DEFAULT_RATING, None, K.DEFAULT_REVIEW_TEXT, None, None)
    assert rows[2][2] == K.DEFAULT_REVIEW_ID and rows[2][5] == ""        # found but empty: stays empty


def test_page_article_paragraphs(spark):
    html = ("<html><script>var t='<p>x</p>';</script><nav><p>menu</p></nav><!-- <p>c</p> --><article><p>One <b>two</b> three."
            "<p>A &amp;lt; &#48;&#x41;&#xD800; &#; B<p> </p><p>Two</article><p>foot</p>")
    assert [r[5] for r in page_rows(spark, html)] == ["One two three.", "A &lt; 0A&#xD800; &#; B", "Two"]


def test_page_fields_end_at_their_own_tag(spark):
    block = '<div data-content-id="r1">{}</div>'
    text = lambda x: page_rows(spark, block.format(x))[0][5]
    assert text('<div class="review-content">one<div>two</div> <DIV><div >three</div></Div> four</div> five') == "one two three four"
    assert text('<div class="review-content">one<divider>two</divider><div/>x</div> y') == "one two x y"        # <div/> opens one
    assert text('<span class="review-text">a<span class="review-text">b</span>c</span>d') == "a b c"
    assert text('<img class="review-text" src=x>later') == ""
    assert text('<p class="review-text">never closed <b>x</b>') == "never closed x"
    sizes = page_rows(spark, block.format('<b class="option">a<b class="option">b</b></b><i class="option">c</i>'))[0]
    assert sizes[6:] == ("a b", "b")


def test_page_references(spark):
    block = '<p>{}</p>'
    text = lambda x: page_rows(spark, block.format(x))[0][5]
    assert text("caf&eacute; &rsquo; &amp;lt; &hearts;&NotEqualTilde; &copy 2 &copyright &bogus; &; & x &#233;&#x41; &lt") == \
        "café ’ &lt; ♥≂̸ © 2 &copyright &bogus; &; & x éA <"


def test_page_nested_articles(spark):
    nested = "<p>x</p><article><p>a</p><article><p>b</p></article><p>c</p></article><p>foot</p><article><p>d</p></article>"
    assert [r[5] for r in page_rows(spark, nested)] == ["a", "b", "c", "d"]


def test_page_edges(spark):
    deep = "<div>" * 5000 + "<p>in" + "</div>" * 5000
    nested = "<article><p>a</p><article><p>b</p></article></article>"
    rows = page_rows(spark, None, "", "no markup", deep, nested)
    assert [(r[0], r[2], r[5]) for r in rows] == [(3, "3-0", "in"), (4, "4-0", "a"), (4, "4-1", "b")]
    empty = page_rows(spark, "<p></p><p>x</p>")
    assert [(r[1], r[2]) for r in empty] == [(1, "0-1")]


def test_pipeline_idempotent(spark):
    base = scratch_path(spark, "t-pipe")
    cfg = PipelineConfig(f"{base}/landing", f"{base}/reviews", f"{base}/daily", f"{base}/analysis",
                         stopwords=(), keep=T.LATIN_TEST_CLASS)
    rows = [("1", "10", "5", "good price and design", "2025-03-17", "260 구매"),
            ("2", "11", "1", "bad size not fit", "2025-03-17", "M 구매")]
    _landing(spark, rows).write.parquet(f"{cfg.landing_path}/dt=20250317")
    m1 = run_pipeline(spark, cfg, "2025-03-17").first()
    a1 = sorted(map(tuple, spark.read.parquet(cfg.analysis_path).collect()))
    m2 = run_pipeline(spark, cfg, "2025-03-17").first()
    a2 = sorted(map(tuple, spark.read.parquet(cfg.analysis_path).collect()))
    assert (m1.inserted, m2.inserted, m2.already_existing) == (2, 0, 2)
    assert a1 == a2 and len(a1) == 2


def test_read_table_prunes_and_filters(spark):
    path = scratch_path(spark, "t-table")
    _landing(spark, [("1", "p", "5", "a", "2025-03-17", "M"), ("2", "q", "4", "b", "2025-03-18", "L")]).write.parquet(path)
    df = io.read_table(spark, "parquet", ["review_id", "rating"], F.col("rating") == "4", path=path)
    assert [tuple(r) for r in df.collect()] == [("2", "4")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(rating), EqualTo(rating,4)]" in plan


def test_stage_and_balanced(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    staged = io.stage(df.groupBy("x").count(), "t-stage")
    assert staged.count() == 7
    one = spark.range(10).coalesce(1)
    assert io.balanced(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism * 2
    many = spark.range(10).repartition(spark.sparkContext.defaultParallelism)
    assert io.balanced(many).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_ingest_stream_runs_pipeline(spark):
    from revspark.streaming import alerts as SA
    from revspark.streaming.ingest import ingest_stream, pipeline_sink
    base = scratch_path(spark, "t-ingest")
    cfg = PipelineConfig(f"{base}/landing", f"{base}/reviews", f"{base}/daily", f"{base}/analysis",
                         stopwords=(), keep=T.LATIN_TEST_CLASS)
    _landing(spark, [("1", "10", "5", "good design", "2025-03-17", "260 구매")]).write.parquet(cfg.landing_path)
    _landing(spark, [("2", "11", "2", "bad size", "2025-03-17", "M 구매")]).write.mode("append").parquet(cfg.landing_path)
    metrics = f"{base}/metrics"
    SA.run_available_now(ingest_stream(spark, cfg, "2025-03-17", max_files=1),
                         pipeline_sink(cfg, "2025-03-17", metrics), name="t-ingest")
    assert sorted(r.review_id for r in spark.read.parquet(cfg.reviews_path).collect()) == [1, 2]
    assert spark.read.parquet(cfg.analysis_path).count() == 2
    assert spark.read.parquet(metrics).agg(F.sum("inserted")).first()[0] == 2


def test_replace_table_keeps_a_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    assert io.read_if_exists(spark, path) is None
    io.replace_table(spark.range(3).toDF("id"), path)
    io.replace_table(spark.read.parquet(path).union(spark.range(3, 5).toDF("id")), path)      # reads what it replaces
    assert spark.read.parquet(path).count() == 5
    (tmp_path / "t").rename(tmp_path / "t.previous")                    # a driver lost between the renames
    assert io.read_if_exists(spark, path).count() == 5
    for f in (tmp_path / "t").glob("*.parquet"):
        f.write_bytes(b"broken")
    with pytest.raises(Exception):
        io.read_if_exists(spark, path).count()


def test_string_ids_survive_a_rerun(spark, tmp_path):
    base = str(tmp_path)
    cfg = PipelineConfig(f"{base}/landing", f"{base}/reviews", f"{base}/daily", f"{base}/analysis", stopwords=(), id_type="string", keep=T.LATIN_TEST_CLASS)
    _landing(spark, [("r-a1", "p-1", "5", "good design", "2025-03-17", "260"),
                     ("r-b2", "p-2", "2", "bad size", "2025-03-17", "M")]).write.parquet(f"{cfg.landing_path}/dt=20250317")
    for _ in range(2):
        run_pipeline(spark, cfg, "2025-03-17")
    assert sorted(r.review_id for r in spark.read.parquet(cfg.reviews_path).collect()) == ["r-a1", "r-b2"]


def test_empty_day_resets_its_partition(spark, tmp_path):
    df = spark.sql("select 'x' a, date'2025-03-17' review_date union all select 'y', date'2025-03-18'")
    io.write_day_partitions(df, str(tmp_path))
    io.write_day_partitions(df.limit(0), str(tmp_path), day="2025-03-17")
    assert not io.day_exists(spark, str(tmp_path), "2025-03-17") and io.day_exists(spark, str(tmp_path), "2025-03-18")


def test_balanced_counts_rows_not_splits(spark, tmp_path):
    """One row group in a file that is cut into many splits is read by one task: its rows are dealt out, evenly."""
    import os
    path, cores = str(tmp_path / "one"), spark.sparkContext.defaultParallelism
    spark.range(20000).selectExpr("id", "repeat(md5(cast(id as string)), 4) as text").coalesce(1).write.parquet(path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size // (2 * cores))
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 2 * cores
        even = io.balanced(df)
        per = [r["count"] for r in even.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per) == 20000 and max(per) * cores <= 2 * 20000
        assert even.columns == ["id", "text"] and even.agg(F.sum("id")).first()[0] == 20000 * 19999 // 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_landing_rows_convert_each_date_once(spark):
    """The filter on the converted date stays above the conversion, also where the date text is an expression."""
    import __spark_entry__ as E
    for q in ("field_defaults", "cutoff_filter"):
        plan = E.queries()[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("gettimestamp") == 1, q


def test_crawls_are_read_from_landed_rows(spark, monkeypatch):
    """landing_accumulate makes its landing rows once, not twice per crawl."""
    import __spark_entry__ as E
    seen, step = [], io.accumulate_day
    monkeypatch.setattr(io, "accumulate_day", lambda c, new, *a, **k: (seen.extend(new.inputFiles()), step(c, new, *a, **k))[1])
    E.queries()["landing_accumulate"](spark, "/root/testdata/sf0.001")
    assert seen and not [f for f in seen if "lineitem" in f]
