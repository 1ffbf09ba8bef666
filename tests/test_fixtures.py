"""The fixture views as Spark builds them hold the rows of their SQL texts, with one narrow shuffle behind them."""
import datetime as dt
import os

from pyspark.sql import functions as F

from revspark.operators import ingest as I
from revspark.operators import rollups as R
from revspark.operators import sizes as Z
from revspark.operators.known_ids import KnownIds
from revspark.sources import fixtures as X
from revspark.sources import io
from revspark.sources.store import Store

LINEITEM = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
            "l_discount double, l_returnflag string, l_shipdate timestamp")


def _tables(spark, path):
    day = lambda i: dt.datetime(1998, 1, 1 + i % 28)
    rows = [(i % 50, i % 7, i % 9, i % 11, float(i % 48 + 1), 100.0 + i, (i % 10) / 100, "ANR"[i % 3], day(i)) for i in range(700)]
    rows += [rows[3]] * 2 + [(None, 1, 2, 3, 4.0, 5.0, 0.01, "A", day(1)), (7, None, 8, 3, 4.0, 5.0, 0.01, "A", day(2)),
                             (200, 1, None, None, None, None, None, None, None), (200, 1, 3, 1, 2.0, 3.0, 0.02, "N", day(3))]
    spark.createDataFrame(rows, LINEITEM).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(i, f"n{i}", f"Brand#{i % 25}", "T", i, 900.0 + i) for i in range(9)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double") \
        .write.parquet(f"{path}/part.parquet")


def test_views_hold_the_rows_of_their_texts(spark, tmp_path):
    _tables(spark, tmp_path)
    fx = X.Fixture(spark, str(tmp_path))
    plain = {n: spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("lineitem", "part")}
    for name, text in X.VIEWS[:6]:
        plain[name] = spark.sql(text, **{n: d for n, d in plain.items() if "{" + n + "}" in text})
        got = fx.table(name)
        assert got.columns == plain[name].columns
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(got) == rows(plain[name]) and got.count() > 0, name


def test_only_shuffled_views_are_written(spark, tmp_path):
    _tables(spark, tmp_path)
    fx = X.Fixture(spark, str(tmp_path))
    for name in ("products", "reviews_raw", "reviews", "landing", "review_analysis", "labelled_rows"):
        fx.table(name).count()
    assert sorted(os.listdir(fx.root)) == ["review_analysis", "reviews_base"]
    plan = fx._reviews_base()._jdf.queryExecution().executedPlan().toString()
    shuffle = plan[plan.index("Exchange hashpartitioning"):]
    assert plan.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in plan
    assert "repeat(" not in shuffle and "concat_ws" not in shuffle.split("TakeOrderedAndProject")[0]


def _rows(df):
    return sorted(map(str, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_grow_with_the_rows(spark, tmp_path, monkeypatch):
    """The views' shuffles, F5, F8, F10, F13, F15, F18, F19: more rows make more pieces, not larger ones; same rows."""
    assert [io.pieces(spark, n * io.PIECE_ROWS) for n in (0, 8, 9, 200)] == [None, None, 9, 200]
    _tables(spark, tmp_path)
    plain = {n: X.Fixture(spark, str(tmp_path)).table(n) for n in ("reviews_base", "review_analysis")}
    monkeypatch.setattr(io, "PIECE_ROWS", 30)
    fx = X.Fixture(spark, str(tmp_path))
    assert "24), REPARTITION_BY_NUM" in _plan(fx._reviews_base())                          # 706 rows
    for name, df in plain.items():
        assert _rows(fx.table(name)) == _rows(df), name
    n = io.pieces(spark, fx.reviews.count())
    stats = Z.size_stats(fx.review_analysis, fx.reviews, pieces=n)
    assert f"{n}), REPARTITION_BY_NUM" in _plan(stats) and _rows(stats) == _rows(Z.size_stats(fx.review_analysis, fx.reviews))


def test_both_analysis_rows_come_from_one_join(spark, tmp_path, monkeypatch):
    _tables(spark, tmp_path)
    fx = X.Fixture(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(fx._review_analysis())
        assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and "Union" not in plan
        monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
        assert "Broadcast" not in _plan(fx._review_analysis()) and _rows(fx._review_analysis()) == _rows(fx.review_analysis)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_row_a_key_in_pieces(spark, tmp_path, monkeypatch):
    rows = [(i % 300, i, f"t{i % 7}") for i in range(900)] + [(None, i, "n") for i in range(5)] + [(7, 1000 + i, "hot") for i in range(400)]
    df = spark.createDataFrame(rows, "review_id long, ord long, review_text string")
    monkeypatch.setattr(io, "PIECE_ROWS", 50)
    for dedup in (I.dedup_keep_last, I.dedup_keep_first):
        got = dedup(df, "ord", counted=df)
        assert _rows(got) == _rows(dedup(df, "ord"))
        plan = _plan(got)
        assert "27), REPARTITION_BY_NUM" in plan and "Union" in plan                      # the hot key is reduced before its shuffle
    few = df.where("review_text <> 'hot'")
    plan = _plan(I.dedup_keep_last(few, "ord", counted=few))
    assert plan.count("Exchange") == 1 and "Union" not in plan
    known = KnownIds(Store(spark, str(tmp_path)), pages=8, parts=4)
    c = known.store.begin("h")
    known.add(c, spark.range(100).toDF("review_id"))
    c.publish()
    old = spark.range(100).toDF("review_id")
    assert _rows(known.new_rows(df, "ord")) == _rows(I.new_reviews(df, old, "ord"))
    old = few.select("review_id", F.lit(1).alias("product_id"), F.lit(2.0).alias("rating"), "review_text", F.lit("s").alias("review_size"))
    m = I.upsert_metrics(old, old.where("review_id % 2 = 0 OR review_id IS NULL"), pieces=11)
    assert "11), REPARTITION_BY_NUM" in _plan(m)
    assert _rows(m) == _rows(I.upsert_metrics(old, old.where("review_id % 2 = 0 OR review_id IS NULL")))


def test_cells_are_put_in_pieces(spark, tmp_path, monkeypatch):
    rows = [(i, i % 9, "c", i % 3, float(i % 5 + 1), dt.date(1998, 1 + i % 5, 1 + i % 28)) for i in range(600)]
    ra = spark.createDataFrame(rows, "review_id long, product_id long, category string, sentiment int, rating double, review_date date")
    monkeypatch.setattr(io, "PIECE_ROWS", 20)
    store = Store(spark, str(tmp_path))
    for i in range(2):
        c = store.begin(f"b{i}")
        assert len(R.apply_changes(c, ra.where(f"review_id % 2 = {i}"))) == 5
        c.publish()
    assert _rows(store.read(R.TABLE)) == _rows(R.cells(ra))
    assert len([f for f in os.listdir(f"{tmp_path}/data/{R.TABLE}/v=2/_part=1998-01") if f.endswith(".parquet")]) > 1
