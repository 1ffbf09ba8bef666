"""The store of parts: incremental merges, one commit for several tables, and a driver lost at any step."""
import pytest
from pyspark.sql import functions as F

from revspark.functions import text as T
from revspark.operators import ingest as I
from revspark.plans.pipeline import PipelineConfig, run_batch, run_pipeline
from revspark.session import scratch_path
from revspark.sources import io
from revspark.sources.store import Store, bucket_of


def _files(store, table):
    entry = store.manifest()["tables"][table]
    return {p: io.folder_names(store.spark, store.part_path(table, p, v)) for p, v in entry["parts"].items()}


def _keep_last(old, new):
    return new if old is None else old.join(new, "id", "left_anti").unionByName(new)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.begin("first")
    c.merge("t", spark.range(200).withColumn("v", F.lit(1)), "id", 8, _keep_last)
    c.publish()
    before = _files(store, "t")
    batch = spark.createDataFrame([(5, 2), (900, 2)], "id long, v int")
    c = store.begin("second")
    touched = c.merge("t", batch, "id", 8, _keep_last)
    assert {r.id: r.v for r in store.read("t").collect()} == dict.fromkeys(range(200), 1)         # nothing visible yet
    c.publish()
    after = _files(store, "t")
    assert set(touched) == {r[0] for r in batch.select(bucket_of("id", 8)).collect()} and len(touched) < 8
    assert all((before.get(p) == after[p]) == (p not in touched) for p in after)
    assert {r.id: r.v for r in store.read("t").collect()} == {**dict.fromkeys(range(200), 1), 5: 2, 900: 2}
    plan = store.read("t", touched)._jdf.queryExecution().executedPlan().toString()
    assert all(f"_part={p}" not in plan for p in after if p not in touched)


def test_a_commit_shows_all_tables_or_none(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    rows = spark.range(20).withColumn("v", F.lit(1))

    def commit(batch, v):
        c = store.begin(batch)
        c.merge("a", rows.withColumn("v", F.lit(v)), "id", 4, _keep_last)
        c.put("b", rows.withColumn("v", F.lit(v)), F.lit("day"))
        c.publish({"v": v})
    commit("one", 1)
    state = lambda: {(t, r.v) for t in "ab" for r in store.read(t).collect()}
    step, rename = io.write_text, io.rename
    for lost in ("batches/", "_next-", "rename"):                   # journal, manifest aside, publishing rename
        def fail(spark_, path, *a, lost=lost):
            if lost in path or lost == "rename" and a:
                if lost != "rename":
                    step(spark_, path, *a)                       # written, then the driver is lost
                raise RuntimeError("lost")
            return step(spark_, path, *a)
        with monkeypatch.context() as m:
            m.setattr(io, "rename" if lost == "rename" else "write_text", fail)
            with pytest.raises(RuntimeError):
                commit("two", 2)
        assert state() == {("a", 1), ("b", 1)} and store.result_of("two") is None
    assert rename is io.rename
    commit("two", 2)
    assert state() == {("a", 2), ("b", 2)} and store.result_of("two") == {"v": 2} and store.result_of("one") == {"v": 1}


def test_vacuum_keeps_what_the_newest_commit_names(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(5):
        c = store.begin(f"b{i}")
        c.merge("t", spark.range(i * 10, i * 10 + 3).withColumn("v", F.lit(i)), "id", 16, _keep_last)
        c.publish({"i": i})
    want = sorted(map(tuple, store.read("t").collect()))
    store.vacuum(keep=1)
    assert sorted(map(tuple, store.read("t").collect())) == want and store.versions() == [5]
    assert [store.result_of(f"b{i}") for i in range(5)] == [{"i": i} for i in range(5)] and store.result_of("x") is None


def test_empty_and_missing_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("t") is None and store.versions() == []
    c = store.begin("e")
    assert c.merge("t", spark.range(0).withColumn("v", F.lit(1)), "id", 4, _keep_last) == []
    c.publish()
    assert store.read("t").count() == 0 and store.read("t").columns == ["id", "v"]
    c = store.begin("d")
    c.put("days", spark.createDataFrame([(1, "x"), (2, "y")], "id int, d string"), F.col("d"))
    c.publish()
    c = store.begin("reset")
    c.put("days", spark.createDataFrame([], "id int, d string"), F.col("d"), replaces=["x"])       # an empty day replaces its rows
    c.publish()
    assert [tuple(r) for r in store.read("days").collect()] == [(2, "y")]


def _cfg(base):
    return PipelineConfig(f"{base}/landing", f"{base}/reviews", f"{base}/daily", f"{base}/analysis", stopwords=(), keep=T.LATIN_TEST_CLASS)


def _landing(spark, rows):
    return spark.createDataFrame(rows, io.LANDING_SCHEMA)


DAY1 = [("1", "10", "5", "good price and design", "d", "260"), ("2", "11", "1", "bad size not fit", "d", "M"), ("3", "11", "4", "", "d", "M")]
DAY1B = [("2", "99", "3", "great value de good", "d", "L"), ("4", "12", "2", "not the size", "d", "M")]


def test_batches_equal_whole_tables(spark, tmp_path):
    """Two crawls of a day and one of the next: same three tables as the whole-table pipeline, but for the day's sentences of a
    review that came twice, which both forms hold by its last text."""
    store, cfg = Store(spark, f"{tmp_path}/store"), _cfg(f"{tmp_path}/plain")
    for i, (day, rows) in enumerate([("2025-03-17", DAY1), ("2025-03-17", DAY1B), ("2025-03-18", DAY1[:1])]):
        a = run_batch(store, cfg, day, _landing(spark, rows), f"b{i}", 4).first()
        b = run_pipeline(spark, cfg, day, _landing(spark, rows)).first()
        assert a == b
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(store.read("reviews").select(*I.REVIEW_COLS)) == rows(spark.read.parquet(cfg.reviews_path))
    assert rows(store.read("analysis")) == rows(spark.read.parquet(cfg.analysis_path))
    daily = spark.read.parquet(cfg.daily_path)
    assert rows(store.read("daily")) == rows(daily.select(*store.read("daily").columns))


def test_a_replayed_batch_answers_as_it_did_first(spark, tmp_path):
    store, cfg = Store(spark, str(tmp_path)), _cfg(f"{tmp_path}/x")
    first = run_batch(store, cfg, "2025-03-17", _landing(spark, DAY1), "b0", 4).first()
    files = {t: _files(store, t) for t in ("reviews", "daily", "analysis")}
    again = run_batch(store, cfg, "2025-03-17", _landing(spark, DAY1), "b0", 4).first()
    assert first == again and first.inserted == 3 and files == {t: _files(store, t) for t in files}
    assert run_batch(store, cfg, "2025-03-17", _landing(spark, []), "b1", 4).count() == 0


def test_a_batch_lost_before_publishing(spark, tmp_path, monkeypatch):
    from revspark.sources.store import Commit
    store, cfg = Store(spark, str(tmp_path)), _cfg(f"{tmp_path}/x")
    run_batch(store, cfg, "2025-03-17", _landing(spark, DAY1), "b0", 4)
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("reviews", "daily", "analysis")}
    put = Commit.put
    for name in ("reviews", "daily", "analysis"):                # lost after that table was written aside
        def lose(self, table, *a, name=name, **k):
            put(self, table, *a, **k)
            if table == name:
                raise RuntimeError("lost")
        with monkeypatch.context() as m:
            m.setattr(Commit, "put", lose)
            with pytest.raises(RuntimeError):
                run_batch(store, cfg, "2025-03-17", _landing(spark, DAY1B), "b1", 4)
        assert before == {t: sorted(map(str, store.read(t).collect())) for t in before}
    m = run_batch(store, cfg, "2025-03-17", _landing(spark, DAY1B), "b1", 4).first()
    assert (m.before_count, m.inserted, m.already_existing) == (3, 1, 1)


def test_accumulate_day_by_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "review_id string, rating string, ord long"
    for i, rows in enumerate([[("1", "5", 1), ("2", "4", 2)], [("1", "3", 3)], [("2", "9", 0), ("7", "1", 4)]]):
        c = store.begin(f"c{i}")
        io.accumulate_day(c, spark.createDataFrame(rows, schema), "day", "ord", buckets=8)
        c.publish()
    assert {r.review_id: r.rating for r in store.read("day").collect()} == {"1": "3", "2": "4", "7": "1"}


def test_stream_into_the_store(spark):
    from revspark.streaming import alerts as SA
    from revspark.streaming.ingest import ingest_stream, store_sink
    base = scratch_path(spark, "t-store-ingest")
    cfg = _cfg(base)
    _landing(spark, DAY1).coalesce(1).write.parquet(cfg.landing_path)
    _landing(spark, DAY1B).coalesce(1).write.mode("append").parquet(cfg.landing_path)
    sink = store_sink(f"{base}/store", cfg, "2025-03-17", metrics_path=f"{base}/metrics", buckets=4)
    SA.run_available_now(ingest_stream(spark, cfg, "2025-03-17", max_files=1), sink, name="t-store-ingest")
    store = Store(spark, f"{base}/store")
    assert sorted(r.review_id for r in store.read("reviews").collect()) == [1, 2, 3, 4]
    m = [r.inserted for r in spark.read.parquet(f"{base}/metrics").orderBy("batch_id").collect()]
    sink(_landing(spark, DAY1), 0)                                # a replay of the first batch
    assert sum(m) == 4 and [r.inserted for r in spark.read.parquet(f"{base}/metrics").orderBy("batch_id").collect()] == m


def test_reduce_sends_rows_once_and_keeps_each_last_row(spark, tmp_path, monkeypatch):
    """Pieces of buckets, a key of a third of all rows, null keys: as the whole-table form, by one shuffle where no key is that frequent."""
    from revspark.sources.store import Commit
    monkeypatch.setattr(io, "PIECE_ROWS", 20)
    plans, write = [], Commit._write

    def written(self, table, rows, replaces):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, table, rows, replaces)
    monkeypatch.setattr(Commit, "_write", written)
    key = lambda hot: F.when(F.col("id") % 3 == 0, F.lit("hot") if hot else F.col("id").cast("string")) \
        .when(F.col("id") % 41 != 1, (F.col("id") % 700).cast("string"))
    crawl = lambda a, hot: spark.range(a, a + 900).select(key(hot).alias("review_id"), F.col("id").alias("v"), (F.col("id") * 7919 % 3001).alias("ord"))
    crawls = [crawl(0, False), crawl(500, True), crawl(300, False)]
    store, plain = Store(spark, f"{tmp_path}/store"), None
    for i, rows in enumerate(crawls):
        c = store.begin(f"c{i}")
        touched = io.accumulate_day(c, rows, "day", "ord", buckets=4)
        c.publish()
        plain = io.accumulate(plain, rows, "ord")
        assert touched == ["0", "1", "2", "3"] and store.read("day").columns == ["review_id", "v", "ord"]
        assert sorted(map(str, store.read("day").collect())) == sorted(map(str, plain.collect()))
        parts = {p: {r[0] for r in store.read("day", [p]).select(bucket_of("review_id", 4)).collect()} for p in touched}
        assert parts == {p: {p} for p in touched}
    assert [p.count("Exchange") for p in plans] == [1, 2, 1] and all(len(f) > 2 for f in _files(store, "day").values())
