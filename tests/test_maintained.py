"""Id filters, name postings, roll-ups and assembled texts against their direct forms."""
import datetime as dt
import random

from pyspark.sql import functions as F

from revspark.operators import assembly as T
from revspark.operators import ingest as I
from revspark.operators import name_index as N
from revspark.operators import rollups as R
from revspark.operators import scores as S
from revspark.operators.known_ids import KnownIds
from revspark.sources.store import Store


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_ids_equal_the_plain_anti_join(spark, tmp_path):
    rnd = random.Random(1)
    known = KnownIds(Store(spark, str(tmp_path)), pages=8, parts=4)
    history = rnd.sample(range(100_000), 3000)
    for i in range(3):
        c = known.store.begin(f"h{i}")
        known.add(c, spark.createDataFrame([(x,) for x in history[i::3]], "review_id long"))
        c.publish()
    rows = [(rnd.choice(history) if i % 3 else rnd.randrange(100_000), i) for i in range(900)] + [(None, 5000), (None, 5001)]
    batch = spark.createDataFrame(rows, "review_id long, ord long")
    old = spark.createDataFrame([(x,) for x in history], "review_id long")
    got = sorted(map(str, known.new_rows(batch, "ord").collect()))
    assert got == sorted(map(str, I.new_reviews(batch, old, "ord").collect()))
    # every stored id is suspected; of the others only few
    marked, _ = known.suspects(spark.range(100_000, 104_000).toDF("review_id"))
    assert known.may_be_stored(old).where("NOT _maybe").isEmpty() and marked.where("_maybe").count() < 400


def test_full_filters_stay_exact_and_untouched_parts_unread(spark, tmp_path):
    known = KnownIds(Store(spark, str(tmp_path / "a")), pages=1, parts=1)            # one page for 30,000 ids: all bits set
    c = known.store.begin("h")
    known.add(c, spark.range(0, 60_000, 2).toDF("review_id"))
    c.publish()
    batch = spark.range(2000).select(F.col("id").alias("review_id"), F.col("id").alias("ord"))
    marked, parts = known.suspects(batch)
    assert marked.where("_maybe").count() > 1800 and sorted(r.review_id for r in known.new_rows(batch, "ord").collect()) == list(range(1, 2000, 2))
    known = KnownIds(Store(spark, str(tmp_path / "b")), pages=64, parts=16)
    c = known.store.begin("h")
    known.add(c, spark.range(500).toDF("review_id"))
    c.publish()
    batch = spark.createDataFrame([(7, 1), (10**9, 2)], "review_id long, ord long")
    _, parts = known.suspects(batch)
    assert 1 <= len(parts) <= 2
    assert [r.review_id for r in known.new_rows(batch, "ord").collect()] == [10**9]
    plan = _plan(known.store.read("ids", parts))
    assert all(f"_part={i:02d}" not in plan for i in range(16) if f"{i:02d}" not in parts)
    empty = KnownIds(Store(spark, str(tmp_path / "c")))
    assert empty.new_rows(batch, "ord").count() == 2


def test_substring_search_equals_a_scan(spark, tmp_path):
    rnd = random.Random(2)
    words = ["Ring", "ringlet", "BRING it", "string%", "under_score", "100% wool", "신발 사이즈", "né", "a", "", "İstanbul"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 4)))) for i in range(300)] + [(900, None), (901, "ab"), (901, "abc abd")]
    df = spark.createDataFrame(rows, "product_id long, product_name string")
    index = N.NameIndex(Store(spark, str(tmp_path)), "product_id", "product_name", parts=8, spread=2)
    for i in range(2):                                                              # a second build replaces the first
        c = index.store.begin(f"b{i}")
        index.build(c, df if i else df.limit(50))
        c.publish()
    some = ["R", "in", "RING", "ring ring", "100% w", "_s", "r_s", "%", "신발 사", "né né", "nothing like it", "string% under_score ringlet"[:30], "abd", ""]
    for q in some:
        want = sorted(map(tuple, df.distinct().where(F.lower("product_name").contains(q.lower())).collect()))
        assert sorted(map(tuple, index.search(q).collect())) == want, q
    read = index.store.read("postings", index.parts_of("ring"))
    assert len(index.parts_of("ring")) <= 2 and all(f"_part={i}" not in _plan(read) for i in range(8) if str(i) not in index.parts_of("ring"))


D = dt.date(2025, 3, 17)


def _analysis(spark, rows):
    return spark.createDataFrame(rows, "review_id long, product_id long, sentence string, category string, sentiment int, rating double, review_date date")


def test_rollup_equals_direct_after_changes(spark, tmp_path):
    rnd = random.Random(3)
    cats = ["사이즈", "디자인, 사이즈", "가성비", None, " 디자인 ,", "사이즈,사이즈"]
    rows = [(i, i % 7, "s", rnd.choice(cats), rnd.choice([0, 1, 2, None]), rnd.choice([1.0, 2.5, 3.0, 5.0, None]), D + dt.timedelta(days=rnd.randrange(90)))
            for i in range(600)] + [(None, 1, "s", "사이즈", 0, 1.0, D), (900, 1, "s", "사이즈", 0, 1.0, None)]
    wrong = [(*r[:4], 2, 1.0, D) for r in rows[:100]]
    store = Store(spark, str(tmp_path))
    for name, added, removed in (("a", rows[50:400] + wrong[:50], None), ("b", rows[400:] + rows[:50], wrong[:50])):
        c = store.begin(name)
        before = dict(c.tables.get(R.TABLE, {"parts": {}})["parts"])
        touched = R.apply_changes(c, _analysis(spark, added), None if removed is None else _analysis(spark, removed))
        assert all(c.tables[R.TABLE]["parts"][p] == v for p, v in before.items() if p not in touched)
        c.publish()
    assert "none" in store.manifest()["tables"][R.TABLE]["parts"]
    c = store.begin("reset")
    R.reset_day(c, str(D), _analysis(spark, []))
    c.publish()
    day = [r for r in rows if r[6] == D]
    assert store.read(R.TABLE).where(F.col("review_date") == F.lit(D)).isEmpty() and day
    c = store.begin("refill")
    R.apply_changes(c, _analysis(spark, day))
    c.publish()
    cells, ra = store.read(R.TABLE), _analysis(spark, rows)
    products = spark.createDataFrame([(i, f"p{i}", f"b{i % 3}", "c") for i in range(8)], "product_id long, product_name string, brand string, category string")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
    assert same(R.merged(R.cells(ra)), cells)
    assert same(S.brand_scores(ra, products), R.brand_scores(cells, products))
    assert same(S.product_scores(ra, products, "2025-05-01"), R.product_scores(cells, products, "2025-05-01"))
    assert same(S.topic_scores(ra, products), R.topic_scores(cells, products))


def test_rollup_by_day_touches_its_days_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    c = store.begin("a")
    R.apply_changes(c, _analysis(spark, [(i, 1, "s", "x", 0, 1.0, D + dt.timedelta(days=i)) for i in range(5)]), grain="day")
    c.publish()
    c = store.begin("b")
    one = _analysis(spark, [(0, 1, "s", "x", 0, 1.0, D)])
    assert R.apply_changes(c, None, one, grain="day") == [str(D)]
    c.publish()
    assert sorted(store.manifest()["tables"][R.TABLE]["parts"]) == [str(D + dt.timedelta(days=i)) for i in range(1, 5)]


def test_segments_join_to_the_whole_text(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(20)}", i, rnd.choice(["", "한글 줄", "x" * rnd.randrange(1, 90), None])) for i in range(4000)]
    rows += [(None, 0, "null group"), ("long", 0, "y" * 1000), ("long", 1, "z")]
    df = spark.createDataFrame(rows, "g string, i long, line string").repartition(7)
    seg = T.assemble(df, ["g"], [-F.col("i")], F.col("line"), segment_chars=300).cache()
    parts = {}
    for r in seg.collect():
        assert len(r.text) <= 300 or r.n_lines == 1
        parts.setdefault(r.g, []).append((r.segment, r.text, r.n_lines))
    for g in {r[0] for r in rows}:
        want = "\n".join((x[2] or "") for x in sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]))
        mine = sorted(parts[g])
        assert [s for s, _, _ in mine] == list(range(len(mine))) and "\n".join(t for _, t, _ in mine) == want
    import hashlib
    hot = "\n".join(t for _, t, _ in sorted(parts["hot"]))
    d = {r.g: r for r in T.digests(seg, ["g"]).collect()}
    assert d["hot"].text_sha256 == hashlib.sha256(hot.encode()).hexdigest() and d["hot"].n_chars == len(hot)
    assert len(parts["hot"]) > 50 and d["hot"].n_lines == sum(r[0] == "hot" for r in rows)
    assert T.assemble(df.limit(0), ["g"], [F.col("i")], F.col("line")).count() == 0


def test_a_group_of_a_third_of_all_rows_spans_tasks(spark):
    from revspark.sources import io
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id",
                                    F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    stage, seen = io.stage, []
    T.io.stage = lambda d, name="stage": seen.append(stage(d, name)) or seen[-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")         # small partitions stay apart
    try:
        T.assemble(df, ["g"], [F.col("id")], F.col("line"), segment_chars=500)
    finally:
        T.io.stage = stage
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0].where("g = 'hot'").select("_task").distinct().count() > 1
