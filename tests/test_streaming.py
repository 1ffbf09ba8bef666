"""Streaming = batch: the send-once rule gives the same alerts whether the files
arrive as one micro-batch or several (files in event-time order)."""
import datetime as dt

from pyspark.sql import functions as F

from revspark.session import scratch_path
from revspark.streaming import alerts as S

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def _rows(minutes, key="u1", start_id=0):
    return [(T0 + dt.timedelta(minutes=m), start_id + i, key, 7, "error", f"s{i}", 0, 5.0)
            for i, m in enumerate(minutes)]


def _write(spark, path, rows):
    spark.createDataFrame(rows, S.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, src, max_files):
    out = scratch_path(spark, "t-sent")
    S.run_available_now(S.send_once(S.anomaly_stream(spark, src, max_files=max_files)),
                        S.batch_writer(out), name="t-send-once")
    return sorted((r.review_id, r.event_time) for r in spark.read.parquet(out).collect())


def test_send_once_greedy_and_batch_layout(spark):
    src = scratch_path(spark, "t-events")
    _write(spark, src, _rows([0, 30, 61]) + _rows([5, 200], key="u2", start_id=100))
    _write(spark, src, _rows([90, 125, 186], start_id=10) + _rows([230, 261], key="u2", start_id=110))
    one = _run(spark, src, None)
    two = _run(spark, src, 1)
    want = sorted([("u1", T0 + dt.timedelta(minutes=m)) for m in (0, 61, 125, 186)] +
                  [("u2", T0 + dt.timedelta(minutes=m)) for m in (5, 200, 261)])
    assert one == want
    assert two == want


def test_non_anomalies_never_alert(spark):
    src = scratch_path(spark, "t-events2")
    rows = [(T0, 1, "u", 7, "view", "s", 2, 5.0), (T0, 2, "v", 7, "view", "s", 1, 4.0)]
    _write(spark, src, rows)
    out = scratch_path(spark, "t-sent2")
    S.run_available_now(S.send_once(S.anomaly_stream(spark, src)), S.batch_writer(out), name="t-none")
    try:
        n = spark.read.parquet(out).count()
    except Exception:
        n = 0
    assert n == 0


def test_recent_list_sink(spark):
    src = scratch_path(spark, "t-events3")
    _write(spark, src, [(T0 + dt.timedelta(minutes=i), i, f"r{i % 120}", 1, "error", "s", 0, 5.0) for i in range(200)])
    out = scratch_path(spark, "t-recent")
    S.run_available_now(S.anomaly_stream(spark, src), S.recent_list_sink(out), name="t-recent")
    lst = spark.read.parquet(f"{out}/latest")
    assert lst.count() == 100
    assert lst.agg(F.max("event_id")).first()[0] == 119


def test_seen_ids_exact_list(spark):
    """Ids in the last-100 list are skipped in later batches; repeats inside one
    batch all pass; the list never exceeds 100 ids."""
    src = scratch_path(spark, "t-events4")
    _write(spark, src, [(T0 + dt.timedelta(minutes=i), i, f"r{i}", 1, "error", "s", 0, 5.0) for i in range(150)]
           + [(T0 + dt.timedelta(minutes=200), 999, "r149", 1, "error", "s", 0, 5.0)])
    _write(spark, src, [(T0 + dt.timedelta(minutes=300 + i), 1000 + i, f"r{i}", 1, "error", "s", 0, 5.0)
                        for i in (0, 100, 149)])
    out, ids = scratch_path(spark, "t-seen-out"), scratch_path(spark, "t-seen-ids")
    S.run_available_now(S.anomaly_stream(spark, src, max_files=1), S.seen_ids_sink(ids, S.batch_writer(out)),
                        name="t-seen-ids")
    got = spark.read.parquet(out)
    b0 = sorted(r.event_id for r in got.where("batch_id = 0").collect())
    b1 = sorted(r.event_id for r in got.where("batch_id = 1").collect())
    assert len(b0) == 151                      # both rows of r149 pass inside one batch
    # Newest rows are processed first and every id is pushed to the head, so after
    # batch 0 the list holds the 100 oldest ids (r0..r99): r0 is skipped, r100 and
    # r149 pass again.
    assert b1 == [1100, 1149]
    lst = spark.read.parquet(f"{ids}/latest")
    assert lst.count() == 100


def test_seen_ids_replay_delivers_the_batch_again(spark, tmp_path):
    got = {}
    sink = S.seen_ids_sink(str(tmp_path / "ids"), lambda df, b: got.__setitem__(b, sorted(r.review_id for r in df.collect())))
    row = lambda i: spark.sql(f"select '{i}' review_id, timestamp'2025-01-01 00:00:00' event_time, {i} event_id")
    sink(row(1), 0)
    sink(row(1), 0)                     # lost after its snapshot, before its commit
    assert got[0] == ["1"]
    sink(row(1).union(row(2)), 1)
    assert got[1] == ["2"]


def test_late_rows_go_to_a_counted_table(spark, tmp_path):
    """Two micro-batches: rows more than an hour behind all earlier batches are late, nothing is lost, and the
    stateful step that reads the rest drops none."""
    src, out = str(tmp_path / "src"), str(tmp_path / "split")
    _write(spark, src, _rows([0, 300]) + _rows([10], key="early", start_id=50))
    _write(spark, src, _rows([239, 241, 400], key="u2", start_id=100) + [(None, 999, "u3", 7, "error", "s", 0, 5.0)])
    S.run_available_now(S.anomaly_stream(spark, src, max_files=1), S.split_late_sink(out), name="t-split")
    late = S.late_rows(spark, out)
    assert sorted((r.event_id, r.batch_id) for r in late.collect()) == [(100, 1), (999, 1)]
    ledger = [(r.batch_id, r.on_time, r.late, r.greatest) for r in S.late_ledger(spark, out).orderBy("batch_id").collect()]
    assert ledger == [(0, 3, 0, T0 + dt.timedelta(minutes=300)), (1, 2, 2, T0 + dt.timedelta(minutes=400))]
    sent = str(tmp_path / "sent")
    S.run_available_now(S.send_once(S.on_time_stream(spark, out)), S.batch_writer(sent), name="t-on-time")
    got = sorted(r.event_id for r in spark.read.parquet(sent).collect())
    assert got == [0, 1, 50, 101, 102] and late.count() + 5 == 7


def test_late_split_is_replay_safe(spark, tmp_path):
    out = str(tmp_path / "split")
    sink = S.split_late_sink(out)
    one, two = (spark.createDataFrame(r, S.EVENT_SCHEMA) for r in (_rows([0, 300]), _rows([10, 350], start_id=10)))
    sink(one, 0)
    sink(two, 1)
    files = sorted(p.name for p in (tmp_path / "split" / "on_time").rglob("*.parquet"))
    for f in (tmp_path / "split" / "ledger" / "v=1").iterdir():          # lost before the ledger of batch 1
        f.unlink()
    (tmp_path / "split" / "ledger" / "v=1").rmdir()
    sink(two, 1)
    assert files == sorted(p.name for p in (tmp_path / "split" / "on_time").rglob("*.parquet"))          # not written again
    assert [r.event_id for r in S.late_rows(spark, out).collect()] == [10]
    assert [(r.on_time, r.late) for r in S.late_ledger(spark, out).orderBy("batch_id").collect()] == [(2, 0), (1, 1)]


def test_send_once_state_follows_live_keys(spark, tmp_path):
    """One entry per key, forgotten when the watermark passes the key's expiry."""
    src = str(tmp_path / "src")
    for i in range(4):                                            # ten new keys every two hours
        _write(spark, src, [(T0 + dt.timedelta(hours=3 * i), 100 * i + k, f"u{i}-{k}", 7, "error", "s", 0, 5.0) for k in range(10)])
    q = (S.send_once(S.anomaly_stream(spark, src, max_files=1, watermark="10 minutes")).writeStream.foreachBatch(S.batch_writer(str(tmp_path / "out")))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40 and max(sizes) <= 44 and sizes[-1] <= 22, sizes
    assert all(p["stateOperators"][0]["numRowsDroppedByWatermark"] == 0 for p in q.recentProgress if p["stateOperators"])


def _whole_set(rows, expiry=60):
    """Brute force: rows (minute, id, key) in time order; the set is empty once ``expiry`` minutes passed since the last send."""
    known, last, out = set(), None, []
    for t, i, k in sorted(rows):
        if last is not None and t - last >= expiry:
            known = set()
        if k not in known:
            known.add(k)
            out.append(i)
            last = t
    return out


def test_whole_set_expiry_in_one_and_many_batches(spark, tmp_path):
    import random
    rnd = random.Random(5)
    rows, t = [], 0
    for i in range(120):
        t += rnd.choice([1, 5, 20, 45, 59, 60, 75])
        rows.append((t, i, f"k{rnd.randrange(4)}"))
    want = _whole_set(rows)
    event = lambda r: (T0 + dt.timedelta(minutes=r[0]), r[1], r[2], 7, "error", "s", 0, 5.0)
    one = str(tmp_path / "one")
    frame = lambda part: spark.createDataFrame([(*event(r), "type") for r in part], S.SENT_SCHEMA)
    S.whole_set_sink(f"{one}/state", S.batch_writer(f"{one}/out"))(frame(rows), 0)
    assert sorted(r.event_id for r in spark.read.parquet(f"{one}/out").collect()) == want
    many, sink = str(tmp_path / "many"), None
    sink = S.whole_set_sink(f"{many}/state", S.batch_writer(f"{many}/out"))
    for b, a in enumerate(range(0, 120, 30)):
        sink(frame(rows[a:a + 30]), b)
        if b == 2:
            sink(frame(rows[a:a + 30]), b)                        # a replayed batch
    assert sorted(r.event_id for r in spark.read.parquet(f"{many}/out").collect()) == want


def test_send_once_calls_the_state_store_per_slot():
    """3,000 keys of a bucket cost a read and a write per slot, and a later batch still finds their last sends."""
    import pandas as pd

    class Map(dict):
        calls = 0

        def getValue(self, k):
            Map.calls += 1
            return self.get(k)

        def updateValue(self, k, v):
            Map.calls += 1
            self[k] = v

        def removeKey(self, k):
            self.pop(k, None)

        def iterator(self):
            return iter(list(self.items()))

    class Handle:
        timers: list = []

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    class Expired:
        def getExpiryTimeInMs(self):
            return Handle.timers[0]

    def batch(minute):
        return pd.DataFrame([(T0 + dt.timedelta(minutes=minute), i, f"u{i}", 7, "error", "s", 0, 5.0, "type", f"k{i}", i % 256, 0) for i in range(3000)])
    p = S.SendOnce(3_600_000_000)
    p.handle, p.sent = Handle(), Map()
    assert sum(map(len, p.handleInputRows((0,), iter([batch(0)]), Times()))) == 3000
    assert Map.calls <= 2 * 256
    assert sum(map(len, p.handleInputRows((0,), iter([batch(59)]), Times()))) == 0
    list(p.handleExpiredTimer((0,), Times(), Expired()))
    assert not p.sent
    assert sum(map(len, p.handleInputRows((0,), iter([batch(60)]), Times()))) == 3000
