"""The live alert job as one Structured Streaming query.

Source: labelled rows landing as Parquet files (``readStream`` with an explicit
schema). Event time is cast to ``timestamp`` (watermarks reject
``timestamp_ntz``) and watermarked, so every piece of state is bounded:

* late rows: ``split_late_sink`` runs before the stateful steps. A committed ledger of the greatest event time splits
  each micro-batch into rows that are on time and rows behind the watermark, which go to a counted late table, so the stateful
  steps drop nothing unseen;
* seen ids (I2): ``dropDuplicatesWithinWatermark`` on review_id;
* send-once per (review_id, product_id, category) with a one-hour expiry (I6):
  ``transformWithStateInPandas`` keeps each key's last send in RocksDB and drops it by an
  event-time timer once the watermark passes the expiry; ``whole_set_sink`` expires all keys together;
* the recent-negatives list (I7) is a <= 100-row snapshot merged per micro-batch.

Sinks are ``foreachBatch`` writers keyed by ``batch_id``: a replayed batch after a
failure rewrites the same folder instead of appending twice (exactly-once output
with the checkpoint). Checkpoints live below the shared ``spark.checkpoint.dir``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType,
                               TimestampType)

from ..functions import constants as K
from ..operators import alerts as A
from ..session import scratch_path, ship_package
from ..sources import io

EVENT_SCHEMA = StructType([
    StructField("event_time", TimestampType()), StructField("event_id", LongType()),
    StructField("review_id", StringType()), StructField("product_id", LongType()),
    StructField("category", StringType()), StructField("sentence", StringType()),
    StructField("sentiment", IntegerType()), StructField("rating", DoubleType()),
])

SENT_SCHEMA = StructType(EVENT_SCHEMA.fields + [StructField("type", StringType())])
SLOTS = 256                     # map entries of a bucket of alert keys
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def anomaly_stream(spark: SparkSession, path: str, schema: StructType = EVENT_SCHEMA,
                   watermark: str = "1 hour", max_files: int | None = None) -> DataFrame:
    """Anomalous rows (I1) with their alert type (I3), watermarked on event time."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path).withColumn("event_time", F.col("event_time").cast("timestamp"))
    return A.with_alert_types(s.withWatermark("event_time", watermark)).drop("display_type")


def seen_once(alerts: DataFrame) -> DataFrame:
    """Drop repeats of a review id within the watermark delay."""
    return alerts.dropDuplicatesWithinWatermark(["review_id"])


class SendOnce(StatefulProcessor):
    """State of a bucket of alert keys: key -> time of its last send (event time, microseconds), in ``SLOTS`` map entries by the
    key's hash. A micro-batch reads and writes only the entries in which it has a key, each by one call, as a call to the state
    store takes far longer than a key's own work.

    Keys share a bucket only so that one vectorised call serves many of them. A timer per bucket and batch forgets the keys whose expiry
    the watermark has passed: no later row that isn't late can be suppressed by them any more."""

    def __init__(self, expiry_us: int):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "slot int", "keys array<string>, us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        pdf = pdf.set_axis([*(f.name for f in SENT_SCHEMA.fields), "_key", "_slot", "_bucket"], axis=1)   # computed columns come unnamed
        pdf = pdf.sort_values(["_slot", "_key", "event_time", "event_id"], kind="stable").reset_index(drop=True)
        t = pdf["event_time"].to_numpy().astype("datetime64[us]").astype(np.int64)
        k, slots = pdf["_key"].to_numpy(), pdf["_slot"].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (slots[1:] != slots[:-1])])
        keep: list[int] = []
        slot, last = None, {}
        for lo, hi in zip(starts, np.r_[starts[1:], len(k)]):
            if slots[lo] != slot:
                if slot is not None:
                    self._put(slot, last, timerValues.getCurrentWatermarkInMs() * 1000)
                slot = int(slots[lo])
                old = self.sent.getValue((slot,))
                last = {} if old is None else dict(zip(*old))
            out = sends(t[lo:hi], last.get(k[lo]), self.expiry_us)
            if out:
                keep += [lo + i for i in out]
                last[k[lo]] = int(t[keep[-1]])
        self._put(slot, last, timerValues.getCurrentWatermarkInMs() * 1000)
        if keep:
            self.handle.registerTimer(-(-int(t[keep].max() + self.expiry_us) // 1000))
            yield pdf.iloc[keep][[f.name for f in SENT_SCHEMA.fields]]

    def _put(self, slot: int, last: dict, passed: int) -> None:
        """Write a slot's keys, without those whose expiry is not after ``passed``."""
        live = {k: us for k, us in last.items() if us + self.expiry_us > passed}
        if live:
            self.sent.updateValue((slot,), (list(live), list(live.values())))
        else:
            self.sent.removeKey((slot,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for (slot,), (keys, us) in list(self.sent.iterator()):
            if any(x + self.expiry_us <= due for x in us):
                self._put(slot, dict(zip(keys, us)), due)
        return iter(())

    def close(self) -> None:
        pass


def sends(t: np.ndarray, last: int | None, expiry: int) -> list[int]:
    """Positions in sorted times at which an alert goes out: the first one, then each first one at
    least ``expiry`` after the last send. Jumps from send to send."""
    out, i = [], 0 if last is None else int(np.searchsorted(t, last + expiry, side="left"))
    while i < len(t):
        out.append(i)
        i = int(np.searchsorted(t, int(t[i]) + expiry, side="left"))
    return out


def send_once(alerts: DataFrame, expiry_seconds: int = K.ALERT_EXPIRY_SECONDS, buckets: int = 64) -> DataFrame:
    """Per (review_id, product_id, category) send the first alert, then again
    only once ``expiry_seconds`` have passed since the last send (event time).

    The state lies in RocksDB, ``buckets`` times ``SLOTS`` entries at most, so that one vectorised call and one state call serve many keys (a call
    per key took six times as long). Size ``buckets`` to a few times the executor cores. For the form in which all keys expire
    together see ``whole_set_sink``."""
    spark = alerts.sparkSession
    ship_package(spark)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)
    keyed = alerts.select(*[f.name for f in SENT_SCHEMA.fields], F.to_json(F.struct(*A.ALERT_KEYS)).alias("_key"),
                          F.pmod(F.xxhash64(F.lit(1), *A.ALERT_KEYS), F.lit(SLOTS)).cast("int").alias("_slot"),
                          F.pmod(F.xxhash64(*A.ALERT_KEYS), F.lit(buckets)).alias("_bucket"))
    return keyed.groupBy("_bucket").transformWithStateInPandas(SendOnce(expiry_seconds * 1_000_000), SENT_SCHEMA, "Append", "EventTime")


def batch_writer(path: str, fmt: str = "parquet"):
    """foreachBatch sink: each micro-batch lands in its own ``batch_id=`` folder,
    overwritten on replay, so output is exactly-once with the checkpoint."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch_id={batch_id}")
    return write


def alert_sink(products: DataFrame, path: str):
    """A10: enrich each micro-batch with product fields (stream-static join inside
    the batch) and write the JSON messages."""
    w = batch_writer(path)

    def write(df: DataFrame, batch_id: int) -> None:
        w(A.alert_records(df.withColumn("review_date", F.to_date("event_time")), products, with_json=True),
          batch_id)
    return write


def _before(spark, base: str, batch_id: int) -> DataFrame | None:
    """The snapshot of the last batch before ``batch_id``: what a replay of that batch must start
    from, whatever the lost run has written."""
    if not io.table_exists(spark, base):
        return None
    fs, p = io._fs(spark, base)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and io.table_exists(spark, f"{base}/{n}/_SUCCESS")]
    last = max((v for v in done if v < batch_id), default=None)
    return None if last is None else spark.read.parquet(f"{base}/v={last}")


# --- I1: rows behind the watermark -----------------------------------------------------------
def split_late_sink(path: str, delay_seconds: int = 3600):
    """Splits each micro-batch before the stateful steps: rows more than ``delay_seconds`` behind the greatest event time
    of all earlier batches go to ``late/batch_id=``, the others to ``on_time/batch_id=``, the next job's source.

    ``ledger/v=`` holds a row per batch: greatest event time so far, rows on time and late. A batch reads the
    ledger of the batch before it, so a replay splits alike; its rows on time appear by one rename and aren't written
    twice, as the next job may have read them. Rows without event time count as late."""
    base = path.rstrip("/")

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = _before(spark, f"{base}/ledger", batch_id)
        top = before.first().greatest if before is not None else None
        t = F.col("event_time")
        late = t.isNull() if top is None else t.isNull() | (t < F.lit(top) - F.expr(f"INTERVAL {int(delay_seconds)} SECONDS"))
        df.where(late).write.mode("overwrite").parquet(f"{base}/late/batch_id={batch_id}")
        done = f"{base}/on_time/batch_id={batch_id}"
        if not io.table_exists(spark, done):
            df.where(~late).write.mode("overwrite").parquet(f"{base}/_next/batch_id={batch_id}")
            io.make_folder(spark, f"{base}/on_time")
            io.rename(spark, f"{base}/_next/batch_id={batch_id}", done)
        counts = df.agg(F.greatest(F.max(t), F.lit(top)).alias("greatest"), F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"))
        counts.write.mode("overwrite").parquet(f"{base}/ledger/v={batch_id}")
    return write


def on_time_stream(spark: SparkSession, path: str, schema: StructType = SENT_SCHEMA, delay: str = "1 hour") -> DataFrame:
    """The rows that ``split_late_sink`` left on time, watermarked. All batches that wait are read together, never part of
    one, so the watermark of this stream can't pass the ledger's and none of its rows is late."""
    return spark.readStream.schema(schema).parquet(f"{path.rstrip('/')}/on_time/*").withWatermark("event_time", delay)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late table, with the batch in which each row came."""
    return spark.read.parquet(f"{path.rstrip('/')}/late")


def late_ledger(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, greatest, on_time, late of each batch."""
    return spark.read.option("basePath", f"{path.rstrip('/')}/ledger").parquet(f"{path.rstrip('/')}/ledger/v=*") \
        .withColumnRenamed("v", "batch_id")


# --- I6, all keys expire together ------------------------------------------------------------
def whole_set_sends(alerts: DataFrame, known: DataFrame | None = None, last: int | None = None,
                    expiry_seconds: int = K.ALERT_EXPIRY_SECONDS) -> tuple[DataFrame, DataFrame]:
    """Alerts that go out when the whole set of sent keys is forgotten ``expiry_seconds`` after the last send of any key.

    ``known`` holds the keys in the set, ``last`` the last send (microseconds); rows older than that are taken at its time.
    Returns the alerts to send, and the set afterwards: keys, ``_us`` (when the key went in) and ``event_id`` (null
    for keys that were known before).

    A pause of the expiry's length between any rows empties the set, so the sessions between such pauses are independent and are
    walked together. In each turn the first row per session and key is a candidate; candidates go out up to the first
    pause after one of them, and the session's rows behind that pause go into the next turn with an empty set. Pauses are found from the least
    and greatest time per slot of the expiry's length, as two times in one slot are never that far apart."""
    e, keys = expiry_seconds * 1_000_000, list(A.ALERT_KEYS)
    cols = [f.name for f in SENT_SCHEMA.fields]
    rows = alerts.select(*cols).withColumn("_us", F.greatest(F.unix_micros("event_time"), F.lit(last).cast("long")))
    if known is not None:
        rows = rows.unionByName(known.select(*keys, F.lit(last).cast("long").alias("_us")), allowMissingColumns=True)
    rows = io.stage(rows.where("_us is not null").withColumn("_slot", F.floor(F.col("_us") / e)), "whole-set")
    span = lambda df, *by: df.groupBy(*by, "_slot").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    order = Window.orderBy("_slot")               # a row per slot of the batch's time span
    opens = span(rows).select("_slot", (F.col("_lo") - F.lag("_hi").over(order) >= e).cast("int").alias("_opens"))
    sessions = opens.select("_slot", F.sum(F.coalesce("_opens", F.lit(0))).over(order).alias("_session"))
    todo = io.stage(rows.join(sessions, "_slot"), "whole-set")
    newest = todo.agg(F.max("_session")).first()[0]
    out = after = None
    while True:
        others = [c for c in cols if c not in keys] + ["_us", "_slot"]
        first = (todo.groupBy("_session", *keys)
                 .agg(F.min_by(F.struct(*others), F.struct("_us", F.col("event_id").isNotNull(), "event_time", "event_id")).alias("_v"))
                 .select("_session", *keys, "_v.*"))
        first = io.stage(first, "whole-set")
        within = Window.partitionBy("_session").orderBy("_slot")
        stop = (span(first, "_session").withColumn("_prev", F.lag("_hi").over(within)).groupBy("_session")
                .agg(F.coalesce(F.min(F.when(F.col("_lo") - F.col("_prev") >= e, F.col("_prev"))), F.max("_hi")).alias("_end")))
        stop = io.stage(stop.withColumn("_stop", F.col("_end") + e).drop("_end"), "whole-set")
        first = first.join(stop, "_session").where("_us < _stop")
        go = first.where("event_id is not null").select(*cols)
        out = go if out is None else out.unionByName(go)
        todo = io.stage(todo.join(stop, "_session").where("_us >= _stop").drop("_stop"), "whole-set")
        if after is None and todo.where(F.col("_session") == F.lit(newest)).isEmpty():
            after = first.where(F.col("_session") == F.lit(newest)).select(*keys, "_us", "event_id")
        if todo.isEmpty():
            return out, after


def whole_set_sink(path: str, inner, expiry_seconds: int = K.ALERT_EXPIRY_SECONDS):
    """I6 with one expiry for all keys, as a foreachBatch sink: hands the alerts that go out to ``inner``.

    ``set/v=`` holds the keys that a batch added and ``state/v=`` one row: the batch in which the live set began and the last send. So a
    batch writes its own keys only, reads those since the set began, and starts from the state of the batch before it when it is replayed."""
    base = path.rstrip("/")

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        before = _before(spark, f"{base}/state", batch_id)
        state = before.first() if before is not None else None
        known = None
        if state is not None:
            known = (spark.read.schema("review_id string, product_id long, category string, v long").option("basePath", f"{base}/set")
                     .parquet(f"{base}/set").where(F.col("v").between(state.since, batch_id - 1)))
        go, after = whole_set_sends(df, known, None if state is None else state.last, expiry_seconds)
        inner(go, batch_id)
        added = after.where("event_id is not null")
        added.select(*A.ALERT_KEYS).write.mode("overwrite").parquet(f"{base}/set/v={batch_id}")
        end = after.agg(F.max("_us").alias("last"), F.count_if(F.col("event_id").isNull()).alias("old")).first()
        since = state.since if state is not None and (end.old or end.last is None) else batch_id
        last = end.last if end.last is not None else (state.last if state is not None else None)
        if last is not None:
            spark.createDataFrame([(since, last)], "since long, last long").write.mode("overwrite").parquet(f"{base}/state/v={batch_id}")
    return write


def recent_list_sink(path: str, cap: int = K.RECENT_LIST_CAP):
    """I7 live: merge each micro-batch of negatives into the <= ``cap``-row list.
    Every batch writes a new snapshot folder (never the files it reads)."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        base = path.rstrip("/")
        cur = df.where(F.col("sentiment") == 0).select(
            "review_id", "category", "sentence", "event_time", "event_id")
        prev = _before(spark, base, batch_id)
        if prev is not None:
            cur = prev.drop("pos").unionByName(cur)
        snap = A.recent_negatives(cur, "event_time", cap)
        snap.write.mode("overwrite").parquet(f"{base}/v={batch_id}")
        spark.read.parquet(f"{base}/v={batch_id}").write.mode("overwrite").parquet(f"{base}/latest")
    return write


def seen_ids_sink(path: str, inner, cap: int = K.SEEN_IDS_CAP, order: str = "event_time"):
    """I2, exact form: the ids of the last ``cap`` processed alerts are kept as a
    snapshot table (at most ``cap`` rows); each micro-batch passes on the rows whose
    id is not in it (repeats inside one batch all pass, as the list is read once
    per cycle), hands them to ``inner`` and pushes their ids, newest-first processing
    order, in front of the old list, trimmed to ``cap``. The snapshot is bounded by
    ``cap``, so it is broadcast explicitly."""
    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        base = path.rstrip("/")
        snap = _before(spark, base, batch_id)
        if snap is None:               # first batch: empty list
            snap = spark.createDataFrame([], "review_id string, pos long")
        fresh = df.join(F.broadcast(snap.select("review_id")), "review_id", "left_anti")
        inner(fresh, batch_id)
        # Rows are processed newest first and each id is pushed to the head, so the
        # last processed (oldest) row ends up first in the list.
        pushed = (fresh.select("review_id", F.col(order).alias("_t"), F.col("event_id").alias("_e"))
                  .orderBy(F.col("_t").asc(), F.col("_e").desc()).limit(cap)
                  .select("review_id", F.lit(0).alias("_g"), F.col("_t"), F.col("_e")))
        old = snap.select("review_id", F.lit(1).alias("_g"), F.lit(None).cast("timestamp").alias("_t"),
                          F.col("pos").alias("_e"))
        w = Window.orderBy(F.col("_g"), F.col("_t").asc(), F.col("_e").desc())
        both = pushed.unionByName(old.withColumn("_e", -F.col("_e")))     # old keeps its order
        new = (both.orderBy(F.col("_g"), F.col("_t").asc(), F.col("_e").desc()).limit(cap)
               .select("review_id", F.row_number().over(w).cast("long").alias("pos")))
        new.write.mode("overwrite").parquet(f"{base}/v={batch_id}")
        spark.read.parquet(f"{base}/v={batch_id}").write.mode("overwrite").parquet(f"{base}/latest")
    return write


def run_available_now(df: DataFrame, sink, checkpoint: str | None = None, name: str = "alerts",
                      timeout_s: int | None = None) -> str:
    """Drain everything currently in the source (``availableNow``) through the
    foreachBatch sink; returns the checkpoint location. A time limit only where one is given."""
    spark = df.sparkSession
    ck = checkpoint or scratch_path(spark, f"{name}-ckpt")
    q = (df.writeStream.foreachBatch(sink).option("checkpointLocation", ck)
         .trigger(availableNow=True).start())
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream {name} did not drain in {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()
    return ck


def start_live(df: DataFrame, sink, checkpoint: str, period: str = "10 seconds"):
    """The live job: a micro-batch every ``period`` (the original polled every 10 s).
    Forgetting all sent alerts (I10) = starting with a new checkpoint folder."""
    return (df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(processingTime=period).start())
