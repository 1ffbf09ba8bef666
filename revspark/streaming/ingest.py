"""Continuous ingest (I11): crawler output files arriving in the landing folder are
picked up by a file-source stream; each micro-batch runs the whole pipeline
(upsert + labelling) in ``foreachBatch``. The checkpoint records which files were
processed, and the keyed upsert makes a replayed batch harmless. With ``store_sink`` the three tables of a
batch become visible together and a replayed batch returns the metrics it gave first."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.pipeline import BUCKETS, PipelineConfig, run_batch, run_pipeline
from ..sources.io import LANDING_SCHEMA
from ..sources.store import Store


def ingest_stream(spark: SparkSession, cfg: PipelineConfig, as_of, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(LANDING_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(cfg.landing_path)


def pipeline_sink(cfg: PipelineConfig, as_of, metrics_path: str | None = None):
    """``as_of`` is a date, or a function of the batch id that gives each batch's own date (a replay of
    a batch must get the same one)."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():        # e.g. the closing batch of availableNow
            return
        m = run_pipeline(batch.sparkSession, cfg, as_of(batch_id) if callable(as_of) else as_of, landing=batch)
        if metrics_path:
            m.write.mode("overwrite").parquet(f"{metrics_path.rstrip('/')}/batch_id={batch_id}")
    return run


def store_sink(root: str, cfg: PipelineConfig, as_of, stream: str = "ingest", metrics_path: str | None = None, buckets: int = BUCKETS):
    """Like ``pipeline_sink`` over the tables of a ``Store`` at ``root``. ``stream`` names the checkpoint: batch ids
    count per checkpoint, so a new checkpoint over the same store needs a new name."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        m = run_batch(Store(batch.sparkSession, root), cfg, as_of(batch_id) if callable(as_of) else as_of, batch, f"{stream}-{batch_id}", buckets)
        if metrics_path:
            m.write.mode("overwrite").parquet(f"{metrics_path.rstrip('/')}/batch_id={batch_id}")
    return run
