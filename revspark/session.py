"""Session helpers: one place for the configs every job relies on."""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "revspark", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own master and confs."""
    b = SparkSession.builder.master(master).appName(app_name)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("REVSPARK_DRIVER_MEMORY", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared file system). Only when it
    is unset (local runs, tests) a fresh scratch folder is created and recorded.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="revspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder below the checkpoint dir for staged tables and stream state."""
    import uuid
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set = set()
_SHIP_LOCK = __import__("threading").Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``revspark`` importable on the executors' Python workers (pandas UDFs,
    ``mapInPandas``, ``applyInPandasWithState`` refer to its functions): zip the
    package once per SparkContext into the shared checkpoint folder and register
    it with ``addPyFile`` -- what ``--py-files`` does at submit time."""
    sc = spark.sparkContext
    key = sc.applicationId               # never used twice, unlike an object's id
    with _SHIP_LOCK:
        if key in _SHIPPED:
            return
        _ship(spark, sc)
        _SHIPPED.add(key)


def _ship(spark: SparkSession, sc) -> None:
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = scratch_path(spark, "pyfiles")
    local = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local:          # a cluster file system: build locally, Spark ships it
        local = tempfile.mkdtemp(prefix="revspark-pyfiles-")
    os.makedirs(local, exist_ok=True)
    zpath = os.path.join(local, "revspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
