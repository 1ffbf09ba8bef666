"""Helpers that the operators share: table reads, staged tables in the shared folder,
and iteration over whole groups of a sorted Arrow stream."""
from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stage:
    """Written tables below the folder that ``spark.checkpoint.dir`` names: they cut lineage
    (a lost executor costs no more than the running step) and are read by all executors.

    ``drop`` removes a table that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, what: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{what}"

    def save(self, df: DataFrame, what: str) -> DataFrame:
        path = self.path(what)
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stage_path = path          # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_stage_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def whole_groups(batches, keys: list[str], least_rows: int = 20_000, most_rows: int | None = None):
    """Arrow batches sorted by ``keys`` -> tables that hold whole groups only.

    At most one unfinished group and ``least_rows`` rows are held, so a task needs memory for
    its largest group (callers bound that by splitting groups into blocks). With ``most_rows`` a group
    that is longer comes in pieces."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least_rows:
            continue
        t = pa.Table.from_batches(held)
        cut = bounds(t, keys)[-2]                  # start of the last group, perhaps unfinished
        if cut:
            yield t.slice(0, cut).combine_chunks()
            t = t.slice(cut)
        held, n = t.to_batches(), t.num_rows
        if most_rows and n >= most_rows:
            yield t.combine_chunks()
            held, n = [], 0
        elif cut == 0:
            least_rows = 2 * n                     # one group so far: look again when it has doubled
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row offsets at which groups start, and the row count."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def one_text_each(docs: DataFrame, pick: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, ``names`` of ``pick`` and a text for each of its ids that ``docs`` has: the one of least hash where an id has several, so a sample is
    as bounded as ``pick``, however often an id repeats."""
    found = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    return found.groupBy("doc_id", *names).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def unused(taken, name: str) -> str:
    """``name``, with underscores before it until no column of ``taken`` (in any case) has it."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def flat(values: list, type_: pa.DataType) -> pa.Array:
    return pa.array(values, type=type_)
