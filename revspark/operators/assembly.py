"""Texts assembled from ordered lines in pieces of bounded size.

The original joins all lines of a product into one text. Here the lines are sorted by a range partitioning on group and order, so a group may span many
tasks; each task joins runs of its lines into *segments* of at most ``segment_chars`` characters (a longer
line is a segment by itself) and numbers them within their group. Only a task's first group can have begun in an earlier task, so one prefix offset per task
continues its numbers; these offsets, a row per task at most, are what is broadcast. The
segments of a group in order, joined by the same separator, are the whole text; no group is ever one value or one task.

Null lines count as empty. Ties in the order are left to the order columns; give enough of them.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship_package
from ..sources import io

SEGMENT_CHARS = 1 << 20


def _join(keys: list[str], most: int, sep: str, out: pa.Schema):
    """Sorted rows (keys, line) -> segments with the task and their number in it."""
    def run(batches):
        task, at, now, lines, size, rows = TaskContext.get().partitionId(), 0, None, [], 0, []

        def close():
            nonlocal at, lines, size
            if lines:
                rows.append((*now, task, at, len(lines), sep.join(lines)))
                at, lines, size = at + 1, [], 0

        def take():
            nonlocal rows
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)]
            rows = []
            return pa.RecordBatch.from_arrays(columns, schema=out)
        for b in batches:
            for *group, line in zip(*(b.column(k).to_pylist() for k in [*keys, "_line"])):
                if group != now or size + len(line) > most:
                    close()
                    at = at if group == now else 0
                    now = group
                lines.append(line)
                size += len(line) + len(sep)
                if len(rows) >= 64:
                    yield take()
        close()
        if rows:
            yield take()
    return run


def assemble(df: DataFrame, keys: Sequence[str], order: Sequence[Column], line: Column, sep: str = "\n",
             segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """keys, segment (0, 1, ...), n_lines, text: the lines of each group in ``order``, in segments."""
    ship_package(df.sparkSession)
    keys = list(keys)
    named = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    rows = df.select(*keys, F.coalesce(line, F.lit("")).alias("_line"), F.struct(*named).alias("_order")) if named else \
        df.select(*keys, F.coalesce(line, F.lit("")).alias("_line"), F.lit(0).alias("_order"))
    rows = rows.repartitionByRange(*keys, "_order").sortWithinPartitions(*keys, "_order").select(*keys, "_line")
    spark = df.sparkSession
    empty = spark.createDataFrame([], rows.select(*keys).schema)
    schema = empty.selectExpr(*[f"`{k}`" for k in keys], "0 as _task", "0L as _at", "0L as n_lines", "'' as text").schema
    from pyspark.sql.pandas.types import to_arrow_schema
    parts = io.stage(rows.mapInArrow(_join(keys, segment_chars, sep, to_arrow_schema(schema)), schema), "segments")
    counts = parts.groupBy(*keys, "_task").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)      # a row per task
    counts = counts.withColumn("_before", F.sum("_n").over(ahead)).where(F.col("_before") > 0)
    on = F.col("s._task") == F.col("c._task")
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}"))
    return parts.alias("s").join(F.broadcast(counts.alias("c")), on, "left").select(
        *[F.col(f"s.{k}") for k in keys], (F.col("_at") + F.coalesce("_before", F.lit(0))).alias("segment"), "n_lines", "text")


def digests(segments: DataFrame, keys: Sequence[str], sep: str = "\n") -> DataFrame:
    """keys, n_lines, n_chars, text_sha256 of each group's whole text, hashed a segment at a time."""
    keys = list(keys)

    def run(batches):
        now, sha, lines, chars, out = None, None, 0, 0, []
        for b in batches:
            for *group, n, text in zip(*(b.column(k).to_pylist() for k in [*keys, "n_lines", "text"])):
                if group != now:
                    if now is not None:
                        out.append((*now, lines, chars, sha.hexdigest()))
                    now, sha, lines, chars = group, hashlib.sha256(), 0, 0
                else:
                    sha.update(sep.encode())
                    chars += len(sep)
                sha.update(text.encode())
                lines, chars = lines + n, chars + len(text)
        if now is not None:
            out.append((*now, lines, chars, sha.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    from pyspark.sql.pandas.types import to_arrow_schema
    empty = segments.sparkSession.createDataFrame([], segments.select(*keys).schema)
    done = empty.selectExpr(*[f"`{k}`" for k in keys], "0L as n_lines", "0L as n_chars", "'' as text_sha256").schema
    schema = to_arrow_schema(done)
    sorted_ = segments.select(*keys, "segment", "n_lines", "text").repartition(*keys).sortWithinPartitions(*keys, "segment")
    return sorted_.mapInArrow(run, done)
