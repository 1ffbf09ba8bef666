"""Connected components of a distributed edge list by alternating star contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """edges(src, dst) of longs -> (node, comp): comp is the smallest node reachable.

    Nodes without an edge to another node are not returned; null ends are ignored. Each round
    hooks the larger neighbours of a node to its smallest one, then the node itself; minima are
    pre-aggregated, and a node with many edges is a skewed join that adaptive execution splits.
    The number of rounds is logarithmic; each ends in a written table."""
    e = stage.save(_ordered(edges.filter("src is not null and dst is not null").select(
        F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))), "edges")
    last = _print(e)
    while True:
        if not last[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _ordered(both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.inline(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        new = stage.save(_ordered(small), "edges")
        now = _print(new)
        stage.drop(e)
        e = new
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        last = now


def _ordered(e: DataFrame) -> DataFrame:
    return e.filter("a > b").distinct()


def _print(e: DataFrame) -> tuple:
    """One row that changes with the edges: their number and a sum of hashes."""
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]
