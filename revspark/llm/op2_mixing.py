"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the fractional copy number ``target / source_size``.
Pairs of documents exchange mass measured in words: one gains what the other loses, by a random
direction whose odds keep both expectations, until one of them is integral. So the words a
source contributes stay exactly at its target all along; only the last unpaired document of a
source is rounded by a coin. The gap that the coin leaves is then closed as far as it goes: documents of the root's block, from large
to small, change sides where that brings the source nearer to its target. A source is split by a hash into blocks; in a block documents meet in
order of falling size, so that what is left over is small, and the blocks' leftovers are combined
up a tree of blocks. A block that repeated rows make longer than ``MOST`` rows is rounded in pieces.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a source of its
own, last in order; repeated and null ``doc_id`` are ordinary rows; no rows give no rows.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, bounds, table, unused, whole_groups

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 4096            # documents of a source in a block, about
FAN_IN = 1024           # blocks that one node of the reduction tree combines
MOST = 16 * BLOCK       # rows that a task rounds at once


def source_targets(sizes: list[tuple], weights: list[float], factor: float, cap: float) -> list[float]:
    """Targets of sources (in order) that share ``factor`` times all words by weight; a source
    stops at ``cap`` times its own words and the excess is shared among the others by weight."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    goal = factor * sum(sizes)
    capped: set[int] = set()
    while True:
        rest = sum(w[i] for i in range(len(sizes)) if i not in capped)
        left = goal - sum(cap * sizes[i] for i in capped)
        out = [cap * s if i in capped else (left * w[i] / rest if rest else 0.0) for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and out[i] >= cap * s}
        if not over:
            return out
        capped |= over


def pivotal(words: list[float], x: list[float], rng) -> int:
    """Round ``x`` in place to 0/1 keeping ``sum(words * x)`` and each expectation; returns the
    index of the one entry left fractional, or -1."""
    c = -1
    for i in range(len(x)):
        if not 0.0 < x[i] < 1.0:
            continue
        if c < 0:
            c = i
            continue
        room_c, mass_c = (1.0 - x[c]) * words[c], x[c] * words[c]
        room_i, mass_i = (1.0 - x[i]) * words[i], x[i] * words[i]
        up, down = min(room_c, mass_i), min(mass_c, room_i)
        if rng.random() * (up + down) < down:            # c gains ``up`` words, i loses them
            x[c] = 1.0 if room_c <= mass_i else x[c] + up / words[c]
            x[i] = 0.0 if mass_i <= room_c else x[i] - up / words[i]
        else:
            x[c] = 0.0 if mass_c <= room_i else x[c] - down / words[c]
            x[i] = 1.0 if room_i <= mass_c else x[i] + down / words[i]
        if not 0.0 < x[c] < 1.0:
            c = i if 0.0 < x[i] < 1.0 else -1
    return c


def close_gap(words: list[float], x: list[float], gap: float) -> float:
    """Turn entries of the integral ``x``, from large to small, where that brings ``gap`` (words above the target)
    nearer to 0; returns the gap that remains."""
    for i in sorted(range(len(x)), key=lambda i: -words[i]):
        turned = gap + (words[i] if x[i] == 0.0 else -words[i])
        if abs(turned) < abs(gap):
            x[i], gap = 1.0 - x[i], turned
    return gap


KEYS = ["src", "salt"]


def _round_blocks(level: int, seed: int, last: bool):
    """Arrow function over rows sorted by ``KEYS`` and falling size: rounds each block."""
    def run(batches):
        for t in whole_groups(batches, KEYS, most_rows=MOST):
            cut = bounds(t, KEYS)
            size = t.column("size").to_numpy().astype(float)
            frac = t.column("frac").to_numpy().copy()
            src, part = t.column("src").to_numpy(), t.column("salt").to_numpy()
            for a, b in zip(cut[:-1], cut[1:]):
                rng = np.random.default_rng([seed, level, int(src[a]), int(part[a])])
                x = frac[a:b].tolist()
                words = size[a:b].tolist()
                open_ = [i for i, v in enumerate(x) if 0.0 < v < 1.0]
                left = pivotal(words, x, rng)
                if last and left >= 0:
                    share = x[left]
                    x[left] = float(rng.random() < share)
                    some = [x[i] for i in open_]
                    close_gap([words[i] for i in open_], some, (x[left] - share) * words[left])
                    for i, v in zip(open_, some):
                        x[i] = v
                frac[a:b] = x
            yield from t.set_column(t.schema.get_field_index("frac"), "frac", pa.array(frac)).to_batches()
    return run


def mix_sources(docs: DataFrame, stage: Stage, weights=(3.0, 1.0, 2.0), factor: float = 1.5,
                cap: float = 2.0, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken.

    ``weights`` repeat over the sources in code point order, null last. The per-source totals
    (one row per source of the mixture) are solved on the driver."""
    spark = docs.sparkSession
    slim = stage.save(docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"),
                                  F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    totals = (slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("source").asc_nulls_last()).collect())
    targets = source_targets([r.source_size for r in totals], list(weights), factor, cap)
    salts = [max(1, math.ceil(r.n / BLOCK)) for r in totals]
    share = spark.createDataFrame(
        [(i, r.source, r.source_size, float(t), float(t) / r.source_size if r.source_size else 0.0, s)
         for i, (r, t, s) in enumerate(zip(totals, targets, salts))],
        "src int, name string, source_size long, target double, p double, salts int")
    base = F.floor(F.col("p") + 1e-9)
    rows = (slim.join(share, F.col("source").eqNullSafe(F.col("name")), "left")
            .select("doc_id", "source", "size", "src", "source_size", "target", base.cast("int").alias("base"),
                    F.when((F.col("size") == 0) | (F.col("p") - base < 1e-9), 0.0).otherwise(F.col("p") - base)
                    .alias("frac"),
                    F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(seed)), F.col("salts").cast("long")).cast("long").alias("salt")))
    settled = (F.col("frac") <= 0.0) | (F.col("frac") >= 1.0)
    level, spread, done = 0, max(salts, default=1), []
    while True:
        last = spread == 1
        dealt = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, F.desc("size"), "doc_id")
        out = stage.save(dealt.mapInArrow(_round_blocks(level, seed, last), rows.schema), f"level{level}")
        if level == 0:
            stage.drop(slim)
        done.append(out.filter(settled))
        if last:
            break
        rows = out.filter(~settled).withColumn("salt", F.floor(F.col("salt") / FAN_IN))
        spread, level = math.ceil(spread / FAN_IN), level + 1
    whole = done[0]
    for d in done[1:]:
        whole = whole.unionByName(d)
    copies = (F.col("base") + F.col("frac").cast("int")).alias("copies")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def take_copies(docs: DataFrame, mixed: DataFrame, stage: Stage) -> DataFrame:
    """The documents of ``docs``, each as often as ``mix_sources`` decided (0 to 2 times).

    Texts cross the network once at most, to the rows of ``mixed`` reduced to one per (doc_id, source, size), and aren't sorted. Rows that
    agree in the three have numbers of copies that differ by one at most; where they do, those rows alone are numbered (in slices, so that
    no key is one task) and the first ones get the greater number. All columns of ``docs`` come back as they are, whatever their names."""
    names = [unused(docs.columns, n) for n in ("_k1", "_k2", "_k3", "_low", "_high", "_more", "_slice", "_no", "_before", "_i")]
    k1, k2, k3, low, high, more, slice_, no, before, i = names
    keys = [k1, k2, k3]
    keyed = lambda df, size: df.withColumns(
        {k1: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), k2: F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), k3: size})
    right = (keyed(mixed.select("doc_id", "source", "size", "copies"), F.col("size")).groupBy(*keys)
             .agg(F.min("copies").alias(low), F.max("copies").alias(high), F.sum(F.col("copies").cast("long")).alias("sum"),
                  F.count(F.lit(1)).alias("n")))
    right = stage.save(right.filter(F.col(high) > 0).select(*keys, low, high, (F.col("sum") - F.col("n") * F.col(low)).alias(more)), "copies")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    wanted = keyed(docs, size).join(right.hint("shuffle_hash"), keys)
    plain = wanted.filter(F.col(low) == F.col(high)).withColumn(i, F.col(low))
    mixed_keys = right.filter(F.col(low) < F.col(high))
    if not mixed_keys.isEmpty():
        some = keyed(docs, size).join(mixed_keys.hint("shuffle_hash"), keys)
        some = stage.save(some.withColumn(slice_, F.pmod(F.monotonically_increasing_id(), F.lit(1024))), "numbered")
        counts = some.groupBy(*keys, slice_).agg(F.count(F.lit(1)).alias(no))
        ahead = Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)    # at most 1024 rows a key
        counts = counts.select(*keys, slice_, F.coalesce(F.sum(no).over(ahead), F.lit(0)).alias(before))
        within = Window.partitionBy(*keys, slice_).orderBy(F.xxhash64("text"))
        some = some.withColumn(no, F.row_number().over(within)).join(counts, [*keys, slice_])
        extra = F.when(F.col(no) + F.col(before) <= F.col(more), F.col(high) - F.col(low)).otherwise(0)
        some = some.withColumn(i, F.col(low) + extra).filter(F.col(i) > 0)
        plain = plain.select(*docs.columns, i).unionByName(some.select(*docs.columns, i))
    return plain.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(i)))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix_sources(docs, Stage(spark, "op2")).select("doc_id", "size", "source_size", "target", "taken", "copies")
