"""Vector code compression: product codes trained with Drake-Hamerly adaptive bounds, exact in integers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook trained by rounds of
nearest-entry assignment and floored means. Every part of every vector persists its ``b`` closest entries (the first is its
own), an upper bound of the distance to its own entry, lower bounds of the others in order, and one outer bound for all
entries not listed. Entries that move loosen the bounds by the length of their move. Where the upper bound stays
below all lower bounds the assignment can't have changed and nothing is computed. Otherwise the own distance is taken
anew, then those of listed entries that may be nearer, and only where the outer bound is reached too those of the whole
codebook. Distances are compared as 64-bit integers, so ties go to the lower index; bounds are floats rounded
outwards. ``b`` follows the list positions that the last round needed and shrinks as the bounds get tighter.

A round is one Spark job: it reads the state table, writes the next one, and leaves in the same table each task's partial
sums (one row per part position and entry), which Spark adds up; the driver sees as many rows as the codebooks have numbers.

Cases: vectors that are null or hold null or non-finite components are dropped, and so are those with a
component so large that squared distances leave 64 bits (``largest``). Vectors of each length have codebooks of their own; a length that
isn't a multiple of the number of parts is extended with zeros. With fewer vectors than entries a codebook is
shorter; the first entries go by vec_id (null last), then by content; repeated rows count as often as they occur. A
null label is a label. A sum of errors beyond 64 bits is null. No rows give no rows.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
FIRST_B = 8                 # entries listed at first
COVER = 0.99                # of the parts that looked at their list, so many must find their entry in the next one
STEP = 2048                 # vectors handled at once


def largest(length: int) -> int:
    """Greatest absolute component with which all sums of squared differences fit in 64 bits."""
    return math.isqrt((1 << 62) // max(length, 1)) // 2


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def _root_up(d: np.ndarray) -> np.ndarray:
    return _up(_up(np.sqrt(_up(d.astype(float)))))


def _root_down(d: np.ndarray) -> np.ndarray:
    return np.maximum(_down(_down(np.sqrt(np.maximum(_down(d.astype(float)), 0)))), 0)


def moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Distances, rounded up, that the entries [part, entry, component] moved."""
    d = ((new - old) ** 2).sum(axis=2)
    return np.where(d > 0, _root_up(d), 0.0)


class Bounds:
    """State of the parts of some vectors, flattened: part position, values, listed entries and bounds."""

    def __init__(self, part: np.ndarray, x: np.ndarray, books: np.ndarray):
        self.part, self.x, self.books, self.k = part, x, books, books.shape[1]

    def distance(self, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((self.x[rows] - self.books[self.part[rows], entry]) ** 2).sum(axis=1)

    def search(self, rows: np.ndarray, b: int) -> tuple:
        """Lists and bounds of these rows from all their distances."""
        d = ((self.x[rows, None, :] - self.books[self.part[rows]]) ** 2).sum(axis=2)
        order = np.argsort(d, axis=1, kind="stable")          # equal distances: lower index first
        d = np.take_along_axis(d, order, axis=1)
        outer = _root_down(d[:, b]) if b < self.k else np.full(len(rows), np.inf)
        return order[:, :b], _root_up(d[:, 0]), _root_down(d[:, 1:b]), outer

    def first(self, b: int) -> None:
        self.near, self.upper, self.lower, self.outer = self.search(np.arange(len(self.x)), b)

    def update(self, near, upper, lower, outer, moved: np.ndarray, needed: np.ndarray) -> None:
        """The state under books whose entries moved by ``moved``; ``needed`` counts, by list position,
        the last one a row had to look at (0: none, b: the whole codebook)."""
        part, b = self.part, near.shape[1]
        upper = _up(upper + moved[part, near[:, 0]])
        lower = _down(lower - moved[part[:, None], near[:, 1:]])
        outer = _down(outer - moved.max(axis=1)[part])
        order = np.argsort(lower, axis=1, kind="stable")
        lower = np.take_along_axis(lower, order, axis=1)
        near = np.concatenate([near[:, :1], np.take_along_axis(near[:, 1:], order, axis=1)], axis=1)
        bar = np.minimum(lower.min(axis=1, initial=np.inf), outer)
        self.near, self.upper, self.lower, self.outer = near, upper, lower, outer
        rows = np.flatnonzero(upper >= bar)
        needed[0] += len(part) - len(rows)
        own = self.distance(rows, near[rows, 0])
        self.upper[rows] = _root_up(own)
        doubt = self.upper[rows] >= bar[rows]
        needed[0] += int((~doubt).sum())
        rows, own = rows[doubt], own[doubt]
        whole = self.upper[rows] >= self.outer[rows]
        self._listed(rows[~whole], own[~whole], needed)
        rows = rows[whole]
        needed[b] += len(rows)
        if len(rows):
            self.near[rows], self.upper[rows], self.lower[rows], self.outer[rows] = self.search(rows, b)

    def _listed(self, rows: np.ndarray, own: np.ndarray, needed: np.ndarray) -> None:
        """Rows whose own entry is one of their list: integer distances of those that may be nearer."""
        if not len(rows):
            return
        near, b = self.near[rows], self.near.shape[1]
        bound = np.concatenate([np.zeros((len(rows), 1)), self.lower[rows]], axis=1)
        exact = np.full((len(rows), b), np.iinfo(np.int64).max)
        exact[:, 0] = own
        last = np.zeros(len(rows), np.int64)
        for j in range(1, b):
            at = np.flatnonzero(bound[:, j] <= self.upper[rows])
            exact[at, j] = self.distance(rows[at], near[at, j])
            last[at] = j
        np.add.at(needed, last, 1)
        known = exact < np.iinfo(np.int64).max
        bound = np.where(known, _root_down(exact), bound)
        best = np.lexsort((near, exact), axis=1)[:, 0]        # least distance, then least index
        at = np.arange(len(rows))
        self.upper[rows] = _root_up(exact[at, best])
        bound[at, best] = -1.0                                # the nearest goes first
        order = np.argsort(bound, axis=1, kind="stable")
        self.near[rows] = np.take_along_axis(near, order, axis=1)
        self.lower[rows] = np.take_along_axis(bound, order, axis=1)[:, 1:]

    def shorten(self, b: int) -> None:
        """Keep ``b`` listed entries; the others fall under the outer bound."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b - 1:].min(axis=1))
            self.near, self.lower = self.near[:, :b], self.lower[:, :b - 1]


def next_b(b: int, needed: list[int], cover: float = COVER) -> int:
    """The list length under which ``cover`` of the rows that looked at their list or beyond it would have found their
    entry; never longer than ``b``, at least an eighth of it or 2."""
    looked = np.asarray(needed[1:], float)
    if b <= 2 or not looked.sum():
        return min(b, 2)
    enough = int(np.searchsorted(np.cumsum(looked) / looked.sum(), cover)) + 2     # entry 0 and the positions
    return max(min(b, enough), 2)


STATE = ("v array<int>, near array<short>, upper array<double>, lower array<double>, outer array<double>, "
         "sums struct<length:int, part:int, entry:int, n:long, total:array<long>>")


class Books:
    """What a round ships to its tasks: per vector length the entries, their moves and the list lengths."""

    def __init__(self, books: dict, moved: dict, b: dict, keep: dict):
        self.books, self.moved, self.b, self.keep = books, moved, b, keep


def _values(col: pa.Array, kind) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)


def _by_length(batch: pa.RecordBatch, column: str):
    """Slices of at most ``STEP`` rows whose vectors have one length."""
    lengths = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for a in range(0, len(at), STEP):
            yield int(length), batch.take(pa.array(at[a:a + STEP]))


def _lists(x: np.ndarray, type_: pa.DataType) -> pa.Array:
    n, width = x.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int64) * width, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1), type_))


def _parts(v: np.ndarray, n: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    m = length // PARTS
    return np.tile(np.arange(PARTS), n), v.reshape(n * PARTS, m)


def _read(t: pa.RecordBatch, length: int, ship: Books) -> tuple:
    n, b = t.num_rows, ship.b[length]
    part, x = _parts(_values(t.column("v"), np.int64), n, length)
    state = Bounds(part, x, ship.books[length])
    return n, state, (_values(t.column("near"), np.int64).reshape(n * PARTS, b), _values(t.column("upper"), float),
                      _values(t.column("lower"), float).reshape(n * PARTS, b - 1), _values(t.column("outer"), float))


def _round(ship: Books, schema: pa.Schema, start: bool):
    """State rows under the last books -> state rows under these books, and the task's partial sums."""
    def run(batches):
        sums, counts, needed = {}, {}, {}
        for batch in batches:
            for length, t in _by_length(batch, "v"):
                books = ship.books[length]
                if length not in sums:
                    sums[length], counts[length] = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
                    needed[length] = np.zeros(ship.b[length] + 1, np.int64)
                if start:
                    n = t.num_rows
                    state = Bounds(*_parts(_values(t.column("v"), np.int64), n, length), books)
                    state.first(ship.b[length])
                else:
                    n, state, old = _read(t, length, ship)
                    state.update(*old, ship.moved[length], needed[length])
                state.shorten(ship.keep[length])
                own = state.near[:, 0]
                np.add.at(sums[length], (state.part, own), state.x)
                np.add.at(counts[length], (state.part, own), 1)
                yield pa.RecordBatch.from_arrays(
                    [t.column("vec_id"), t.column("label"), t.column("v"),
                     _lists(state.near.reshape(n, -1), pa.int16()), _lists(state.upper.reshape(n, -1), pa.float64()),
                     _lists(state.lower.reshape(n, -1), pa.float64()), _lists(state.outer.reshape(n, -1), pa.float64()),
                     pa.nulls(n, schema.field("sums").type)], schema=schema)
        rows = []
        for length, s in sums.items():
            rows += [dict(length=length, part=p, entry=e, n=int(counts[length][p, e]), total=s[p, e].tolist())
                     for p in range(s.shape[0]) for e in range(s.shape[1]) if counts[length][p, e]]
            rows.append(dict(length=length, part=-1, entry=-1, n=0, total=needed[length].tolist()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(len(rows), f.type) for f in list(schema)[:-1]), pa.array(rows, schema.field("sums").type)], schema=schema)
    return run


def _finish(ship: Books, schema: pa.Schema, hashes: dict):
    """The last assignment: codes and exact errors."""
    def run(batches):
        for batch in batches:
            for length, t in _by_length(batch, "v"):
                n, state, old = _read(t, length, ship)
                state.update(*old, ship.moved[length], np.zeros(ship.b[length] + 1, np.int64))
                own = state.near[:, 0]
                error = state.distance(np.arange(len(own)), own).reshape(n, PARTS).sum(axis=1)
                text = own.astype(np.uint8).tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [t.column("vec_id"), t.column("label"), pa.array([text[i:i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]),
                     pa.array(error), pa.array([hashes[length]] * n)], schema=schema)
    return run


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(df.schema)


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v: floored components, extended with zeros to a multiple of the parts; bad vectors dropped."""
    size = F.size("embedding")
    width = F.ceil(size / PARTS) * PARTS
    bound = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(width, F.lit(1))) / 2) - 1
    good = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) * scale <= bound, F.lit(False)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    zeros = F.array_repeat(F.lit(0), (width - size).cast("int"))
    return (vectors.filter(F.col("embedding").isNotNull() & good)
            .select("vec_id", "label", F.concat(v, zeros).alias("v")))


def _first_books(state: DataFrame, entries: int) -> dict[int, np.ndarray]:
    order = Window.partitionBy(F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    rows = (state.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= entries)
            .select(F.size("v").alias("length"), "no", "v").orderBy("length", "no").collect())
    books: dict[int, list] = {}
    for r in rows:
        books.setdefault(r.length, []).append(r.v)
    return {n: np.array(v, np.int64).reshape(len(v), PARTS, n // PARTS).transpose(1, 0, 2).copy() for n, v in books.items()}


def _next_books(state: DataFrame, books: dict) -> tuple[dict, dict]:
    """Floored means of the assigned parts (unused entries stay), and how many rows needed which list position."""
    rows = (state.filter("sums is not null").select("sums.*")
            .select("length", "part", "entry", "n", F.posexplode_outer("total"))
            .groupBy("length", "part", "entry", "pos")
            .agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect())
    new = {length: b.copy() for length, b in books.items()}
    needed: dict[int, dict] = {length: {} for length in books}
    for r in rows:
        if r.part < 0:
            needed[r.length][r.pos] = int(r.total)
        elif r.pos is not None:
            new[r.length][r.part, r.entry, r.pos] = int(r.total) // int(r.n)
    return new, {length: [n[i] for i in sorted(n)] for length, n in needed.items()}


def books_sha256(books: np.ndarray) -> str:
    """Hash of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, stage: Stage, rounds: int = ROUNDS, entries: int = ENTRIES, first_b: int = FIRST_B) -> tuple[DataFrame, dict]:
    """vectors(vec_id, embedding, label) -> (vec_id, label, code, error, codebooks_sha256), and the
    codebooks [part, entry, component] by (padded) vector length. ``entries`` is at most 256."""
    if rounds < 1:
        raise ValueError("at least one round")
    state = stage.save(integer_vectors(vectors), "vectors")
    books = _first_books(state, entries)
    b = {length: min(first_b, x.shape[1]) for length, x in books.items()}
    keep = b
    moved = {length: np.zeros(x.shape[:2]) for length, x in books.items()}
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields[:2])
    full = stage.spark.createDataFrame([], f"{kinds}, {STATE}")
    for i in range(rounds):
        ship = Books(books, moved, b, keep)
        new = stage.save(state.mapInArrow(_round(ship, _arrow(full), i == 0), full.schema), f"round{i}")
        stage.drop(state)
        b = ship.keep
        after, needed = _next_books(new, books)
        keep = {n: b[n] if i == 0 else next_b(b[n], needed[n]) for n in b}
        moved, books, state = {n: moves(books[n], after[n]) for n in books}, after, new.filter("v is not null")
        state._stage_path = new._stage_path
    out = stage.spark.createDataFrame([], f"{kinds}, code string, error long, codebooks_sha256 string")
    hashes = {n: books_sha256(x) for n, x in books.items()}
    coded = stage.save(state.mapInArrow(_finish(Books(books, moved, b, b), _arrow(out), hashes), out.schema), "codes")
    stage.drop(state)
    return coded, books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, _ = compress(table(spark, sf_dir, "embeddings"), Stage(spark, "op13"))
    sums = (coded.groupBy(F.col("label").alias("of_label"))
            .agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")))
    return (coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "code", "error", "label_error", "codebooks_sha256"))


def _sql() -> str:
    """Plain rounds: every part against every entry, in long form (a row per component)."""
    parts = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS no FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT no, (i - 1) // (len(e) // {PARTS}) AS part, (i - 1) % (len(e) // {PARTS}) AS pos,
  CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT no, e, unnest(range(1, len(e) + 1)) AS i FROM kept)),
b0 AS MATERIALIZED (SELECT part, no AS entry, pos, v FROM x WHERE no < {ENTRIES})"""
    for r in range(ROUNDS + 1):
        parts += f""",
d{r} AS (SELECT x.no, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{r} b USING (part, pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT no, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM d{r} GROUP BY ALL)"""
        if r < ROUNDS:
            parts += f""",
m{r} AS (SELECT x.part, a.entry, x.pos, sum(x.v) AS s, count(*) AS n FROM x JOIN a{r} a USING (no, part) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN b.v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v
  FROM b{r} b LEFT JOIN m{r} USING (part, entry, pos))"""
    return parts + f""",
c AS (SELECT no, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY no)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{ROUNDS}) AS codebooks_sha256
FROM c JOIN kept USING (no)"""


SQL = {"op13_codes": _sql()}
