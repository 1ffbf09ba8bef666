"""Sources and sinks: landing Parquet, relational tables, staging, the per-day
accumulation, per-day analysis partitions, CSV exchange and JSON projection.

Connection details are always caller-supplied options; nothing here names a host.
Writes that replace data read in the same job write the new version beside the old one and
swap them by renaming (``replace_table``), so no job reads files that it deletes, and a driver
lost at any moment leaves a whole table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DataType, DateType, DecimalType, DoubleType, IntegerType, MapType, StringType,
                               StructField, StructType, TimestampNTZType, TimestampType)

# --- schemas -------------------------------------------------------------------------------
LANDING_SCHEMA = StructType([StructField(c, StringType()) for c in
                             ("review_id", "product_id", "rating", "review_text", "review_date", "review_size")])
ANALYSIS_SCHEMA = StructType([
    StructField("review_id", StringType()), StructField("product_id", StringType()),
    StructField("sentence", StringType()), StructField("category", StringType()),
    StructField("sentiment", IntegerType()), StructField("rating", DoubleType()),
    StructField("review_date", DateType())])


# --- A1 / A2: reads ----------------------------------------------------------------------------
def read_landing(spark: SparkSession, path: str, day: str | None = None,
                 schema: StructType = LANDING_SCHEMA) -> DataFrame:
    """A day-partitioned landing directory (``dt=yyyyMMdd`` sub-folders) or a plain
    folder of Parquet files. An explicit schema avoids inference and survives
    empty days; the ``dt`` filter is a partition filter."""
    df = spark.read.schema(schema).option("basePath", path).parquet(path) if day is None else \
        spark.read.schema(schema).parquet(f"{path.rstrip('/')}/dt={day}")
    return df


def read_table(spark: SparkSession, fmt: str, columns: Sequence[str] | None = None,
               where: Column | None = None, path: str | None = None, **options) -> DataFrame:
    """A relational source (``jdbc`` with caller options, or a file format). Column
    pruning and the filter are pushed to the source by Catalyst."""
    r = spark.read.format(fmt).options(**options)
    df = r.load(path) if path else r.load()
    if columns:
        df = df.select(*columns)
    return df.where(where) if where is not None else df


# --- A3: staging -----------------------------------------------------------------------------
def write_staging(df: DataFrame, fmt: str, path: str | None = None, **options) -> None:
    """Replace the staging table with this batch (JDBC keeps the table, truncating it)."""
    w = df.write.mode("overwrite").format(fmt).options(**options)
    if fmt == "jdbc":
        w = w.option("truncate", "true")
    w.save(path) if path else w.save()


# --- tables that are replaced --------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    """Is there a folder at ``path`` (errors of the file system are raised)."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at ``path``; None only if nothing is there. An unreadable table raises.
    A replacement that was cut short between its two renames is undone first."""
    path = path.rstrip("/")
    if not table_exists(spark, path) and table_exists(spark, f"{path}.previous"):
        rename(spark, f"{path}.previous", path)
    return spark.read.parquet(path) if table_exists(spark, path) else None


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` by ``df``, which may read it: the new version is written beside it
    and takes its place by renaming; the old one goes last, so a copy exists at all times."""
    spark, path = df.sparkSession, path.rstrip("/")
    df.write.mode("overwrite").parquet(f"{path}.next")
    fs, old = _fs(spark, f"{path}.previous")
    if table_exists(spark, path):
        fs.delete(old, True)
        rename(spark, path, f"{path}.previous")
    rename(spark, f"{path}.next", path)
    fs.delete(old, True)
    return spark.read.parquet(path)


def rename(spark: SparkSession, a: str, b: str) -> None:
    fs, p = _fs(spark, a)
    if not fs.rename(p, _fs(spark, b)[1]):
        raise OSError(f"cannot rename {a} to {b}")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names in the folder at ``path``, sorted; none where there is no folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file (manifests, journals), replacing one at ``path``."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


# --- A4 / A5: the day's landing file ---------------------------------------------------------
def accumulate(existing: DataFrame | None, new: DataFrame, order: str, key: str = "review_id") -> DataFrame:
    """existing ∪ new, keeping the last row per key in ``order`` (new rows come after
    the stored ones when ``order`` says so)."""
    from ..operators.ingest import dedup_keep_last
    u = new if existing is None else existing.unionByName(new, allowMissingColumns=True)
    return dedup_keep_last(u, order, [key])


def save_day(spark: SparkSession, new: DataFrame, path: str, order: str,
             key: str = "review_id", schema: StructType | None = None) -> DataFrame:
    """Accumulate a batch into a day's Parquet folder: existing rows and the batch are merged (keep
    last) into a new version that replaces the folder. An empty batch still writes a typed empty file."""
    existing = read_if_exists(spark, path)
    if schema is not None and new.isEmpty():
        new = spark.createDataFrame([], schema)
    merged = accumulate(existing, new, order, key)
    return replace_table(merged, path)


def accumulate_day(commit, new: DataFrame, table: str, order: str, key: str = "review_id", buckets: int = 64) -> list[str]:
    """``save_day`` over a table of a ``store.Store``: a batch rewrites only the buckets of the day that hold one of
    its keys. Visible once the commit is published."""
    from ..operators.ingest import dedup_keep_last
    return commit.reduce(table, new, key, buckets, lambda rows, keys: dedup_keep_last(rows, order, keys))


def empty_typed(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- A6: per-day analysis partitions -----------------------------------------------------------
def write_day_partitions(df: DataFrame, path: str, part: str = "review_date", day=None) -> None:
    """Overwrite only the days present in ``df`` (dynamic partition overwrite), so a
    re-run of a day is idempotent and other days are untouched. With ``day``, that day's old rows
    go even if ``df`` has none for it."""
    if day is not None:
        fs, folder = _fs(df.sparkSession, f"{path.rstrip('/')}/{part}={day}")
        if fs.exists(folder) and df.where(F.col(part) == F.lit(day).cast("date")).isEmpty():
            fs.delete(folder, True)
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(part).parquet(path))


def day_exists(spark: SparkSession, path: str, day, part: str = "review_date") -> bool:
    """Does the day's partition hold a row (a pruned scan that stops at one row)."""
    df = read_if_exists(spark, path)
    return df is not None and not df.where(F.col(part) == F.lit(day).cast("date")).limit(1).isEmpty()


# --- A8: CSV exchange --------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# --- A9: JSON projection -------------------------------------------------------------------------
def json_ready(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Decimals -> double at ``decimals`` dp, dates/timestamps -> 'yyyy-MM-dd HH:mm:ss', also
    inside structs, arrays and map values."""
    return df.select(*(_json_value(F.col(f"`{f.name}`"), f.dataType, decimals).alias(f.name) for f in df.schema.fields))


def _json_value(c: Column, t: DataType, decimals: int) -> Column:
    if isinstance(t, DecimalType):
        return F.bround(c, decimals).cast("double")
    if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(t, StructType):
        inner = F.struct(*(_json_value(c.getField(f.name), f.dataType, decimals).alias(f.name) for f in t.fields))
        return F.when(c.isNotNull(), inner)
    if isinstance(t, ArrayType):
        return F.transform(c, lambda x: _json_value(x, t.elementType, decimals))
    if isinstance(t, MapType):
        return F.transform_values(c, lambda _, v: _json_value(v, t.valueType, decimals))
    return c


def to_json_lines(df: DataFrame, col_name: str = "json") -> DataFrame:
    return json_ready(df).select(F.to_json(F.struct(*(f"`{c}`" for c in df.columns))).alias(col_name))


# --- parallelism for CPU-heavy row work ----------------------------------------------------
def balanced(df: DataFrame, factor: int = 2) -> DataFrame:
    """Spread a table's rows over the cluster before CPU-heavy per-row work (text regexes,
    HTML parsing) when its splits would not keep the cores busy: fewer splits than cores, or most rows in a
    few of them -- a row group is read by one task, however many splits its file is cut into. Rows per split
    are counted without reading a column. Inputs that are evenly split (the normal case at scale) are
    returned unchanged, with no shuffle; others are dealt out by row number, unsorted."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= cores:
        per = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("n"))
        most, rows = per.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if most * cores <= 2 * rows:
            return df
    n = max(cores * factor, splits)
    dealt = df.withColumn("_dealt", F.monotonically_increasing_id())
    return dealt.repartition(n, "_dealt").drop("_dealt")


#: Rows of a piece of a large shuffle: sorted rows of some hundred bytes stay in a task's memory.
PIECE_ROWS = 1_250_000


def pieces(spark: SparkSession, rows: int) -> int | None:
    """Partitions for a shuffle of that many rows, so that their number grows with the rows and no piece outgrows its task's
    memory; None while the session's own number of partitions is enough (``dealt``)."""
    n = -(-rows // PIECE_ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, n: int | None, *keys) -> DataFrame:
    """Rows dealt by ``keys`` into ``n`` pieces; without ``n`` as they are, for Spark to deal."""
    return df if n is None else df.repartition(n, *keys)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once into a staging table in the shared checkpoint folder and
    read it back. For an intermediate that several branches of one result read
    (Spark would otherwise recompute it per branch, since column pruning makes the
    branches differ); it also cuts the lineage, so a lost executor restarts from
    the staged files."""
    from ..session import scratch_path as _scratch
    path = _scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
