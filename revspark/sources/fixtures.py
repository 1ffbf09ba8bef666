"""Review-shaped views over the driver's test tables.

One SQL text per view, rendered twice: for Spark, ``{name}`` placeholders become
DataFrame arguments of ``spark.sql`` (no global temp views, so several scale
factors can live in one session); for DuckDB they become plain CTE names. This is
test-input definition only; every operator works on the resulting DataFrames.
"""
from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import io

BASE_TABLES = ("part", "lineitem", "events", "documents", "labels", "pages",
               "conversations", "embeddings", "benchmark")

# A review's id and its place among rows of the same id, from a lineitem row.
REVIEW_ID = "l_orderkey * 10 + l_linenumber"
ORD = """concat_ws('|', cast(cast(l_shipdate AS date) AS string), lpad(cast(l_partkey AS string), 12, '0'), lpad(cast(l_suppkey AS string), 12, '0'),
                 lpad(cast(cast(l_quantity AS int) AS string), 4, '0'), lpad(cast(cast(round(l_extendedprice * 100) AS bigint) AS string), 14, '0'))"""

# Sentence, category and sentiment of a review's two analysis rows, and which reviews have the second.
S1 = ("concat('s1 q', cast(q AS string))",
      """CASE WHEN d % 2 = 0 AND ln % 7 <> 6 AND d % 6 <> ln % 7
            THEN concat(split_part('내구성 및 품질|디자인|사이즈|가성비|착용감|배송 및 포장 및 응대|기타', '|', 1 + ln % 7), ',',
                        split_part('내구성 및 품질|디자인|사이즈|가성비|착용감|배송 및 포장 및 응대', '|', 1 + d % 6))
            ELSE split_part('내구성 및 품질|디자인|사이즈|가성비|착용감|배송 및 포장 및 응대|기타', '|', 1 + ln % 7) END""", "s")
S2 = ("concat('s2 q', cast(q AS string))",
      "split_part('내구성 및 품질|디자인|사이즈|가성비|착용감|배송 및 포장 및 응대', '|', 1 + (ln + 2) % 6)",
      "CASE WHEN q % 8 = 0 THEN (s + 1) % 3 ELSE s END")
S2_IF = "q % 4 = 0"

# Fixed view texts (shared by the Spark side and the DuckDB oracle).
VIEWS: list[tuple[str, str]] = [
    ("products", """
SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category,
       CASE p_size % 3 WHEN 0 THEN '남자' WHEN 1 THEN '여자' ELSE '공용' END AS gender,
       concat(cast(cast(floor(p_retailprice / 10) AS bigint) AS string), ',',
              lpad(cast(cast(floor(p_retailprice) AS bigint) % 10 * 100 AS string), 3, '0')) AS price,
       concat('img/', cast(p_partkey AS string)) AS image_url
FROM {part}"""),
    ("reviews_raw", f"""
SELECT {REVIEW_ID} AS review_id,
       CASE WHEN l_linenumber <= 3 THEN l_partkey % 40 WHEN l_linenumber = 4 THEN l_partkey % 100 ELSE l_partkey END AS product_id,
       cast(cast(l_quantity AS int) % 5 + 1 AS double) AS rating,
       concat(l_returnflag, ' ', repeat('x', cast(l_quantity AS int))) AS review_text,
       cast(l_shipdate AS date) AS review_date,
       CASE l_suppkey % 7 WHEN 0 THEN concat('(', cast(l_suppkey AS string), ')Black · 225 구매') WHEN 1 THEN '230~240 구매'
            WHEN 2 THEN '40.5 구매' WHEN 3 THEN 'xl 구매' WHEN 4 THEN '블랙225구매' WHEN 5 THEN '블랙260' ELSE '사이즈 정보 없음' END AS review_size,
       cast(l_quantity AS int) AS q, l_linenumber AS ln, cast(round(l_discount * 100) AS int) AS d,
       {ORD} AS ord
FROM {{lineitem}}"""),
    ("reviews_base", """
SELECT review_id, product_id, rating, review_text, review_date, review_size, q, ln, d
FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY ord DESC) AS rn FROM {reviews_raw}) t WHERE rn = 1"""),
    ("reviews", """
SELECT review_id, product_id, rating, review_text, review_date, review_size FROM {reviews_base}"""),
    ("analysis_base", """
SELECT r.review_id, r.product_id, r.rating, r.review_date, r.q, r.ln, r.d,
       CASE WHEN r.q <= b.b THEN 0 WHEN r.q <= b.b + 5 THEN 1 ELSE 2 END AS s
FROM {reviews_base} r JOIN (SELECT p_partkey, cast(substr(p_brand, 7) AS int) AS b FROM {part}) b ON b.p_partkey = r.product_id"""),
    ("review_analysis", f"""
SELECT review_id, product_id, {S1[0]} AS sentence,
       {S1[1]} AS category,
       {S1[2]} AS sentiment, rating, review_date FROM {{analysis_base}}
UNION ALL
SELECT review_id, product_id, {S2[0]} AS sentence,
       {S2[1]} AS category,
       {S2[2]} AS sentiment, rating, review_date FROM {{analysis_base}} WHERE {S2_IF}"""),
    ("review_events", """
SELECT ts AS event_time, event_id, cast(user_id AS string) AS review_id,
       cast(regexp_extract(props, '[0-9]+', 0) AS bigint) AS product_id, event_type AS category,
       concat('e', cast(event_id AS string)) AS sentence,
       CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS sentiment,
       cast(cast(floor(value) AS bigint) % 5 + 1 AS double) AS rating, cast(ts AS date) AS review_date
FROM {events}"""),
    ("labelled_rows", """
SELECT *, CASE WHEN sentence LIKE 's1%' THEN 1 ELSE 2 END AS seq FROM {review_analysis}
UNION ALL
SELECT review_id, product_id, concat('s3', substr(sentence, 3)) AS sentence, category, (sentiment + 2) % 3 AS sentiment, rating, review_date, 3 AS seq
FROM {review_analysis} WHERE sentence LIKE 's1%' AND product_id % 6 = 0"""),
    # Landing-zone rows as the crawler writes them: every field a string, relative
    # date texts, missing fields and several size-option candidates.
    ("landing", """
SELECT cast(review_id AS string) AS review_id, cast(product_id AS string) AS product_id,
       CASE WHEN q % 11 = 0 THEN NULL ELSE cast(cast(rating AS int) AS string) END AS rating,
       CASE WHEN q % 13 = 0 THEN NULL ELSE review_text END AS review_text,
       CASE q % 8 WHEN 0 THEN '오늘' WHEN 1 THEN '어제' WHEN 2 THEN concat(cast(d AS string), '일 전')
            WHEN 3 THEN substr(replace(cast(review_date AS string), '-', '.'), 3)
            WHEN 4 THEN concat(substr(cast(review_date AS string), 3, 2), '.13.01')
            WHEN 5 THEN '방금' WHEN 6 THEN NULL ELSE 'x일 전' END AS date_text,
       CASE WHEN ln % 3 = 0 THEN 'FREE' ELSE review_size END AS size_opt1,
       concat(cast(q AS string), ' 구매 ') AS size_opt2,
       CASE WHEN q % 2 = 0 THEN NULL ELSE '색상 블랙' END AS size_opt3,
       review_date, ord
FROM {reviews_raw}"""),
    # Stored recent-list entries as text: valid JSON, Python-style single quotes
    # (kept as is: it starts with '{'), truncated JSON, and single-quoted text
    # behind a leading space (repaired by the reader).
    ("stored_alerts", """
SELECT event_id, CASE event_id % 4
         WHEN 0 THEN concat('{{"review_id": "', review_id, '", "category": "', category, '", "sentiment": ', cast(sentiment AS string), '}}')
         WHEN 1 THEN concat('{{''review_id'': ''', review_id, ''', ''sentiment'': ', cast(sentiment AS string), '}}')
         WHEN 2 THEN concat('{{"review_id": "', review_id, '", "sentiment": ', cast(sentiment AS string))
         ELSE concat(' {{''review_id'': ''', review_id, ''', ''category'': ''', category, ''', ''sentiment'': ', cast(sentiment AS string), '}}') END AS stored
FROM {review_events}"""),
]

VIEW_NAMES = [n for n, _ in VIEWS]

# Products that a broadcast holds (some 40 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 8_000_000

# Views written once per session as Parquet below the checkpoint folder, as a shuffle is behind them. They lie as the
# shuffle leaves them: range-sorting them on their date sent and spilled all rows again. The others are projections of
# the base tables or of these two, and are read as such.
STORED = ("reviews_base", "review_analysis")


def duckdb_with(sql_body: str, views: list[str] | None = None) -> str:
    """Prefix an oracle query with the fixture views as CTEs."""
    wanted = VIEWS if views is None else [(n, t) for n, t in VIEWS if n in views]
    names = {n: n for n in BASE_TABLES}
    names.update({n: n for n in VIEW_NAMES})
    ctes = ",\n".join(f"{n} AS ({t.format(**names).strip()})" for n, t in wanted)
    body = sql_body.strip()
    kw = "WITH"
    if body.split(None, 1)[0].upper() == "RECURSIVE":      # the body holds a recursive CTE
        kw, body = "WITH RECURSIVE", body.split(None, 1)[1].strip()
    sep = "\n" if body[:6].upper() == "SELECT" else ",\n"
    return f"{kw} {ctes}{sep}{body}"


@dataclass
class Fixture:
    spark: SparkSession
    sf_dir: str
    frames: dict = field(default_factory=dict)
    materialize: bool = True
    root: str | None = None
    lock: threading.RLock = field(default_factory=threading.RLock)

    def table(self, name: str) -> DataFrame:
        with self.lock:               # callers may run queries from several threads
            return self._table(name)

    def _table(self, name: str) -> DataFrame:
        if name not in self.frames:
            if name in BASE_TABLES or name in ("region", "nation", "customer", "supplier", "orders"):
                self.frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = dict(VIEWS)[name]
                if name == "reviews_base":
                    df = self._reviews_base()
                elif name == "review_analysis":
                    df = self._review_analysis()
                else:
                    deps = {n: self.table(n) for n in BASE_TABLES + tuple(VIEW_NAMES)
                            if "{" + n + "}" in text}
                    df = self.spark.sql(text, **deps)
                if self.materialize and name in STORED:
                    df = self._store(name, df)
                self.frames[name] = df
        return self.frames[name]

    def _reviews_base(self) -> DataFrame:
        """The ``reviews_base`` view: of the lineitem rows of a review id the one with the largest ``ord``. The rows are cut
        to one an id before the texts are made, so the shuffle and its sort hold the bare columns, in as many pieces as
        keep the sort in memory. Rows without an id share one key and are reduced within their tasks."""
        raw = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                            "l_discount", "l_returnflag", "l_shipdate", F.expr(REVIEW_ID).alias("_id"))
        last = Window.partitionBy("_id").orderBy(F.col("_ord").desc())
        n = io.pieces(self.spark, raw.count())
        deal = raw.where("_id IS NOT NULL")
        deal = deal.repartition("_id") if n is None else io.dealt(deal, n, "_id")
        kept = (deal.withColumn("_ord", F.expr(ORD))
                .withColumn("_rn", F.row_number().over(last)).where("_rn = 1"))
        without = raw.where("_id IS NULL").withColumn("_ord", F.expr(ORD)).orderBy(F.col("_ord").desc()).limit(1)
        one = kept.drop("_rn", "_ord", "_id").unionByName(without.drop("_ord", "_id"))
        return self.spark.sql(dict(VIEWS)["reviews_raw"], lineitem=one).drop("ord")

    def _review_analysis(self) -> DataFrame:
        """The ``review_analysis`` view in one pass: both rows of a review come from one join with its product, which is
        broadcast up to ``BROADCAST_ROWS`` products, so that reviews are neither dealt nor sorted by product."""
        part = self.table("part")
        if part.count() <= BROADCAST_ROWS:
            part = F.broadcast(part.select("p_partkey", "p_brand"))
        base = self.spark.sql(dict(VIEWS)["analysis_base"], reviews_base=self.table("reviews_base"), part=part)
        both = [F.struct(*(F.expr(e).alias(n) for n, e in zip(("sentence", "category", "sentiment"), row))) for row in (S1, S2)]
        rows = F.when(F.expr(S2_IF), F.array(*both)).otherwise(F.array(both[0]))
        return (base.select("review_id", "product_id", "rating", "review_date", F.inline(rows))
                .select("review_id", "product_id", "sentence", "category", "sentiment", "rating", "review_date"))

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        from ..session import scratch_path
        if self.root is None:
            self.root = scratch_path(self.spark, "fixtures-" + self.sf_dir.rsplit("/", 1)[-1])
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name in ("spark", "sf_dir", "frames", "materialize", "root", "lock"):
            raise AttributeError(name)
        return self.table(name)


_CACHE: dict = {}
_CACHE_LOCK = threading.Lock()


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    from ..session import ship_package
    ship_package(spark)          # executors' Python workers need the package too
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _CACHE_LOCK:
        if key not in _CACHE:
            _CACHE[key] = Fixture(spark, sf_dir.rstrip("/"))
        return _CACHE[key]
