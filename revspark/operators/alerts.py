"""Alert logic shared by the live stream and its batch twins: alert and display
types, alert records, the recent-negatives list, lenient JSON parsing and
delete-first-match. Pure column expressions / grouped aggregations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.columns import is_anomaly

ALERT_KEYS = ("review_id", "product_id", "category")


def alert_type(sentiment="sentiment", rating="rating") -> Column:
    """First hit: negative sentiment; a 1-3 rating; else no alert (NULL). A third
    branch of the original (neutral and 1-3) is implied by the second."""
    s, r = F.col(sentiment), F.col(rating)
    return (F.when(s == 0, F.lit(K.ALERT_NEGATIVE))
            .when(r.isin(1.0, 2.0, 3.0), F.lit(K.ALERT_LOW_RATING)))


def display_type(sentiment="sentiment", rating="rating") -> Column:
    s, r = F.col(sentiment), F.col(rating)
    return (F.when((s == 0) & r.isin(4.0, 5.0), F.lit(K.DISPLAY_NEGATIVE))
            .when(r.isin(1.0, 2.0), F.lit(K.DISPLAY_LOW_RATING))
            .otherwise(F.lit(K.DISPLAY_GENERAL)))


def with_alert_types(df: DataFrame) -> DataFrame:
    """Rows that raise an alert, with their alert and display types."""
    return (df.where(is_anomaly()).withColumn("type", alert_type())
            .where(F.col("type").isNotNull()).withColumn("display_type", display_type()))


def alert_records(alerts: DataFrame, products: DataFrame, with_json: bool = False) -> DataFrame:
    """Alert rows joined to the product dimension (left), defaults for anything
    missing, the alert headline, and optionally the JSON message."""
    d = K.ALERT_DEFAULTS
    p = products.select("product_id", "product_name", "brand", "price", "image_url")
    j = alerts.join(p, "product_id", "left")
    rec = j.select(
        "review_id", "product_id",
        F.coalesce("product_name", F.lit(d["product_name"])).alias("product_name"),
        F.coalesce("brand", F.lit(d["brand"])).alias("brand"),
        F.coalesce("price", F.lit(d["price"])).alias("price"),
        F.coalesce("image_url", F.lit(d["image_url"])).alias("image_url"),
        F.coalesce("category", F.lit(d["category"])).alias("category"),
        F.coalesce("sentence", F.lit(d["sentence"])).alias("sentence"),
        "rating", "sentiment", "type",
        F.coalesce(F.date_format("review_date", "yyyy-MM-dd"), F.lit(d["review_date"])).alias("review_date"),
        F.concat(F.lit(K.ALERT_PREFIX), F.col("type")).alias("alert"))
    if with_json:
        body = F.struct(*[c for c in rec.columns if c != "alert"])
        rec = rec.withColumn("message", F.to_json(F.struct(F.col("alert"), body.alias("review"))))
    return rec


def recent_negatives(rows: DataFrame, order: str, cap: int = K.RECENT_LIST_CAP) -> DataFrame:
    """The bounded recent list: first arrival per (review_id, category) is listed,
    newest first, at most ``cap`` entries (``pos`` 1 = newest). First arrival is a
    ``min_by`` aggregate (partial aggregation); the global top-k is a
    TakeOrderedAndProject: each task keeps ``cap`` rows, one task merges them."""
    others = [c for c in rows.columns if c not in ("review_id", "category")]
    first = (rows.groupBy("review_id", "category").agg(F.min_by(F.struct(*others), F.col(order)).alias("_v"))
             .select("review_id", "category", "_v.*"))
    top = first.orderBy(F.col(order).desc()).limit(cap)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col(order).desc())))


def delete_first_match(listing: DataFrame, requests: DataFrame, pos: str = "pos") -> DataFrame:
    """For each requested review_id remove only its first entry in list order."""
    w = Window.partitionBy("review_id").orderBy(F.col(pos))
    ranked = listing.withColumn("_k", F.row_number().over(w))
    hit = requests.select("review_id").distinct().withColumn("_del", F.lit(True))
    out = ranked.join(hit, "review_id", "left")
    return out.where(~(F.coalesce(F.col("_del"), F.lit(False)) & (F.col("_k") == 1))).drop("_k", "_del")


def delete_misses(listing: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested review_ids that the list doesn't hold: the not-found answers of a deletion."""
    return requests.select("review_id").distinct().join(listing.select("review_id"), "review_id", "left_anti")


def parse_json_lenient(df: DataFrame, text: str, schema: StructType) -> DataFrame:
    """Parse stored JSON; text not starting with '{' gets its single quotes turned
    into double quotes first; what still does not parse (strict JSON: no single
    quotes) is skipped. Malformed rows are detected by the corrupt-record column."""
    t = F.col(text)
    fixed = F.when(t.startswith("{"), t).otherwise(F.translate(t, "'", '"'))
    with_bad = StructType(schema.fields + [StructField("_corrupt", StringType())])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"}
    parsed = F.from_json(fixed, with_bad, opts)
    ok = df.select("*", parsed.alias("_p")).where(F.col("_p._corrupt").isNull() & F.col("_p").isNotNull())
    return ok.select(*df.columns, *[F.col(f"_p.{f.name}").alias(f.name) for f in schema.fields])
