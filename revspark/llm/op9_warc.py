"""WARC writing, reading and transaction assembly.

Every capture is written as three records: the request, the response (or a revisit of an equal
payload) and a metadata record; request and metadata name the response in
``WARC-Concurrent-To``. Archives are written by Spark's text writer with the record terminator as
line separator (gzip), so the commit protocol covers lost tasks. Files hold ``RECORDS_PER_FILE`` records of payloads up to ``LARGE`` bytes; larger payloads go to files of their own
folder, as many to a file as fit ``FILE_BYTES`` at the largest (one capture at least), so no file outgrows that or one capture by far. They are
read back a file a row, decompressed as a stream, and cut by ``Content-Length`` alone: payloads may hold anything. The
three kinds are then joined through their concurrent-to identifiers into one nested row.

Cases: a null html is an empty payload, a null url an empty target; equal payloads of at least
``REVISIT_BYTES`` are one response (largest page_id; all rows that share it) and revisits; a null
page_id is smaller than any other; a page table without rows gives no rows. Repeated rows stay
apart: a record id holds the page_id and a number among the rows of that id.
"""
from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, table

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 1500
LARGE = 1 << 18
FILE_BYTES = 1 << 27
END = "\r\n\r\n"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
FIELDS = ("type string, record_id string, concurrent_to string, refers_to string, uri string, date string, "
          "payload_digest string, payload_bytes long, payload string, content string")


def plan_captures(pages: DataFrame, stage: Stage, least: int = REVISIT_BYTES) -> DataFrame:
    """pages -> page_id, no, url, payload, sha1, n_bytes, first (the response's page_id for
    revisits, else null); no tells rows apart that share a page_id.

    Digests and ids that occur several times are small written tables, so payloads are only shuffled
    where those are too large to broadcast, and for rows of repeated ids."""
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"sha1": F.sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload").cast("long")})
    same = stage.save(p.filter(F.col("n_bytes") >= least).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
                      .filter("n > 1").drop("n"), "equal")
    twice = stage.save(pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                       .select(F.col("page_id").alias("_id")), "repeated")
    first = F.when((F.col("last").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("first")
    p = p.join(same, "sha1", "left")
    on = F.col("page_id").eqNullSafe(F.col("_id"))
    # alike rows may swap numbers
    no = F.row_number().over(Window.partitionBy("page_id").orderBy("sha1", "url"))
    both = p.join(twice, on, "left_anti").withColumn("no", F.lit(1)).unionByName(p.join(twice, on, "left_semi").withColumn("no", no))
    return both.select("page_id", "no", "url", "payload", "sha1", "n_bytes", first)


def _urn(page_id, kind: str, no):
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), no.cast("string"),
                    F.lit(f":{kind}>"))


def _record(kind, headers: list, block):
    lines = [F.concat(F.lit(name + ": "), value, F.lit("\r\n")) for name, value in headers]
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\n"), *[F.coalesce(x, F.lit("")) for x in lines],
                    F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def write_warc(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """captures (see ``plan_captures``) -> archives below ``path``, three records per capture."""
    pid, url = F.col("page_id"), F.regexp_replace("url", "[\r\n]+", " ")
    main = _urn(pid, "response", F.col("no"))
    common = [("WARC-Target-URI", url), ("WARC-Date", F.lit(date))]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), ("X-Payload-Length", F.col("n_bytes").cast("string"))]
    revisit = F.col("first").isNotNull()
    http = F.lit(HTTP_OK)
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [("WARC-Record-ID", main), *common, ("Content-Type", F.lit("application/http;msgtype=response")), *digest,
         ("WARC-Refers-To", F.when(revisit, _urn(F.col("first"), "response", F.lit(1)))),
         ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        F.when(revisit, http).otherwise(F.concat(http, "payload")))
    request = _record(
        F.lit("request"), [("WARC-Record-ID", _urn(pid, "request", F.col("no"))), ("WARC-Concurrent-To", main), *common,
                           ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1" + END)))
    metadata = _record(
        F.lit("metadata"), [("WARC-Record-ID", _urn(pid, "metadata", F.col("no"))), ("WARC-Concurrent-To", main), *common,
                            ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(pid.cast("string"), F.lit("null")), F.lit("\r\n")))
    def write(some: DataFrame, folder: str, per_file: int) -> None:
        (some.select(F.explode(F.array(request, response, metadata)).alias("value"))
         .write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(folder))
    large = F.when(F.col("first").isNull(), F.col("n_bytes")).otherwise(0) > LARGE
    most = captures.filter(large).agg(F.max("n_bytes")).first()[0]
    write(captures.filter(~large) if most else captures, f"{path}/files", RECORDS_PER_FILE)
    if most:
        write(captures.filter(large), f"{path}/large", 3 * max(1, FILE_BYTES // most))


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    return out


def records(stream):
    """(header fields, content) of each record of an uncompressed stream, found by Content-Length; one is held at a time."""
    while line := stream.readline():
        head = [line]
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line)
        fields = _fields(b"".join(head))
        n = int(fields["content-length"])
        content = stream.read(n)
        if len(content) < n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} isn't closed after its Content-Length")
        yield fields, content


def _opened(file: pa.Buffer):
    raw = pa.BufferReader(file)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if file[:2].to_pybytes() == b"\x1f\x8b" else io.BytesIO(file)


def _parser(schema: pa.Schema, with_payload: bool):
    def run(batches):
        for batch in batches:
            for file in batch.column("content"):
                rows, held = [], 0
                for f, content in records(_opened(file.as_buffer())):
                    kind, payload = f["warc-type"], None
                    if kind == "response":
                        payload = content[content.index(b"\r\n\r\n") + 4:]
                        digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
                        if f.get("warc-payload-digest") != f"sha1:{digest}":
                            raise ValueError(f"payload of {f.get('warc-record-id')} doesn't match its digest")
                    else:
                        digest = f.get("warc-payload-digest", "")[5:] or None
                        n = int(f["x-payload-length"]) if "x-payload-length" in f else None
                    rows.append((kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"),
                                 f.get("warc-target-uri"), f.get("warc-date"), digest, n,
                                 payload.decode() if with_payload and payload is not None else None,
                                 content.decode() if kind in ("request", "metadata") else None))
                    held += len(payload) if with_payload and payload is not None else 0
                    if len(rows) >= 500 or held >= 1 << 25:
                        yield _batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, schema)
    return run


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Archives -> one row per record (``FIELDS``); payload of responses where asked for."""
    text = ["type", "record_id", "concurrent_to", "refers_to", "uri", "date", "payload_digest"]
    schema = pa.schema([*[(n, pa.string()) for n in text], ("payload_bytes", pa.int64()), ("payload", pa.string()),
                        ("content", pa.string())])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parser(schema, with_payload), FIELDS)


def assemble(recs: DataFrame) -> DataFrame:
    """Records -> one nested row per capture: the response or revisit with its request and
    metadata records; a capture without one of them has null there."""
    main = recs.filter("type in ('response', 'revisit')")
    side = lambda kind, *cols: recs.filter(F.col("type") == kind).select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", *cols).alias(kind))
    return (main.join(side("request", "date", "content"), "record_id", "left")
            .join(side("metadata", "date", "content"), "record_id", "left")
            .select("uri", "request", F.struct("record_id", "type", "date", "payload_digest", "payload_bytes", "payload",
                                               "refers_to").alias("response"), "metadata"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "op9")
    path = stage.path("warc")
    write_warc(plan_captures(table(spark, sf_dir, "pages"), stage), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:capture:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("long")
    r = assemble(stage.save(read_warc(spark, path, with_payload=False), "records"))
    return r.select(
        F.regexp_extract("metadata.content", r"page-id: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"), number("response.refers_to").alias("refers_to"))


SQL = {"op9_warc": f"""
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {REVISIT_BYTES} AND page_id < m THEN m END AS refers_to
FROM (SELECT page_id, n, d, max(page_id) OVER (PARTITION BY d) AS m
      FROM (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages))"""}
