"""WARC archives: write captures as records, read archives back, and assemble the
records of one transaction (request, response or revisit, metadata) into a nested row.

Archives are written by Spark's text writer: a record ends with two line breaks, which
is the writer's separator, so files are committed as any table's are and nothing is
written beside Spark. Reading parses each file by Content-Length in a Python task."""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import shared_dir, write_table

#: Records of one archive file at most; keeps a file to tens of MB of ordinary pages.
FILE_RECORDS = 6000
#: Payload bytes from which a repeated payload is written as a revisit.
REVISIT_BYTES = 1000
#: Bytes of parsed records after which a batch is handed to Spark.
BATCH_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, "
    "date string, payload_digest string, content_type string, head string, payload binary"
)
PRIMARY = ("response", "revisit", "resource", "conversion")
EOL = "\r\n"


def record_id(kind: str, *columns: Column) -> Column:
    """A name-based urn:uuid of the columns (nulls count as such)."""
    h = F.md5(F.concat_ws("\x01", F.lit(kind), *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns)))
    return F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def header_safe(c: Column) -> Column:
    """Control characters and spaces as percent escapes, so no value ends its line."""
    for n in [*range(33), 127]:
        c = F.replace(c, F.lit(chr(n)), F.lit(f"%{n:02X}"))
    return c


def lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines "name: value", each with its line break; null values have none."""
    return F.concat_ws("", *(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)) for name, value in pairs))


def record(kind: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    head = lines(("WARC-Type", kind), *fields, ("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(F.lit(f"WARC/1.1{EOL}"), head, F.lit(EOL), block)


def with_roles(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    """id, url, html, bytes, digest, rid (the record's id) and first (the record that a
    revisit refers to, else null)."""
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), text.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("bytes"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    slim = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
    found = slim.agg(F.max(F.struct("id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "top")
    rows = rows.join(found, F.col("digest") == F.col("d"), "left")
    rid = record_id("response", F.col("id"), F.col("url"), F.col("digest"))
    top = record_id("response", F.col("top.id"), F.col("top.url"), F.col("digest"))
    return rows.select("id", "url", "html", "bytes", "digest", rid.alias("rid"), F.when(F.col("top").isNotNull() & (rid != top), top).alias("first"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> None:
    """Three records a page (request, response or revisit, metadata) into gzipped
    archives below ``path``.

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the one with the largest id
    (then url) is the response and the others are revisits of it; rows that repeat
    that id and url are responses too. A null html is an empty payload; null ids and
    urls are left out of the headers. Other columns are not read."""
    p = with_roles(pages, id_col, url, html)
    uri, when, sha = header_safe(F.col("url")), F.lit(date), F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("bytes").cast("string"), F.lit(EOL * 2))
    kind = F.when(F.col("first").isNull(), "response").otherwise("revisit")
    body = F.concat(http, F.when(F.col("first").isNull(), F.col("html")).otherwise(F.lit("")))
    request = record(
        F.lit("request"), F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{EOL * 2}")),
        ("WARC-Record-ID", record_id("request", F.col("rid"))), ("WARC-Date", when), ("WARC-Target-URI", uri),
        ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/http; msgtype=request")),
    )
    response = record(
        kind, body,
        ("WARC-Record-ID", F.col("rid")), ("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", sha),
        ("WARC-Refers-To", F.col("first")), ("WARC-Profile", F.when(F.col("first").isNotNull(), F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
    )
    metadata = record(
        F.lit("metadata"), lines(("page-id", F.col("id").cast("string")), ("payload-bytes", F.col("bytes").cast("string")), ("payload-sha1", F.col("digest"))),
        ("WARC-Record-ID", record_id("metadata", F.col("rid"))), ("WARC-Date", when), ("WARC-Target-URI", uri),
        ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/warc-fields")),
    )
    rows = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive, cut by Content-Length; stops at a truncated record."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line.startswith(b"WARC/"):
            return
        head: dict[str, list[str]] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(head.get("content-length", ["0"])[0])
        block = stream.read(size)
        if len(block) < size:
            return
        one = lambda name, h=head: h.get(name, [None])[0]
        http, payload = "", block
        if (one("content-type") or "").startswith("application/http"):
            top, cut, payload = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        yield {
            "record_id": one("warc-record-id"), "type": one("warc-type"), "concurrent_to": head.get("warc-concurrent-to", []),
            "refers_to": one("warc-refers-to"), "target_uri": one("warc-target-uri"), "date": one("warc-date"),
            "payload_digest": one("warc-payload-digest"), "content_type": one("content-type"), "head": http, "payload": payload,
        }


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives below ``path`` (gzipped or plain)."""
    text, names = pa.string(), [c.split()[0] for c in RECORD.split(", ")]
    kinds = {"concurrent_to": pa.list_(text), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, text)) for n in names])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                stream = io.BytesIO(raw) if raw[:2].to_pybytes() != b"\x1f\x8b" else gzip.GzipFile(fileobj=io.BytesIO(raw))
                rows, size = [], 0
                for r in parse_records(stream):
                    rows.append(r)
                    size += len(r["payload"]) + 500
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, nested ``response`` (response, revisit, resource
    or conversion), ``request``, ``metadata`` (null where missing), and how many there
    were of each (n_responses, n_requests, n_metadata).

    A request or metadata record belongs to the record that it names as concurrent, or
    that names it; a record without either is a capture of its own. Of several records
    of a kind with one capture the one with the smallest id (then date) is nested; the
    counts tell of the others. Nulls in any field stay; a null record id is a capture
    id of its own. An empty table gives an empty result. Extra columns are nested too."""
    primary = F.col("type").isin(*PRIMARY)
    named = records.where(primary).select(F.explode("concurrent_to").alias("named"), F.col("record_id").alias("owner"))
    named = named.groupBy("named").agg(F.min("owner").alias("owner"))
    rest = records.where(~F.coalesce(primary, F.lit(False))).join(named, F.col("record_id") == F.col("named"), "left")
    keyed = records.where(primary).withColumn("capture_id", F.col("record_id")).unionByName(
        rest.withColumn("capture_id", F.coalesce("owner", F.get("concurrent_to", F.lit(0)), "record_id")).drop("named", "owner")
    )
    fields = F.struct("record_id", "date", *(c for c in records.columns if c not in ("record_id", "date", "concurrent_to")), "concurrent_to")
    kinds = {"response": primary, "request": F.col("type") == "request", "metadata": ~F.coalesce(primary | (F.col("type") == "request"), F.lit(False))}
    picks = [F.min(F.when(on, fields)).alias(k) for k, on in kinds.items()]
    counts = [F.count_if(on).alias(n) for n, on in zip(("n_responses", "n_requests", "n_metadata"), kinds.values(), strict=True)]
    return keyed.groupBy("capture_id").agg(*picks, *counts)


def restore_payloads(captures: DataFrame) -> DataFrame:
    """Captures with a ``payload`` column: the response's own, or for a revisit that of
    the response referred to (null if it is not among the captures)."""
    stored = captures.where(F.col("response.type") != "revisit").select(F.col("capture_id").alias("to"), F.col("response.payload").alias("stored"))
    joined = captures.join(stored, F.col("response.refers_to") == F.col("to"), "left")
    return joined.withColumn("payload", F.when(F.col("response.type") == "revisit", F.col("stored")).otherwise(F.col("response.payload"))).drop("to", "stored")


def op9_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """Per page: bytes and digest of the payload, the record's type and what it refers to."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    records = read_archives(spark, path)
    # the payload is measured before the records are shuffled; only metadata keep theirs
    sizes = F.octet_length("payload").cast("long").alias("bytes")
    slim = records.select(
        "record_id", "type", "concurrent_to", "refers_to", "date", "payload_digest", sizes, F.sha1("payload").alias("sha"),
        F.when(F.col("type") == "metadata", F.decode("payload", "utf-8")).alias("fields"),
    )
    captures = assemble(slim)
    field = lambda name, c="metadata.fields": F.nullif(F.regexp_extract(c, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))
    whole = F.col("response.type") == "response"
    rows = captures.select(
        field("page-id").cast("long").alias("page_id"),
        F.when(whole, F.col("response.bytes")).otherwise(field("payload-bytes").cast("long")).alias("payload_bytes"),
        F.when(whole, F.col("response.sha")).otherwise(F.substring_index("response.payload_digest", ":", -1)).alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"), "capture_id", "n_responses",
    )
    rows = write_table(rows, "captures")  # read three times below
    ids = rows.where(whole_page := F.col("record_type") == "response").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"))
    revisits = rows.where(~whole_page).join(ids, "to", "left")
    out = rows.where(whole_page).withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)
    # rows of pages that were the same in all columns have one record id: one row each again
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_responses").cast("int"))))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(encode(coalesce(html, ''))) AS sha FROM pages),
m AS (SELECT sha, max(page_id) AS top FROM p WHERE n >= {REVISIT_BYTES} GROUP BY sha)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha AS payload_digest,
       CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN m USING (sha)
"""
