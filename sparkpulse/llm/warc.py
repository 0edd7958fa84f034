"""WARC archives: writing captures as request, response (or revisit) and metadata records, reading them back, and
transaction assembly through concurrent-to identifiers.

Archives are written by Spark's text sink with CRLF CRLF between records, which is the WARC record separator, so writing
commits atomically on any Hadoop file system and survives lost executors; each archive holds a bounded number of
captures and is compressed as one gzip stream.  Reading trusts Content-Length alone, never the payload's own text.

Null payloads are empty and null URLs become ``urn:page:<id>``.  Of captures whose payloads (at least ``min_revisit`` bytes)
are equal, that with the largest id is the response and the others revisit it; rows that repeat the largest id are
responses too.  Every input row is one capture, repeated rows included.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in one archive at most.
CAPTURES = 1000


def _uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\x1f", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: str | Column, record_id: Column, uri: Column, content_type: str, block: Column, *more: Column) -> Column:
    """One record without its trailing separator; more: whole header lines, null for none."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(head, F.lit(SEP), block)


def plan(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000) -> DataFrame:
    """page_id, url, html, digest, capture (a unique key) and first: the page that it revisits, or null."""
    p = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(page_id).cast("long").alias("__n"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    groups = pages.select(F.col(page_id).cast("long").alias("n"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("b")).where(F.octet_length("b") >= min_revisit)
    groups = groups.select("n", F.sha1("b").alias("digest")).groupBy("digest").agg(F.max("n").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    # small pages, all empty ones too, revisit nothing and aren't joined
    small = F.octet_length("html") < min_revisit
    p = p.where(~small).join(groups, "digest", "left").unionByName(p.where(small).withColumn("first", F.lit(None).cast("long")))
    p = p.withColumn("capture", F.monotonically_increasing_id())
    return p.withColumn("first", F.when(F.col("__n") == F.col("first"), None).otherwise(F.col("first"))).drop("__n")


def write(pages: DataFrame, path: str, *, captures: int = CAPTURES, **columns) -> None:
    """Write one capture of three records per page below ``path``."""
    p = plan(pages, **columns)
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce("page_id", F.lit(""))))
    rid = _uuid(F.lit("response"), F.col("capture").cast("string"), F.coalesce("page_id", F.lit("")), F.col("digest"))
    old = F.col("first").isNotNull()
    host = F.regexp_extract(uri, "^[a-zA-Z]+://([^/?#]*)", 1)
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + SEP)
    p = p.select("page_id", "digest", "first", "html", "capture", uri.alias("uri"), rid.alias("rid"), old.alias("old"), host.alias("host"))
    rid, uri, old = F.col("rid"), F.col("uri"), F.col("old")
    request = _record("request", _uuid(F.lit("request"), rid), uri, "application/http; msgtype=request", F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\nHost: "), "host", F.lit(SEP)), F.concat(F.lit("WARC-Concurrent-To: "), rid))
    response = _record(
        F.when(old, "revisit").otherwise("response"), rid, uri, "application/http; msgtype=response", F.when(old, head).otherwise(F.concat(head, F.col("html"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"), F.when(old, F.lit(f"WARC-Profile: {PROFILE}")), F.when(old, F.concat(F.lit("WARC-Refers-To-Page: "), F.col("first").cast("string"))),
    )
    fields = F.concat(F.lit("page: "), F.coalesce("page_id", F.lit("")), F.lit("\r\npayload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    metadata = _record("metadata", _uuid(F.lit("metadata"), rid), uri, "application/warc-fields", fields, F.concat(F.lit("WARC-Concurrent-To: "), rid))
    out = p.select(F.concat_ws(SEP, request, response, metadata).alias("value"))
    out.write.option("lineSep", SEP).option("compression", "gzip").option("maxRecordsPerFile", captures).text(path)


def parse(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a WARC byte stream."""
    buf, at = bytearray(), 0

    def need(n: int) -> bool:
        nonlocal buf, at
        while len(buf) - at < n:
            if (chunk := next(stream, None)) is None:
                return False
            if at > 1 << 20:
                del buf[:at]
                at = 0
            buf += chunk
        return True

    while True:
        while need(1) and buf[at] in b"\r\n":
            at += 1
        if not need(1):
            return
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not need(len(buf) - at + 1):
                raise ValueError("a WARC record's header doesn't end")
        lines = buf[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        at = end + 4
        if not need(n):
            raise ValueError("a WARC record's block is cut short")
        yield headers, bytes(buf[at : at + n])
        at += n


def _inflate(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain or gzip file, of one member or many."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        d = zlib.decompressobj(31)
        left = content
        while left and not d.eof:
            yield d.decompress(left, size)
            left = d.unconsumed_tail
        yield d.flush()
        content = d.unused_data


RECORD = "record_id string, kind string, concurrent_to string, uri string, digest string, refers_to_page long, content_type string, length long, payload_bytes long, payload_digest string, fields string, payload binary"


def read(spark: SparkSession, path: str, *, payloads: bool = False) -> DataFrame:
    """One row per record of the archives below ``path``.  payload_*: of the HTTP entity as it stands in the archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse(_inflate(content.as_buffer().to_pybytes())):
                    body = block.partition(b"\r\n\r\n")[2] if h["content-type"].startswith("application/http") else block
                    page = h.get("warc-refers-to-page")
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), int(page) if page else None, h["content-type"], len(block), len(body), hashlib.sha1(body).hexdigest(), block.decode("utf-8") if h["warc-type"] == "metadata" else None, body if payloads else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, and the request and metadata that are concurrent to it.

    Requests and metadata without a response are left out; a response without them has nulls.  Of several, the smallest
    record id counts.
    """
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    names = [c for c in records.columns if c != "concurrent_to"]
    r = records.select(key.alias("capture_id"), "kind", F.struct(*names).alias("record")).where("capture_id is not null")
    pick = lambda *kinds: F.min_by("record", F.when(F.col("kind").isin(*kinds), F.col("record.record_id")))
    # min_by ignores rows whose ordering value is null
    return r.groupBy("capture_id").agg(pick("response", "revisit").alias("response"), pick("request").alias("request"), pick("metadata").alias("metadata")).where("response is not null")


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Per page, read from archives: page_id, payload size and digest (a revisit's from the response that it refers to)."""
    a = assemble(read(spark, path))
    page = F.regexp_extract("metadata.fields", r"(?m)^page: (-?\d*)", 1)
    a = a.select(F.when(page != "", page).cast("long").alias("page_id"), F.col("response.kind").alias("record_type"), F.col("response.refers_to_page").alias("refers_to"), F.col("response.digest").alias("said"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("sha1"), F.col("response.uri").alias("uri"), F.col("request").isNotNull().alias("has_request"))
    # The payload of each page that anything refers to, once; responses keep their own.
    own = a.where("record_type = 'response'").groupBy(F.col("page_id").alias("to_page"), F.concat(F.lit("sha1:"), "sha1").alias("to_said")).agg(F.first("n").alias("to_n"), F.first("sha1").alias("to_sha1"))
    old = a.where("record_type = 'revisit'").join(own, F.col("refers_to").eqNullSafe(F.col("to_page")) & (F.col("said") == F.col("to_said")), "left")
    pick = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "has_request")
    new = a.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", "uri", "has_request")
    return new.unionByName(old.select("page_id", F.col("to_n").alias("payload_bytes"), F.col("to_sha1").alias("payload_digest"), "record_type", "refers_to", "uri", "has_request")).select(*pick)
