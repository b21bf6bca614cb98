"""WARC archives: written from pages as plain text parts, read back, and joined to one row per capture.

Writing. Each page becomes a capture of three records: ``response`` (or
``revisit`` of an earlier page with the same payload), ``request`` and
``metadata``, the latter two pointing at the first by ``WARC-Concurrent-To``.
A record is a line of Spark's text sink whose line separator is the CRLF CRLF
that ends a WARC record, so the parts are valid archives on any file system
that Spark writes to, and no task holds more than a row.

Reading. Archives are read as whole files of bounded size and cut into records
by ``Content-Length``, so a payload may hold anything, record ends included.

Assembly. Records meet by the identifier they are concurrent to; a record that
points at a request or metadata record is led on to what that one points at
if ``chained`` says that such records exist. One nested row comes out per
capture, also when its records lie in different archives.

Null html is an empty payload. Payloads of fewer than ``MIN_BYTES`` are never
revisits. Of equal payloads the smallest page id is the response; a null page
id counts as the smallest. Rows that repeat a page id with the same payload are
captures of their own, numbered by url; the first number is the response.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabloom.runtime import scratch_path

MIN_BYTES = 100
RECORD_END = "\r\n\r\n"
# Records in one archive file at most; the reader holds one file per task.
FILE_RECORDS = 3_000
DATE = "2024-01-01T00:00:00Z"


def _record(kind: Column | str, headers: list[Column], block: Column) -> Column:
    """One record without its end: version, headers, an empty line and the block."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit(f"\r\nWARC-Date: {DATE}\r\n"), *headers,
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def _header(name: str, value: Column) -> Column:
    """A header line; empty if the value is null. Line ends in a value would end the header, so they go."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.translate(value, "\r\n", "  "), F.lit("\r\n")), F.lit(""))


def _urn(kind: str, page: Column, digest: Column, turn: Column) -> Column:
    """A record id made from the page, its payload and its number, so that a repeated task writes the same one."""
    parts = [F.coalesce(page.cast("string"), F.lit("null")), F.substring(digest, 1, 16), turn.cast("string")]
    return F.concat(F.lit("<urn:capture:"), F.concat_ws(":", *parts), F.lit(f":{kind}>"))


def _own(kind: str) -> Column:
    return _urn(kind, F.col("__page"), F.col("__digest"), F.col("__turn"))


def captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages with digest, size, a number among equal pages, and ``__first``: the page they revisit, or null.

    Equal payloads are found on ids and digests alone; the pages themselves are shuffled once.
    """
    base = pages.select(
        F.coalesce(F.col(f"`{page_id}`").cast("string"), F.lit("null")).alias("__key"),
        F.col(f"`{page_id}`").alias("__page"), F.col(f"`{url}`").cast("string").alias("__url"),
        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("__html"),
    ).withColumn("__bytes", F.octet_length("__html").cast("long")).withColumn("__digest", F.sha2("__html", 256))
    ids = base.where(F.col("__bytes") >= MIN_BYTES).select("__key", "__page", "__digest")
    # Partial minima per task first: a payload with any number of copies is one row per task here.
    order = F.struct(F.col("__page").isNotNull().alias("known"), F.col("__page").alias("page"))
    first = ids.groupBy("__digest").agg(F.min(order).alias("__min"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    # Smallest first; distinct because equal pages are told apart by their number below.
    revisits = ids.join(first, "__digest").select("__key", "__digest", F.col("__min.page").alias("__first"), F.lit(True).alias("__copy"))
    joined = base.join(revisits.distinct(), ["__key", "__digest"], "left")
    turn = F.row_number().over(Window.partitionBy("__key", "__digest").orderBy("__url"))
    same = F.col("__page").eqNullSafe(F.col("__first")) & (F.col("__turn") == 1)
    return joined.withColumn("__turn", turn).withColumn("__copy", F.coalesce(F.col("__copy"), F.lit(False)) & ~same)


HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_lines(rows: DataFrame) -> DataFrame:
    """The three records of each capture as text, without the CRLF CRLF that ends them."""
    copy, digest = F.col("__copy"), F.concat(F.lit("sha256:"), F.col("__digest"))
    uri, to = _header("WARC-Target-URI", F.col("__url")), _header("WARC-Concurrent-To", _own("response"))
    refers = F.when(copy, _urn("response", F.col("__first"), F.col("__digest"), F.lit(1)))
    response = _record(
        F.when(copy, "revisit").otherwise("response"),
        [
            _header("WARC-Record-ID", _own("response")), uri, _header("WARC-Payload-Digest", digest),
            _header("WARC-Refers-To", refers), _header("WARC-Profile", F.when(copy, F.lit(PROFILE))),
            F.lit("Content-Type: application/http; msgtype=response\r\n"),
        ],
        F.concat(F.lit(HTTP), F.when(copy, "").otherwise(F.col("__html"))),
    )
    target = F.translate(F.coalesce(F.col("__url"), F.lit("/")), "\r\n ", "")
    request = _record(
        "request",
        [_header("WARC-Record-ID", _own("request")), uri, to, F.lit("Content-Type: application/http; msgtype=request\r\n")],
        F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        "metadata",
        [_header("WARC-Record-ID", _own("metadata")), uri, to, F.lit("Content-Type: application/warc-fields\r\n")],
        F.concat(
            _header("page-id", F.col("__page").cast("string")), _header("payload-bytes", F.col("__bytes").cast("string")),
            _header("payload-digest", digest), _header("refers-to-page-id", F.when(copy, F.col("__first").cast("string"))),
        ),
    )
    return rows.select(F.explode(F.array(response, request, metadata)).alias("value"))


def write_archives(lines: DataFrame, path: str) -> None:
    """Lines of ``record_lines`` as gzipped archives of bounded size."""
    writer = lines.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS)
    writer.option("compression", "gzip").text(path)


HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.M)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of an archive; raises on a cut-off record."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        edge = data.index(b"\r\n\r\n", at)
        headers = {k.decode().lower(): v.decode(errors="replace") for k, v in HEADER.findall(data[at:edge])}
        start = edge + 4
        end = start + int(headers["content-length"])
        if end > len(data):
            raise ValueError("the last record is cut off")
        yield headers, data[start:end]
        at = end
        while data[at : at + 2] == b"\r\n":
            at += 2


RECORDS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "kind", "concurrent_to", "refers_to", "uri", "payload_digest")]
    + [T.StructField("payload_bytes", T.LongType()), T.StructField("fields", T.MapType(T.StringType(), T.StringType()))]
    + [T.StructField("payload", T.BinaryType())]
)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind, fields = headers.get("warc-type"), None
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if kind == "metadata":
        fields = [(k.decode().lower(), v.decode(errors="replace")) for k, v in HEADER.findall(block)]
    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else None
    stated = headers.get("warc-payload-digest", "")
    if kind == "response" and stated.startswith("sha256:") and stated[7:] != digest:
        raise ValueError(f"the payload of {headers.get('warc-record-id')} has another digest than stated")
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
        headers.get("warc-target-uri"), digest or stated.removeprefix("sha256:") or None,
        len(payload) if kind == "response" else None, fields, payload if with_payload else None,
    )


ARROW = pa.schema(
    [pa.field(n, pa.string()) for n in RECORDS.names[:6]]
    + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder. A broken record fails the read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_records(content.as_py()):
                    rows.append(_row(headers, block, with_payload))
                    held += len(block) if with_payload else 100
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ARROW)], schema=ARROW)

    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame, chained: bool = False) -> DataFrame:
    """One row per capture: ``capture_id`` and the nested ``response``, ``requests`` and ``metadata``.

    A record without ``concurrent_to`` opens a capture. With ``chained``, one
    that points at a request or metadata record takes that record's capture.
    Records whose capture has no response give a row with a null response.
    """
    parts = F.struct(*[c for c in RECORDS.names if c != "concurrent_to"]).alias("part")
    main = F.col("kind").isin("response", "revisit")
    to = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    rows = records.select("kind", "record_id", to.alias("capture_id"), parts)
    if chained:
        led = rows.where(~main).select(F.col("record_id").alias("capture_id"), F.col("capture_id").alias("__led")).distinct()
        rows = rows.join(led, "capture_id", "left").withColumn("capture_id", F.coalesce("__led", "capture_id"))
    return rows.groupBy("capture_id").agg(
        F.max_by("part", F.when(main, F.col("record_id"))).alias("response"),
        F.collect_list(F.when(F.col("kind") == "request", F.col("part"))).alias("requests"),
        F.collect_list(F.when(F.col("kind") == "metadata", F.col("part"))).alias("metadata"),
    )


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", with_payload: bool = False) -> DataFrame:
    """Pages written as archives to the shared folder, read back and assembled."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(record_lines(captures(pages, page_id, url, html)), path)
    return assemble(read_archives(spark, path, with_payload))
