"""WARC archives: writing, reading back, and transaction assembly.

A page becomes three records: a request, a response (or a revisit of an equal payload), and metadata, the
first and last concurrent to the second. Spark's text sink writes them, a record per row with the blank lines
that end a record as separator; gzip keeps a file in one split. Reading splits files at the version line, so
records stream past without a whole file in memory; a payload that holds the version line itself is put
together again by its Content-Length. Assembly joins the three records on their concurrent-to identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import materialize, scratch_dir

VERSION = "WARC/1.1"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The tables hold no capture time; WARC asks for one.
DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: five hex digits are four letters."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(hexed, 1 + 5 * group, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(ALPHABET), at, F.lit(1)))
    return F.concat(*letters)


def _record_id(kind: str, page: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page.cast("string"), F.lit("")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str | None]], block: Column) -> Column:
    """A record without the blank lines that end it; a header that is null is left out."""
    lines = [F.lit(VERSION + _EOL)]
    for name, value in [*headers, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit("")))
    return F.concat(*lines, F.lit(_EOL), block)


def transactions(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of ``pages`` (page_id, url, html) as rows of one column ``value``.

    Of equal payloads of at least ``min_bytes``, the smallest page_id's is the response.
    """
    digest = F.sha1(F.coalesce("html", F.lit("")))
    page = F.col("page_id").cast("long")
    rows = pages.select(
        page.alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
        F.unhex(digest).alias("digest"),
    )
    narrow = rows.filter(F.octet_length("html") >= min_bytes)
    repeated = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Only payloads found again; Spark sends this table to all tasks while it is small, else joins on the digest.
    repeated = materialize(repeated.filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("_digest"), "first"))
    same = (F.col("digest") == F.col("_digest")) & (F.octet_length("html") >= min_bytes)
    rows = rows.join(repeated, same, "left").withColumn("hex", F.lower(F.hex("digest")))
    revisit = F.col("page_id") > F.col("first")
    own, hexed = F.col("page_id"), F.col("hex")
    main = _record_id("capture", own, hexed)
    label = F.concat(F.lit("sha1:"), base32_of_hex(hexed))
    size = F.octet_length("html").cast("string")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), size, F.lit(_EOL * 2))
    shared = [("WARC-Date", DATE), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", main),
            *shared,
            ("WARC-Payload-Digest", label),
            ("WARC-Profile", F.when(revisit, IDENTICAL)),
            ("WARC-Refers-To", F.when(revisit, _record_id("capture", F.col("first"), hexed))),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
    )
    path = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", _record_id("request", own, hexed)),
            *shared,
            ("WARC-Concurrent-To", main),
            ("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(F.lit("GET "), F.when(path == "", "/").otherwise(path), F.lit(f" HTTP/1.1{_EOL}Host: "), host, F.lit(_EOL * 2)),
    )
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", _record_id("metadata", own, hexed)),
            *shared,
            ("WARC-Concurrent-To", main),
            ("Content-Type", "application/warc-fields"),
        ],
        F.coalesce(F.concat(F.lit("page_id: "), own.cast("string"), F.lit(_EOL)), F.lit("")),
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Rows of ``value`` as gzipped archives in a folder."""
    records.write.option("lineSep", _EOL * 2).option("compression", "gzip").text(path)


_RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "payload_digest string, payload_bytes long, http_head string, fields map<string,string>, block binary"
)
_NAMES = [part.split()[0] for part in _RECORD.split(", ")]


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _whole_records(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record from the pieces between version lines, in file order."""
    held, file, headers, need = b"", None, {}, 0
    for batch in batches:
        for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            piece = value.as_py()
            if name != file or headers is None:
                held, file, headers = piece, name, None
            else:
                held += mark + piece
            if headers is None:
                head, blank, rest = held.partition(b"\r\n\r\n")
                parsed = _headers(head)
                if not blank or "content-length" not in parsed:  # what stands before the first record
                    held = b""
                    continue
                headers, need, held = parsed, int(parsed["content-length"]), rest
            if len(held) >= need:
                yield headers, held[:need]
                headers = None


def _parse(mark: bytes, with_block: bool):
    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind = headers.get("warc-type")
        label = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        size, http, fields, payload = None, None, None, None
        if kind in ("response", "revisit", "request") and headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
            if kind == "response":
                size = len(payload)
                label = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            elif kind == "revisit":  # the payload is elsewhere; its size is in the kept HTTP head
                size = int(_headers(head).get("content-length", 0))
        elif headers.get("content-type") == "application/warc-fields":
            fields = list(_headers(block).items())
        return (
            kind, headers.get("warc-record-id"), headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), headers.get("warc-date"), label, size, http, fields,
            payload if with_block else None,
        )

    types = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for headers, block in _whole_records(batches, mark):
            rows.append(row(headers, block))
            held += len(block)
            if len(rows) >= 5000 or held > 16 * 2**20:
                yield _as_batch(rows, types)
                rows, held = [], 0
        if rows:
            yield _as_batch(rows, types)

    return parse


def _as_batch(rows: list[tuple], types: list) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def read_warc(spark: SparkSession, path: str, *, version: str = VERSION, with_block: bool = True) -> DataFrame:
    """A row per record. Digest and size of a response are computed from the archived payload."""
    mark = version + _EOL
    pieces = spark.read.option("lineSep", mark).text(path)
    pieces = pieces.select(F.input_file_name().alias("file"), F.col("value").cast("binary"))
    return pieces.mapInArrow(_parse(mark.encode(), with_block), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response or revisit): record_id, capture, request, metadata.

    Request and metadata are null where the archive has none; of several, one is kept.
    """
    fields = ["target_uri", "date", "http_head", "block"]
    captures = records.filter("record_type IN ('response', 'revisit')").select(
        "record_id", F.struct("record_type", "refers_to", "payload_digest", "payload_bytes", *fields).alias("capture")
    )
    requests = records.filter("record_type = 'request' AND concurrent_to IS NOT NULL")
    requests = requests.select(F.col("concurrent_to").alias("_r"), F.struct("record_id", *fields).alias("request"))
    metadata = records.filter("record_type = 'metadata' AND concurrent_to IS NOT NULL")
    metadata = metadata.select(F.col("concurrent_to").alias("_m"), F.struct("record_id", "fields").alias("metadata"))
    joined = captures.join(requests.dropDuplicates(["_r"]), F.col("record_id") == F.col("_r"), "left")
    joined = joined.join(metadata.dropDuplicates(["_m"]), F.col("record_id") == F.col("_m"), "left")
    return joined.select("record_id", "capture", "request", "metadata")


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes the archives of ``pages``, reads them back and returns one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id for revisits).
    A null html is an empty payload; a null page_id is always a response; repeated rows are captures of
    their own (of one page_id and payload, all are responses); extra columns are ignored; an empty table
    gives an empty result. Control characters of a url are written as spaces in percent form.
    """
    spark = pages.sparkSession
    folder = path or f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(transactions(pages, min_bytes), folder)
    captures = assemble(read_warc(spark, folder, with_block=False)).select(
        "record_id",
        F.col("metadata.fields")["page_id"].cast("long").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"),
        F.col("capture.refers_to").alias("refers"),
    )
    captures = materialize(captures)
    wanted = captures.filter("refers IS NOT NULL").select("refers").distinct()
    named = captures.select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to")).dropDuplicates(["_id"])
    named = materialize(named.join(wanted.select(F.col("refers").alias("_id")), "_id", "left_semi"))
    return captures.join(named, F.col("refers") == F.col("_id"), "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def _base32_sql(hexed: str) -> str:
    parts = []
    for group in range(8):
        value = f"('0x' || substr({hexed}, {1 + 5 * group}, 5))::INTEGER"
        parts += [f"substr('{ALPHABET}', (({value} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0)]
    return " || ".join(parts)


WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hexed FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, {_base32_sql("hexed")} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
