"""WARC archives: writing captures with revisit records, reading records, and joining
request, response and metadata records into one nested row for each capture."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

_CRLF = "\r\n"
# Fixed values of the format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A file is rotated after about this many bytes, judged by the mean payload.
FILE_BYTES = 16 << 20


def base32_sha1(body: Column) -> Column:
    """Upper-case base32 SHA-1 of a text's UTF-8 bytes (160 bits are 32 letters)."""
    digits = F.sha1(body)
    letters = []
    for i in range(8):
        v = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _uuid(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("\u0001", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\u0002")) for c in of]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)) for name, value in fields]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_CRLF * 2))
    return F.concat(F.lit("WARC/1.1" + _CRLF), *lines, size, block)


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", least: int = 0, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """One request, one response or revisit, and one metadata record for every row.

    Of the rows with equal payloads of at least ``least`` bytes, those with the smallest
    key are responses and the others revisit them; shorter payloads are all responses. A
    null body is empty, a null url is written empty, line ends in a url are escaped. A
    null key is never the smallest; where all keys of a payload are null, all are responses."""
    own = pages.select(
        F.col(key).cast("long").alias("page"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body"),
    ).withColumns({"digest": base32_sha1(F.col("body")), "n": F.octet_length("body").cast("long")})
    # By payload: the smallest page and, of its rows, one url.
    light = settle(own.select("digest", "n", "page", "url"))
    first = settle(
        light.where(F.col("n") >= least).where("page is not null").groupBy("digest").agg(F.min(F.struct("page", "url")).alias("head"), F.count(F.lit(1)).alias("m"))
        .where("m > 1").select(F.col("digest").alias("d1"), F.col("head.page").alias("p1"), F.col("head.url").alias("u1"))
    )
    mean = light.agg(F.avg("n")).first()[0] or 0.0
    rows = own.join(first, F.col("digest") == F.col("d1"), "left").withColumn("again", F.col("p1").isNotNull() & ~F.col("p1").eqNullSafe(F.col("page")))
    at = F.lit(date)
    ident = lambda kind: _uuid(kind, F.col("page"), F.col("url"), F.col("digest"))
    capture = ident("capture")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(_CRLF * 2)
    )
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", at)]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http = ("Content-Type", F.lit("application/http;msgtype=response"))
    request = _record(
        [("WARC-Type", F.lit("request")), *common, ("WARC-Record-ID", ident("request")), ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1" + _CRLF * 2)),
    )
    response = _record([("WARC-Type", F.lit("response")), *common, ("WARC-Record-ID", capture), digest, http], F.concat(head, F.col("body")))
    revisit = _record(
        [("WARC-Type", F.lit("revisit")), *common, ("WARC-Record-ID", capture), ("WARC-Profile", F.lit(_PROFILE)),
         ("WARC-Refers-To", _uuid("capture", F.col("p1"), F.col("u1"), F.col("digest"))), digest, http],
        head,
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), *common, ("WARC-Record-ID", ident("metadata")), ("WARC-Concurrent-To", capture), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page").cast("string"), F.lit("")), F.lit(_CRLF)),
    )
    records = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("value"))
    per_file = max(3, int(3 * FILE_BYTES / (mean + 1000)))
    # A record ends with two line ends.
    records.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", per_file).option("compression", "gzip").text(path)


_RECORD = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, "
    "fields map<string,string>, payload_bytes long, payload_digest string, payload binary, file string, at long"
)


def _headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if sep:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def records_of(data: bytes):
    """(offset, headers, block) of every record; headers None where bytes are no record:
    reading goes on at the next line that begins one."""
    at = 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        head = _headers(data[at:end]) if end >= 0 and data.startswith(b"WARC/", at) else {}
        size = head.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            yield at, None, b""
            at = data.find(b"\r\nWARC/", at + 1)
            if at < 0:
                return
            continue
        yield at, head, memoryview(data)[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)


def _parse(keep: bool):
    bare = lambda x: x.strip("<>") if x else None

    def run(batches):
        for b in batches:
            for path, body in zip(b.column("path").to_pylist(), b.column("content")):
                data = body.as_buffer().to_pybytes()
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                rows = []
                for at, head, block in records_of(data):
                    if head is None:
                        rows.append({"record_type": "unreadable", "fields": {}, "file": path, "at": at})
                        continue
                    kind, payload, fields = head.get("warc-type"), bytes(block), {}
                    if "application/http" in head.get("content-type", ""):
                        top, _, payload = payload.partition(b"\r\n\r\n")
                        fields = _headers(top)
                    elif "warc-fields" in head.get("content-type", ""):
                        fields = _headers(payload)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append({
                        "record_type": kind, "record_id": bare(head.get("warc-record-id")), "concurrent_to": bare(head.get("warc-concurrent-to")),
                        "refers_to": bare(head.get("warc-refers-to")), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
                        "fields": fields, "payload_bytes": len(payload), "payload_digest": digest, "payload": payload if keep else None, "file": path, "at": at,
                    })
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist([{**x, "fields": list(x["fields"].items())} for x in rows], schema=_ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([{**x, "fields": list(x["fields"].items())} for x in rows], schema=_ARROW)

    return run


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date")]
    + [("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("at", pa.int64())]
)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for every record of the archives below ``path`` (plain or gzip). A run of
    bytes that are no record gives one row of type ``unreadable`` with its place; a file is
    held by one task, so archives are best rotated at some 10 MB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(_parse(payload), _RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row for every response or revisit: ``capture`` (its record), ``requests`` and
    ``metadata`` (arrays of the records concurrent to it), and ``origin``: for a revisit
    the capture it refers to, null where that is not in the archives. Other records that
    no capture names are left out; records that repeat count once beside a capture."""
    plain = [c for c in records.columns]
    item = F.struct(*plain)
    heads = records.where(F.col("record_type").isin("response", "revisit")).select(F.col("record_id").alias("id"), item.alias("capture"))
    beside = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    # Copies of a record differ in their place only; a map can't be compared, so one of each id stays.
    once = beside.groupBy("concurrent_to", "record_type", "record_id").agg(F.min_by(item, F.struct("file", "at")).alias("x"))
    grouped = settle(
        once.groupBy("concurrent_to").agg(
            F.collect_list(F.when(F.col("record_type") == "request", F.col("x"))).alias("requests"),
            F.collect_list(F.when(F.col("record_type") == "metadata", F.col("x"))).alias("metadata"),
        )
    )
    none = F.array().cast(grouped.schema["requests"].dataType)
    full = heads.join(grouped, F.col("id") == F.col("concurrent_to"), "left").select(
        "id", "capture", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")
    )
    full = settle(full)
    target = full.where(F.col("capture.record_type") == "response").select(F.col("id").alias("to"), F.struct("capture", "metadata").alias("origin"))
    target = settle(target.groupBy("to").agg(F.min_by("origin", F.struct("origin.capture.file", "origin.capture.at")).alias("origin")))
    return full.join(target, F.col("capture.refers_to") == F.col("to"), "left").select("capture", "requests", "metadata", "origin")
