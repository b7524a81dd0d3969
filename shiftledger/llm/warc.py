"""Web archives: captures are written as WARC records, read back and assembled by concurrent-to identifiers.

Each capture is three records: a request and a metadata record name the response (or revisit) in
``WARC-Concurrent-To``. Of captures with equal payloads of at least ``min_bytes``, the one with the smallest page
id is the response; the others are revisits that hold HTTP headers only. The archive files are gzip files of at
most ``RECORDS_PER_FILE`` records, read by content length, so that a payload may hold anything. Captures are written
by classes of payload size, with fewer records to a file the larger a class's payloads are, so that a file holds at
most about ``FILE_BYTES``, or one capture: files are read whole by one task.

Defined cases: a null payload is empty, a null URL leaves its header out, a null page id counts as the greatest.
Rows that repeat the smallest page id and payload are all responses. A record cut off at the end of a file is left
out; a capture without a response keeps its other records. An empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger.llm.common import filled, saved
from shiftledger.session import work_dir

END = "\r\n"
RECORDS_PER_FILE = 60_000
FILE_BYTES = 256 << 20
SMALL_BYTES = 64 << 10  # payloads of class 0
CLASS_BITS = 4  # each class's payloads are up to 16 times those of the one before
HEAD_BYTES = 4_000  # allowed for the headers and the smaller records of a capture
BATCH_BYTES = 8_000_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

RECORDS = (
    "record_type string, record_id string, concurrent_to string, uri string, date string, digest string,"
    " payload_bytes long, payload binary, fields map<string,string>"
)


def sha1_base32(data: Column) -> Column:
    """SHA-1 in upper-case base32: five hexadecimal digits are four of base 32."""
    value = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(value, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_HEX, BASE32)


def planned(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0
) -> DataFrame:
    """A row (id, url, payload, bytes, digest, refers_to, revisit) per page."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), filled(html).alias("payload")
    )
    rows = rows.withColumns(
        {"bytes": F.octet_length("payload").cast("long"), "digest": sha1_base32(F.col("payload").cast("binary"))}
    )
    shared = (
        rows.filter(F.col("bytes") >= min_bytes)
        .groupBy(F.col("digest").alias("digest2"), F.col("bytes").alias("bytes2"))
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    same = (F.col("digest") == F.col("digest2")) & (F.col("bytes") == F.col("bytes2"))
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))
    rows = rows.join(saved(shared, "warc-shared"), same, "left").withColumn("revisit", revisit)
    return rows.select(
        "id", "url", "payload", "bytes", "digest", "revisit", F.when(F.col("revisit"), F.col("first")).alias("refers_to")
    )


def record(kind: Column, record_id: Column, more: list[Column], content: str | Column, block: Column) -> Column:
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        *more,
        F.concat(F.lit("Content-Type: "), content if isinstance(content, Column) else F.lit(content)),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(END, *head), F.lit(END * 2), block)  # concat_ws leaves out what is null


def size_class(n_bytes: Column) -> Column:
    """The class of a payload's size, one for each ``CLASS_BITS`` bits beyond ``SMALL_BYTES``; at most nine."""
    over = F.shiftright(F.greatest(n_bytes, F.lit(1)) - 1, SMALL_BYTES.bit_length() - 1)
    bits = F.when(over > 0, F.length(F.bin(over))).otherwise(0)
    return F.ceil(bits / CLASS_BITS).cast("int")


def records_per_file(size: int) -> int:
    """How many records a file of a size class may hold, whole captures of three records."""
    largest = (SMALL_BYTES << (CLASS_BITS * size)) + HEAD_BYTES
    return min(RECORDS_PER_FILE, 3 * max(1, FILE_BYTES // largest))


def write_archive(planned_rows: DataFrame, path: str) -> None:
    """One job per size class that there is; the three records of a row are made from that row alone."""
    size = size_class(F.col("bytes"))
    found = {r[0] for r in planned_rows.select(size.alias("size")).distinct().collect()}
    for k in sorted(found | {0}):
        write_class(planned_rows.filter(size == k), f"{path}/size={k}", k)


def write_class(planned_rows: DataFrame, path: str, size: int) -> None:
    rows = planned_rows.withColumn("row", F.monotonically_increasing_id())

    def name(kind: str) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(kind), F.lit(size), F.col("row"), F.coalesce(F.col("id").cast("string"), F.lit("")), "digest"))
        cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))

    response = name("response")
    concurrent = [F.concat(F.lit("WARC-Concurrent-To: "), response)]
    target = F.regexp_extract(filled("url"), r"^[^:]*://([^/?#]*)", 1)
    path_of = F.regexp_extract(filled("url"), r"^[^:]*://[^/?#]*([^#]*)", 1)
    clean = lambda x: F.regexp_replace(x, r"[\x00-\x20]", "%20")
    request = F.concat(F.lit("GET "), clean(path_of), F.lit(f" HTTP/1.1{END}Host: "), clean(target), F.lit(END * 2))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END * 2),
    )
    about = F.concat_ws(
        END,
        F.concat(F.lit("page-id: "), F.col("id").cast("string")),
        F.concat(F.lit("refers-to-page: "), F.col("refers_to").cast("string")),
        F.lit(""),
    )
    revisit = F.col("revisit")
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    profile = F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}"))
    records = F.array(
        record(F.lit("request"), name("request"), concurrent, "application/http;msgtype=request", request),
        record(
            F.when(revisit, "revisit").otherwise("response"),
            response,
            [digest, profile],
            "application/http;msgtype=response",
            F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
        ),
        record(F.lit("metadata"), name("metadata"), concurrent, "application/warc-fields", about),
    )
    (
        rows.select(F.explode(records).alias("value"))
        .write.option("lineSep", END * 2)
        .option("maxRecordsPerFile", records_per_file(size))
        .option("compression", "gzip")
        .text(path)
    )


def fields_of(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {key.strip().lower(): value.strip() for key, colon, value in pairs if colon}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of an archive file, plain or gzip with any number of members."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:60]!r}")
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        fields = fields_of(head)
        block = stream.read(size := int(fields.get("content-length", 0)))
        if len(block) < size:
            return
        yield fields, block


def read_file(data: bytes) -> Iterator[dict]:
    for fields, block in parse(data):
        row = {
            "record_type": fields.get("warc-type"),
            "record_id": fields.get("warc-record-id"),
            "concurrent_to": fields.get("warc-concurrent-to"),
            "uri": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"),
            "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "payload_bytes": None,
            "payload": None,
            "fields": {},
        }
        if row["record_type"] in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = fields_of(http.split(b"\r\n")[1:]).get("content-length")
            row["payload_bytes"] = int(length) if length else len(payload)
            row["payload"] = payload if row["record_type"] == "response" else None
        elif row["record_type"] == "request":
            row["fields"] = {"request": block.split(b"\r\n")[0].decode("utf-8", "replace")}
        elif row["record_type"] == "metadata":
            row["fields"] = fields_of(block.split(b"\r\n"))
        yield row


def read_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows, held = [], 0
    for frame in frames:
        for data in frame["content"]:
            for row in read_file(data):
                rows.append(row)
                held += 500 + len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pd.DataFrame(rows)
                    rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archive files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInPandas(read_files, RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: the records that share a concurrent-to identifier.

    The digest and length of a response are taken anew from its payload.
    """
    kind = F.col("record_type")
    answer = kind.isin("response", "revisit")
    own = F.col("payload").isNotNull()
    rows = records.withColumns(
        {
            "digest": F.when(own, sha1_base32(F.col("payload"))).otherwise(F.col("digest")),
            "payload_bytes": F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")),
            "capture_id": F.coalesce("concurrent_to", "record_id"),
        }
    )

    def one(when: Column, *names: str) -> Column:
        return F.first(F.when(when, F.struct(*names)), ignorenulls=True)

    return rows.groupBy("capture_id").agg(
        one(kind == "request", "record_id", "uri", "date", "fields").alias("request"),
        one(answer, "record_type", "record_id", "uri", "date", "digest", "payload_bytes").alias("response"),
        F.first("payload", ignorenulls=True).alias("payload"),
        one(kind == "metadata", "record_id", "fields").alias("metadata"),
    )


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The pages' archive, written below the shared folder, read and assembled."""
    spark = pages.sparkSession
    path = work_dir(spark, "warc")
    write_archive(planned(pages, min_bytes=min_bytes), path)
    return captures(read_archive(spark, path))
