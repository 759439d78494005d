"""WARC archives of pages with revisit records for repeated payloads, and a reader that checks them."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shared_folder
from lodestone.session import table

END = "\r\n"
#: Fixed values of the format: the revisit profile for identical payloads, and RFC 4648's base32 digits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Compressed bytes of records that one file holds at most, unless one record alone is larger.
FILE_BYTES = 32_000_000
#: A gzip member of nothing, which the text writer puts between lines; readers of many members skip it.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
READ_SCHEMA = (
    "page_id long, url string, record_type string, record_id string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary, digest_ok boolean"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 40 hex digits are eight groups of four base32 digits."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), BASE32_HEX, BASE32)


def resolve_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_url and _payload of each page.

    Headers (all but the payload) are cut from the pages first and reduced by payload digest to the
    smallest page_id of each. Revisit records are made of headers alone: those of a digest that a third
    of all pages share are split by Spark's skew handling, and no payload of theirs is shuffled.
    Payloads are joined by page_id and a hash, which few rows share, for responses only.

    A null html is an empty payload. Payloads under min_bytes are all responses. Rows that repeat
    the smallest page_id are all responses; a null page_id is never an original unless all are null.
    Other columns of pages are not kept.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    names = ["page_id", "url", "payload_bytes", "payload_digest"]
    # A cheap hash tells the payloads of a page_id apart, so that each payload is digested once.
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("_payload"), F.xxhash64(payload).alias("_mark"))
    headers = cut(rows.select("page_id", "url", F.octet_length("_payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("_payload").cast("binary")).alias("payload_digest"), "_mark"))
    counted = headers.where(F.col("payload_bytes") >= min_bytes)
    originals = (
        counted.groupBy("payload_digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.col("url").alias("url"))).alias("_first"))
        # The digest's own digits, but not the column that was grouped by: its partitions would be reused and hot ones not split.
        .select(F.concat(F.substring("payload_digest", 1, 16), F.substring("payload_digest", 17, 16)).alias("_digest"), F.col("_first.page_id").alias("_original"), F.col("_first.url").alias("_original_url"))
    )
    same = F.col("payload_digest") == F.col("_digest")
    again = counted.join(originals, same & F.col("_original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_original")))
    revisits = again.select(
        *names, F.lit("revisit").alias("record_type"), F.col("_original").alias("refers_to"), F.col("_original_url").alias("refers_to_url"), F.lit(None).cast("string").alias("_payload")
    )
    first = counted.join(originals, same & F.col("page_id").eqNullSafe(F.col("_original")), "left_semi")
    if min_bytes > 0:
        first = first.unionByName(headers.where(F.col("payload_bytes") < min_bytes))
    keys = first.select(F.col("page_id").alias("_id"), F.col("_mark").alias("_m"), "payload_bytes", "payload_digest").distinct()
    held = rows.join(keys, (F.col("_mark") == F.col("_m")) & F.col("page_id").eqNullSafe(F.col("_id")))
    none = F.lit(None)
    responses = held.select(*names, F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"), none.cast("string").alias("refers_to_url"), "_payload")
    return revisits.unionByName(responses)


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for null; line ends in the value are percent-encoded, as in any URL."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), clean, F.lit(END)))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def format_records(resolved: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Each row as one WARC/1.1 record without its closing blank lines, in a column named record.

    A record's id is that of its page; rows that repeat a page_id repeat it. All records bear one date.
    """
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END + END),
    )
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    fields = [
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        _header("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        _header("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(F.col("_block")).cast("string")),
        F.lit(END),
        F.col("_block"),
    ]
    return resolved.withColumn("_block", block).select(F.concat(*fields).alias("record"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, one each, put together to the contents of files."""
    held: list[bytes] = []
    size = 0

    def file() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["content"])

    for batch in batches:
        for record in batch.column(0):
            member = gzip.compress(record.as_py() + b"\r\n\r\n", 6, mtime=0)
            if held and size + len(member) > FILE_BYTES:
                yield file()
                held, size = [], 0
            held.append(member)
            size += len(member)
    if held:
        yield file()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write pages as gzip WARC files under path, a member for each record, so that any record can be read by its offset.

    The files come from Spark's own text writer, to which a file's members are one line: its commit
    protocol copes with lost executors on any file system that Spark writes to, and what it writes between lines is a
    member of nothing. A file holds at most 32 MB (a larger record has a file of its own), so that readers may
    take files whole. An empty table gives archives without records.
    """
    records = format_records(resolve_revisits(pages, min_bytes)).select(F.col("record").cast("binary"))
    files = records.mapInArrow(_pack, "content binary").select(F.col("content").cast("string").alias("value"))
    files.write.mode("overwrite").option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER).option("maxRecordsPerFile", 1).text(path)


def _inflate(content: bytes) -> bytes:
    """All members of a gzip file, one after another; other content as it is. A member that is cut off is an error."""
    if content[:2] != b"\x1f\x8b":
        return content
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(content)) as members:  # reads on from member to member, a buffer at a time
            return members.read()
    except (EOFError, zlib.error, gzip.BadGzipFile) as error:
        raise ValueError(f"a gzip member is cut off or broken: {error}") from error


def _page_of(record_id: str | None) -> int | None:
    """The page_id in a record's id; None in ids of other writers."""
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The response and revisit records of an archive; records of other types are skipped, malformed ones are errors.

    Fields are found whatever their case. Where a record states no payload digest, it is that of the payload
    and digest_ok is null; where no length, it is the payload's.
    """
    data, at = _inflate(content), 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        first, *lines = data[at : head if head >= 0 else at + 80].decode("utf-8", "replace").split(END)
        if head < 0 or not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = fields.get("content-length", "")
        if not length.isdecimal():
            raise ValueError(f"no length of the record at byte {at}")
        block = data[head + 4 : head + 4 + int(length)]
        end = head + 4 + int(length)
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at byte {end}")
        at = end + 4
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        whole = kind == "response"
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        stated = re.search(rb"(?i)^Content-Length: *(\d+)", http, re.M)
        yield (
            _page_of(fields.get("warc-record-id")),
            fields.get("warc-target-uri"),
            kind,
            fields.get("warc-record-id"),
            _page_of(fields.get("warc-refers-to")),
            int(stated[1]) if stated else len(payload) if whole else None,
            digest or own,
            payload if whole else None,
            own == digest if whole and digest else None,
        )


_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.int64()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("digest_ok", pa.bool_())]
)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for row in parse_archive(content.as_py()):
                rows.append(row)
                held += len(row[7] or b"") + 500
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path; digest_ok tells whether a payload has the digest that its header gives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(_parse_files, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    read = read_archives(spark, path)
    return read.select(
        "page_id",
        "payload_bytes",
        F.when(F.coalesce("digest_ok", F.lit(True)), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p
), o AS (SELECT payload_digest AS d, min(page_id) AS original FROM b GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS NOT NULL AND page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM b JOIN o ON b.payload_digest = o.d
"""
