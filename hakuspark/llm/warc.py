"""WARC archives: write pages, read records back, assemble transactions.

Writing needs no Python: a record is one string, and Spark's text sink ends each with CR LF CR LF, which is a WARC
record's own terminator; files are gzip streams. Reading streams each file through Spark's text source in pieces
between CR LF CR LF and puts blocks together by Content-Length, so a payload may hold any bytes, that sequence
included, and no file is held whole. Assembly joins request and metadata records to the response or revisit record
that their WARC-Concurrent-To names, one nested row per capture. The query parses and digests its archive once, and
stores the records without payloads.

Of pages with equal payloads (SHA-1 and length) of at least min_bytes, the one with the smallest id is a response
and the others are revisits that refer to it.

Defined cases: a null payload is empty; a null id or URL is written empty and read as null; a page with a null id is
always a response; rows that repeat a page's id and payload are all responses; control characters and blanks in a
URL are written as %20; an empty table writes no record and reads as no rows; other columns are ignored. A capture
with more than RELATED_ROWS related records goes on in further rows, numbered by part. Related records without a
response form a capture without one. A record that the end of its file cuts short is marked truncated.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import numbered, scratch, small, stored, table

SEPARATOR = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RELATED_ROWS = 1_000
BATCH_BYTES = 8_000_000
RECORDS = "file string, record_id string, record_type string, target_uri string, date string, concurrent_to string, refers_to string, content_type string, http_status int, payload binary, payload_bytes long, payload_digest string, declared_digest string, truncated boolean"
HEADERS = {"warc-record-id": "record_id", "warc-type": "record_type", "warc-target-uri": "target_uri", "warc-date": "date", "warc-concurrent-to": "concurrent_to", "warc-refers-to": "refers_to", "content-type": "content_type", "warc-payload-digest": "declared_digest"}


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: each 5 hexadecimal digits are 4 base32 digits."""
    h = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(h, i + 1, 5), 16, 32), 4, "0") for i in range(0, 40, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    return F.concat(F.lit("WARC/1.1\r\n"), *(F.coalesce(x, F.lit("")) for x in lines), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> None:
    """Write a response or revisit, a request and a metadata record for every row, as gzip files under path."""
    rows = numbered(pages.select(F.col(key).alias("_key"), F.col(url).alias("_given"), F.col(payload).alias("_payload")), "_row")
    rows = rows.select("_key", F.regexp_replace("_given", r"[\x00-\x20\x7f]", "%20").alias("_url"), F.coalesce(F.col("_payload").cast("binary"), F.lit(b"")).alias("_body"), "_row")
    rows = rows.withColumns({"_digest": base32_sha1(F.col("_body")), "_bytes": F.octet_length("_body").cast("long"), "_id": _urn(F.lit("capture"), F.col("_key"), F.col("_row"))})
    # What a revisit refers to is found without any payload, and joined to the pages by row.
    dated = rows.where(f"_key is not null and _bytes >= {int(min_bytes)}").select("_digest", "_bytes", "_key", "_id", "_row")
    first = stored(dated.groupBy("_digest", "_bytes").agg(F.min(F.struct("_key", "_id")).alias("_first"), F.max("_key").alias("_last")).where("_last > _first._key").drop("_last"), "first")
    again = stored(dated.join(first, ["_digest", "_bytes"]).where("_key > _first._key").select("_row", F.col("_first._id").alias("_refers")), "again")
    rows = rows.join(small(again, again.count()), "_row", "left").withColumn("_revisit", F.col("_refers").isNotNull())
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Target-URI", F.col("_url")), ("WARC-Date", F.lit(DATE))]
    capture = _record(
        [("WARC-Type", F.when(F.col("_revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("_id")), *common,
         ("WARC-Profile", F.when(F.col("_revisit"), REVISIT_PROFILE)), ("WARC-Refers-To", F.col("_refers")),
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "_digest")), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.when(F.col("_revisit"), head).otherwise(F.concat(head, F.col("_body").cast("string"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _urn(F.lit("request"), F.col("_id"))), *common, ("WARC-Concurrent-To", F.col("_id")), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.coalesce("_url", F.lit("")), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.lit("metadata"), F.col("_id"))), *common, ("WARC-Concurrent-To", F.col("_id")), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    rows.select(F.explode(F.array(request, capture, metadata)).alias("value")).write.text(path, compression="gzip", lineSep=SEPARATOR.decode())


def _headers(lines: bytes) -> dict[str, str]:
    found = {}
    for line in lines.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def _blocks(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """Headers, block and whether it is cut short, from what stands between CR LF CR LF in one file."""
    headers, need, block, have = None, 0, [], 0
    for piece in pieces:
        while True:
            if headers is None:
                piece = piece.lstrip(b"\r\n")
                if not piece.startswith(b"WARC/"):
                    break  # not the start of a record: go on to the next one
                headers = _headers(piece)
                length = headers.get("content-length", "")
                need, block, have = int(length) if length.isdigit() else 0, [], 0
                break
            have += len(piece) + len(SEPARATOR) * bool(block)
            block.append(piece)
            if have < need:
                break
            data = SEPARATOR.join(block) if len(block) > 1 else piece
            yield headers, data[:need], False
            headers = None
            if have == need:
                break
            piece = data[need:]  # the block ended within a piece, as its last bytes are CR LF
    if headers is not None:
        yield headers, SEPARATOR.join(block)[:need], True


def _row(file: str, headers: dict[str, str], block: bytes, cut: bool, with_payload: bool) -> dict:
    row = {"file": file, "truncated": cut, "http_status": None} | {column: headers.get(name) or None for name, column in HEADERS.items()}
    if (row["content_type"] or "").startswith("application/http"):
        head, _, block = block.partition(SEPARATOR)
        status = head.split(b"\r\n", 1)[0].split(b" ")
        if status[0].startswith(b"HTTP/") and len(status) > 1 and status[1].isdigit():
            row["http_status"] = int(status[1])
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    return row | {"payload": block if with_payload or row["record_type"] == "metadata" else None, "payload_bytes": len(block), "payload_digest": digest}


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives under path; payloads are digested in any case."""
    arrow = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in RECORDS.split(", "))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple[str, Iterator[bytes]]]:
            rows = ((f, p) for b in batches for f, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            from itertools import groupby

            for file, group in groupby(rows, lambda x: x[0]):
                yield file, (p for _, p in group)

        held, size = [], 0
        for file, pieces in files():
            for found in _blocks(pieces):
                held.append(_row(file, *found, with_payload))
                size += 500 + len(held[-1]["payload"] or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, arrow)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    pieces = spark.read.text(path, lineSep=SEPARATOR.decode()).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(parse, RECORDS)


def assemble(records: DataFrame, related_rows: int = RELATED_ROWS) -> DataFrame:
    """One nested row per capture: capture_id, part, response (a response or revisit record), requests and metadata."""
    record = F.struct(*(F.col(c) for c in records.columns))
    main = records.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), record.alias("response"))
    related = records.where("record_type in ('request', 'metadata')").select(F.col("concurrent_to").alias("_to"), "record_id", "record_type", record.alias("_record"))
    many = stored(related.groupBy("_to").agg(F.count("*").alias("_n")).where(F.col("_n") > related_rows), "many")
    parts = F.coalesce(F.ceil(F.col("_n") / related_rows), F.lit(1))
    dealt = related.join(small(many, many.count()), "_to", "left").withColumn("_part", F.pmod(F.xxhash64("record_id"), parts))
    kind = lambda k: F.array_sort(F.collect_list(F.when(F.col("record_type") == k, F.col("_record"))), lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0))
    grouped = dealt.groupBy("_to", "_part").agg(kind("request").alias("requests"), kind("metadata").alias("metadata"))
    joined = main.join(grouped, F.col("capture_id") == F.col("_to"), "full_outer")
    return joined.select(F.coalesce("capture_id", "_to").alias("capture_id"), F.coalesce("_part", F.lit(0)).cast("int").alias("part"), "response", "requests", "metadata")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    records = stored(read_records(spark, path, with_payload=False), "records")
    captures = assemble(records).where("part = 0 and response is not null")
    page = F.regexp_extract(F.decode(F.col("metadata")[0]["payload"], "utf-8"), r"page-id: *(-?\d+)", 1)
    rows = stored(captures.select("capture_id", F.when(page != "", page.cast("long")).alias("page_id"), "response.record_type", "response.refers_to", "response.payload_bytes", "response.payload_digest"), "captures")
    first = rows.where("record_type = 'response'").select(F.col("capture_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    new = rows.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = rows.where("record_type = 'revisit'").join(first, F.col("refers_to") == F.col("_id"), "left")
    return new.unionByName(again.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to")))


ORACLE_SQL = r"""
with hashed as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as hex from pages
), coded as (
  select page_id, payload_bytes, array_to_string([
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, cast(5 * i + 1 as int), 5) as int) >> 15) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, cast(5 * i + 1 as int), 5) as int) >> 10) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, cast(5 * i + 1 as int), 5) as int) >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((cast('0x' || substr(hex, cast(5 * i + 1 as int), 5) as int) >> 0) & 31) + 1, 1)
    for i in range(8)], '') as payload_digest from hashed
), firsts as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first_id from coded)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id <> first_id then first_id end as refers_to from firsts
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE_SQL}
