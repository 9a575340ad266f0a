"""WARC archives without repeated payloads.

Payloads are shuffled once, by page_id, to keep one row per page; resolution shuffles their digests alone. Of equal payloads the record of the smallest page_id stays a
response and the others become revisit records with fresh headers that refer to it. Archives are written through
Spark's text writer, whose line separator is what ends a WARC record, so any store and the usual commit protocol
serve. Reading takes record after record by its Content-Length and joins revisits to their originals.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow.llm import base

#: Payloads below this size are never revisits.
LEAST = 100
DATE = "2025-01-01T00:00:00Z"
#: Records of one archive file.
PER_FILE = 5_000
#: Bytes that are unpacked at a time, and of payloads in a batch that is read; a record alone may be larger.
STEP, BATCH_BYTES = 1 << 20, 8 << 20
END_OF_RECORD = "\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORDS = (
    "record_id string, page_id long, record_type string, url string, header_digest string, refers_to_id string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def record_id(page_id: Column) -> Column:
    """A name-based UUID of the page."""
    h = F.md5(page_id.cast("string"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def one_per_page(pages: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("html").desc_nulls_last(), F.col("url").desc_nulls_last()))
    rows = pages.where(F.col("page_id").isNotNull()).select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    # White space and controls would end a header line; a record needs a target.
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:page:"), F.col("page_id")))
    return rows.withColumn("place", place).where("place = 1").select("page_id", uri.alias("url"), F.coalesce("html", F.lit("")).alias("html"))


def _headers(kind: str, pairs: list[tuple[str, Column]], block_length: Column) -> Column:
    lines = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\n")]
    for name, value in [*pairs, ("Content-Length", block_length.cast("string"))]:
        lines += [F.lit(f"{name}: "), value, F.lit("\r\n")]
    return F.concat(*lines, F.lit("\r\n"))


def records(pages: DataFrame, least: int = LEAST, date: str = DATE) -> DataFrame:
    """One WARC record per page, as text without the two line ends after it."""
    rows = one_per_page(pages)
    heads = rows.select("page_id", "url", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("bigint").alias("bytes"))
    firsts = heads.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.count("*").alias("n"), F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url")
    )
    revisits = heads.join(firsts.where("n > 1"), ["digest", "bytes"]).where("page_id <> first").select("page_id", "first", "first_url")
    resolved = rows.join(revisits, "page_id", "left")
    digest = F.concat(F.lit("sha256:"), F.sha2("html", 256))
    http = F.concat(F.lit(HTTP), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    common = [
        ("WARC-Record-ID", record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", digest),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    again = [
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", record_id(F.col("first"))),
        ("WARC-Refers-To-Target-URI", F.col("first_url")),
        ("WARC-Refers-To-Date", F.lit(date)),
    ]
    response = F.concat(_headers("response", common, F.octet_length(http) + F.octet_length("html")), http, F.col("html"))
    revisit = F.concat(_headers("revisit", common + again, F.octet_length(http)), http)
    return resolved.select(F.when(F.col("first").isNull(), response).otherwise(revisit).alias("value"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, date: str = DATE) -> None:
    """Write deduplicated archives, gzip files of records, into a new folder.

    Rows without page_id are left out; of rows with one page_id the greatest html counts. A null html is empty. Other
    columns are ignored.
    """
    options = {"lineSep": END_OF_RECORD, "compression": "gzip", "maxRecordsPerFile": PER_FILE}
    records(pages, least, date).write.options(**options).text(folder)


def unpacked(data: bytes, step: int = STEP) -> Iterator[bytes]:
    """An archive's content piece by piece; it may consist of several gzip members."""
    member = zlib.decompressobj(wbits=31)
    while data:
        piece = member.decompress(data, step)
        if piece:
            yield piece
        data = member.unconsumed_tail
        if member.eof:
            data = member.unused_data
            member = zlib.decompressobj(wbits=31)
        elif not data:
            piece = member.flush()
            if piece:
                yield piece


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an unpacked archive; no more than a record and a piece
    are held at once."""
    have = bytearray()
    at = 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            have.extend(piece)
        return piece is not None

    while True:
        seen = 0
        while (stop := have.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(have) - 3)
            if not more():
                if have:
                    raise ValueError(f"the record at byte {at} has no end of its headers")
                return
        lines = have[:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers[name.lower()] = value.strip()
        begin = stop + 4
        end = begin + int(headers["content-length"])
        while len(have) < end + 4 and more():
            pass
        if have[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at + end} has another length")
        yield headers, bytes(have[begin:end])
        del have[: end + 4]
        at += end + 4


def _parsed(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["record_id", "page_id", "record_type", "url", "header_digest", "refers_to_id", "payload_bytes", "payload_digest", "payload"]

    def of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for h, block in parse(unpacked(content.as_py())):
                payload = block.partition(b"\r\n\r\n")[2] if h["warc-type"] == "response" else None
                digest = h["warc-payload-digest"].removeprefix("sha256:")
                own = hashlib.sha256(payload).hexdigest() if payload is not None else None
                if own not in (None, digest):
                    raise ValueError(f"the payload of {h['warc-record-id']} does not match its digest")
                size = len(payload) if payload is not None else None
                held += len(payload or b"") if with_payload else 0
                if held > BATCH_BYTES and rows:
                    yield of(rows)
                    rows, held = [], 0
                rows.append((h["warc-record-id"], int(h["x-page-id"]), h["warc-type"], h["warc-target-uri"], digest, h.get("warc-refers-to"), size, own, payload if with_payload else None))
            if rows:
                yield of(rows)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives of a folder; revisits have no payload of their own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(lambda it: _parsed(it, with_payload), RECORDS)


def resolved(found: DataFrame) -> DataFrame:
    """Revisit records with the size, digest and payload of the response that they refer to."""
    originals = found.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        *(F.col(x).alias(f"full_{x}") for x in ("payload_bytes", "payload_digest", "payload")),
    )
    # Responses refer to nothing and are not joined, so that no key is that of all of them.
    revisits = found.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    full = [F.coalesce(x, f"full_{x}").alias(x) for x in ("payload_bytes", "payload_digest", "payload")]
    responses = found.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    columns = ["page_id", "record_type", "url", "header_digest", "refers_to"]
    return revisits.select(*columns, *full).union(responses.select(*columns, "payload_bytes", "payload_digest", "payload"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = base.shared_folder(spark)
    write_archives(base.table(spark, sf_dir, "pages"), folder)
    out = resolved(base.kept_table(read_archives(spark, folder, with_payload=False)))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
