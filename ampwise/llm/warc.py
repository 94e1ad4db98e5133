"""WARC archives of pages: writing transactions, reading records, and assembling captures.

Each page becomes a transaction of three records: the response, or a revisit where an equal payload has its response
elsewhere; the request; and metadata. Request and metadata name the capture in ``WARC-Concurrent-To``, a revisit its
response in ``WARC-Refers-To``. Archives are gzip files below a folder that executors share, written and listed by
Spark alone. Reading goes by the records' ``Content-Length``, so payloads may hold anything.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampwise.session import fresh_path, stage

VERSION, RECORD = "WARC/1.1", "WARC/"  # as written, and what any record begins with
GZIP = b"\x1f\x8b"
PIECE = 1 << 16  # packed bytes at a time
BATCH_BYTES = 8 << 20  # of the rows that travel at once
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
MIN_REVISIT_BYTES = 0  # smaller payloads are never revisits
FILE_ROWS = 1000  # transactions of a file
LINE, END = "\r\n", "\r\n\r\n"

RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string,"
    " payload_digest string, payload_bytes long, digest_ok boolean, page_id long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a string's bytes in base 32; five bits a letter, read from two hex digits."""
    hexed = F.sha1(payload.cast("binary"))

    def letter(k: Column) -> Column:
        bit = k * 5
        pair = F.conv(F.substring(hexed, (bit / 4).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
        five = F.floor(pair / F.pow(F.lit(2), 3 - bit % 4)).cast("int") % 32
        return F.substring(F.lit(BASE32), five + 1, F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _record(kind: str | Column, record_id: Column, headers: list[Column], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    head = [F.concat(F.lit(f"{VERSION}{LINE}WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    head += [F.lit(f"WARC-Date: {DATE}"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(LINE, *head), F.lit(END), block)  # concat_ws leaves out null headers


def transactions(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(value): the records of each page as text, the last without its closing blank lines.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, that with the largest page_id is the response
    and the others revisit it; a null id is the smallest, and among equal ids one row is the response. A null html is an
    empty payload; a null url or page_id leaves its header out; line ends in urls are percent-encoded.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = stage(
        pages.select(
            F.col("page_id").cast("long").alias("page_id"),
            F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
            payload.alias("payload"),
            base32_sha1(payload).alias("digest"),
            F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("id"),
        )
    )
    first = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy(F.col("digest").alias("equal_digest"))
    first = first.agg(F.max(F.struct("page_id", "id")).alias("response"), F.count("*").alias("n")).where("n > 1")
    first = stage(first.select("equal_digest", F.col("response.id").alias("response_id")))
    rows = rows.join(first, F.col("digest") == F.col("equal_digest"), "left")
    revisit = F.coalesce((F.octet_length("payload") >= min_revisit_bytes) & (F.col("response_id") != F.col("id")), F.lit(False))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), F.col("id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
    )
    capture = _record(
        F.when(revisit, "revisit").otherwise("response"),
        F.col("id"),
        [
            uri,
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
            F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), F.col("response_id"))),
            F.lit("Content-Type: application/http; msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, "payload")),
    )
    path = F.coalesce(F.regexp_extract("url", "^[^:]*://[^/?#]*([^#]*)", 1), F.lit(""))
    host = F.coalesce(F.regexp_extract("url", "^[^:]*://([^/?#]*)", 1), F.lit(""))
    request = _record(
        "request",
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")),
        [uri, concurrent, F.lit("Content-Type: application/http; msgtype=request")],
        F.concat(F.lit("GET /"), F.ltrim(path, F.lit("/")), F.lit(f" HTTP/1.1{LINE}Host: "), host, F.lit(END)),
    )
    metadata = _record(
        "metadata",
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")),
        [uri, concurrent, F.lit("Content-Type: application/warc-fields")],
        F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(LINE)), F.lit("")),
    )
    return rows.select(F.concat_ws(END, request, capture, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives of ``pages`` below ``path``, gzip files of whole transactions; an empty table gives an empty archive."""
    rows = transactions(pages, min_revisit_bytes)
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def unpacked(raw: bytes) -> Iterator[bytes]:
    """The bytes of an archive in pieces: of all gzip members, of which an archive usually has one per record, or as they are.

    Zeros may follow the last member; an archive that ends inside a member is an error.
    """
    if raw[:2] != GZIP:
        yield raw
        return
    at = 0
    while at < len(raw):
        if raw[at : at + 2] != GZIP:
            if raw.count(0, at) < len(raw) - at:
                raise ValueError(f"no gzip member at byte {at}")
            return
        packer = zlib.decompressobj(wbits=31)
        while not packer.eof:
            chunk = raw[at : at + PIECE]
            if not chunk:
                raise ValueError("the archive ends inside a member")
            piece = packer.decompress(chunk)
            at += len(chunk) - len(packer.unused_data)
            if piece:
                yield piece


def _headers(lines: list[str]) -> dict[str, str]:
    """Names in lower case; a line that begins with white space goes on with the header before."""
    found, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers, names in lower case, and block of each record; no more than a record and a piece is held."""
    pieces, held, passed = iter(pieces), bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        gap = 0  # blank lines close a record
        while True:
            while gap < len(held) and held[gap] in b"\r\n":
                gap += 1
            if gap < len(held) or not more():
                break
        del held[:gap]
        passed += gap
        if not held:
            return
        searched = 0
        while (end := held.find(END.encode(), searched)) < 0:
            searched = max(0, len(held) - len(END))
            if not more():
                raise ValueError(f"the archive ends in the header of the record at byte {passed}")
        lines = held[:end].decode(errors="replace").split(LINE)
        if not lines[0].startswith(RECORD):
            raise ValueError(f"no WARC record at byte {passed}")
        headers = _headers(lines[1:])
        first = end + len(END)
        after = first + int(headers["content-length"])
        while len(held) < after:
            if not more():
                raise ValueError(f"the archive ends in the record at byte {passed}")
        yield headers, bytes(held[first:after])
        del held[:after]
        passed += after


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    kind = headers.get("warc-type")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = right = page = payload = None
    if kind in ("response", "revisit"):
        payload = block
        if headers.get("content-type", "application/http").startswith("application/http"):
            head, _, payload = block.partition(END.encode())
            told = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
            size = int(told[1]) if told else None
        if kind == "response":
            whole = size is None or len(payload) == size
            size = len(payload) if size is None else size
            if digest and ":" not in digest:  # others can't be checked
                right = whole and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
    elif kind == "metadata":
        found = re.search(rb"(?m)^page_id:[ \t]*(-?\d+)\r$", block)
        page = int(found[1]) if found else None
    names = ("warc-record-id", "warc-concurrent-to", "warc-refers-to")
    uri = headers.get("warc-target-uri")
    if uri and uri[0] == "<" and uri[-1] == ">":  # as some archives have it
        uri = uri[1:-1]
    own = payload if with_payload and kind == "response" else None
    return (kind, *(headers.get(n) for n in names), uri, digest, size, right, page, own)


def _record_batches(with_payload: bool):
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.int64(), pa.binary()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in parse_records(unpacked(content.as_py())):
                    rows.append(_row(headers, block, with_payload))
                    size += len(rows[-1][-1] or b"") + 512
                    if size > BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``, of any WARC version, packed by record or as a whole.

    ``digest_ok`` tells whether a response's payload has its length and SHA-1 digest; null where there is none or one of another
    kind. Records of other types come with their names alone.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(_record_batches(with_payload), RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """(capture, request, metadata, original): one nested row per capture.

    Request and metadata are those concurrent to the capture, null if there is none; ``original`` has the record_id and
    page_id of the response that a revisit refers to.
    """
    held = F.struct("*")
    requests = records.where("record_type = 'request'").select(F.col("concurrent_to").alias("r_to"), held.alias("request"))
    metadata = records.where("record_type = 'metadata'").select(F.col("concurrent_to").alias("m_to"), held.alias("metadata"))
    named = metadata.select(F.col("m_to").alias("o_id"), F.struct(F.col("m_to").alias("record_id"), "metadata.page_id").alias("original"))
    found = records.where("record_type in ('response', 'revisit')").select(held.alias("capture"))
    return (
        found.join(requests, F.col("capture.record_id") == F.col("r_to"), "left")
        .join(metadata, F.col("capture.record_id") == F.col("m_to"), "left")
        .join(named, F.col("capture.refers_to") == F.col("o_id"), "left")
        .select("capture", "request", "metadata", "original")
    )


def round_trip(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Captures of ``pages`` after writing and reading archives in the shared folder; payloads are checked, not kept.

    One capture per row of ``pages``, repeated rows included; an empty table gives none.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes)
    return captures(stage(read_records(spark, path, with_payload=False)))
