"""WARC archives: writing segmented records, and putting segments together again.

Each page becomes a WARC 1.1 response whose block is an HTTP message in chunked framing, or
a revisit of an earlier page with the same payload. Blocks over a segment's length go on in
continuation records. Reading groups those by origin, orders them by number, checks the
total length and removes the chunked framing.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsgrist.functions.lineage import cut_lineage
from newsgrist.functions.skew import salt_of
from newsgrist.llm.common import small_batches

# Payloads below this length are never revisits.
REVISIT_BYTES = 100
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
# So a file holds at most 32 MB of segments and can be read whole.
RECORDS_PER_FILE = 1024
RECORD_END = "\r\n\r\n"
# The first bytes of a gzip member (deflate) and of a record.
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"(?:(?<=\n)|\A)WARC/1\.[0-9]+\r\n")
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
# A chunk size; longer ones are no size of anything.
_HEX = re.compile(rb"[0-9A-Fa-f]{1,16}")
_DECIMAL = re.compile(r"[0-9]{1,18}")
_SIGNED = re.compile(r"-?[0-9]{1,19}")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``payload`` in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, trailers ignored; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not _HEX.fullmatch(digits):
            return None
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """Body of an HTTP message, without its framing; None if it is no complete message."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    fields = head.lower().split(b"\r\n")[1:]
    if any(f.split(b":")[0] == b"transfer-encoding" and b"chunked" in f for f in fields):
        return unchunked(body)
    return body


def record_id(*parts) -> str:
    """A record id fixed by what the record is."""
    digest = blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest)}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that close it: the writer's separator."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(
    page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int,
    refers_to: int | None, response: bool, segment: int = SEGMENT_BYTES,
) -> Iterator[bytes]:
    """All records of one page."""
    own = record_id("page", page_id, digest, copy)
    fields = [
        ("WARC-Type", "response" if response else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe=":/?#[]@!$&'()*+,;=%~")),
        ("X-Page-ID", page_id), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if not response:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        first = record_id("page", refers_to, digest, 1)
        yield _record([*fields, ("WARC-Profile", profile), ("WARC-Refers-To", first)], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield _record(fields, block)
        return
    for number, at in enumerate(range(0, len(block), segment), 1):
        part = block[at : at + segment]
        total = len(block) if at + segment >= len(block) else None
        if number == 1:
            yield _record([*fields, ("WARC-Segment-Number", 1)], part)
        else:
            yield _record(
                [
                    ("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(own, number)),
                    ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own),
                    ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total),
                ],
                part,
            )


def _with_roles(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, copy number and the page they revisit.

    Digests alone find the duplicates; pages move once, dealt by (digest, salt), so that
    one payload of many pages is many small groups.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = cut_lineage(
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("digest", "page_id", salt_of("page_id").alias("salt"))
    )
    shared = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    answers = slim.select("digest", "salt").distinct().join(shared, "digest").withColumn("shared", F.lit(True))
    dealt = rows.withColumn("salt", salt_of("page_id")).repartition("digest", "salt")
    same = Window.partitionBy("digest", "salt", "page_id").orderBy("url")
    dealt = dealt.withColumn("copy", F.row_number().over(same))
    found = dealt.join(answers, ["digest", "salt"], "left")
    response = F.col("shared").isNull() | (F.col("page_id").eqNullSafe(F.col("first")) & (F.col("copy") == 1))
    return found.select("page_id", "url", "payload", "digest", "copy", "first", response.alias("response"))


def write_archives(pages: DataFrame, path: str, *, segment: int = SEGMENT_BYTES) -> None:
    """WARC files (gzip) with the records of all pages, in a folder all executors share.

    Of pages with equal payloads of at least ``REVISIT_BYTES``, the first row of the
    smallest ``page_id`` is a response and the others revisit it; null ids come last and a
    null html is an empty payload. Repeated rows are records of their own.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "payload"):
            out = []
            for row in batch.to_pylist():
                out += page_records(
                    row["page_id"], row["url"], row["payload"], row["digest"], row["copy"],
                    row["first"], row["response"], segment,
                )
            yield pa.record_batch([pa.array(out, pa.binary())], ["record"])

    records = _with_roles(pages).mapInArrow(written, "record binary")
    # Spark's text writer copies bytes as they are; the separator closes each record.
    records.select(F.col("record").cast("string")).write.option("lineSep", RECORD_END).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def plain_bytes(archive: bytes, step: int = 1 << 12) -> tuple[bytes, int]:
    """The content of a gzip file with one member or many, and how many of them were damaged.
    Of a damaged member what comes before the damage counts, but for a few KB; reading goes on
    at the next sign of a member."""
    view, parts, at, damaged = memoryview(archive), [], 0, 0
    while 0 <= at < len(archive):
        start, unpacker = at, zlib.decompressobj(31)
        try:
            while at < len(archive) and not unpacker.eof:
                parts.append(unpacker.decompress(view[at : at + step]))
                at = min(at + step, len(archive))
        except zlib.error:
            damaged += 1
            at = archive.find(_MEMBER, start + 1)
            continue
        if not unpacker.eof:
            damaged += 1
            break
        at -= len(unpacker.unused_data)
        if archive[at : at + len(_MEMBER)] != _MEMBER:
            at = archive.find(_MEMBER, at)
    return b"".join(parts), damaged


def records_of(archive: bytes, left_out: list[int] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one file, gzip or plain.

    Any bytes are read. A record that the end of the file cuts off, or without a
    ``Content-Length`` of decimal digits, is left out; reading goes on at the next line that
    begins a record. ``left_out`` gets one number: how many records and gzip members were.
    """
    skipped = 0
    if archive[:2] == b"\x1f\x8b":
        archive, skipped = plain_bytes(archive)
    found = _START.search(archive)
    while found:
        at = found.start()
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].decode("utf-8", "replace").split("\r\n")[1:] if end >= 0 else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = fields.get("content-length", "")
        stop = end + 4 + int(length) if _DECIMAL.fullmatch(length) else -1
        # Another record's first line is no field of this one.
        if end < 0 or not 0 <= stop <= len(archive) or any(line.startswith("WARC/1.") for line in lines):
            skipped += 1
            found = _START.search(archive, at + 1)
            continue
        yield fields, archive[end + 4 : stop]
        found = _START.search(archive, stop)
    if left_out is not None:
        left_out.append(skipped)


_RECORD = (
    "record_id string, type string, page_id bigint, url string, digest string, refers_to_id string, "
    "origin string, number int, total bigint, block binary"
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in _RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def number(text: str | None, most: int = (1 << 63) - 1) -> int | None:
        if text is None or not _SIGNED.fullmatch(text):
            return None
        value = int(text)
        return value if -most <= value <= most else None

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for fields, block in records_of(content.as_py()):
                get = fields.get
                rows.append((
                    get("warc-record-id"), get("warc-type"), number(get("x-page-id")), get("warc-target-uri"),
                    (get("warc-payload-digest") or "").removeprefix("sha256:") or None, get("warc-refers-to"),
                    get("warc-segment-origin-id"), number(get("warc-segment-number"), (1 << 31) - 1),
                    number(get("warc-segment-total-length")), block,
                ))
                size += len(block)
                if size > 4 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in ``path``, one row each. Damaged ones are left out and
    counted by ``archive_damage``; numbers that are none are null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parsed, _RECORD)


def archive_damage(spark: SparkSession, path: str) -> DataFrame:
    """``path, left_out``: for each archive how many records and gzip members were not read."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[int] = []
            for content in batch.column("content"):
                for _ in records_of(content.as_py(), counts):
                    pass
            yield pa.record_batch([batch.column("path"), pa.array(counts, pa.int64())], ["path", "left_out"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(counted, "path string, left_out bigint")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, totals = batch.column("numbers"), batch.column("totals")
        payloads = []
        for i, blocks in enumerate(batch.column("blocks")):
            block = b"".join(blocks.as_py())
            wanted = [t for t in totals[i].as_py() if t is not None]
            gapless = numbers[i].as_py() == list(range(1, len(blocks) + 1))
            whole = gapless and (wanted == [len(block)] if len(blocks) > 1 or wanted else True)
            payloads.append(payload_of(block) if whole else None)
        yield pa.record_batch(
            [batch.column("record_id"), batch.column("page_id"), batch.column("url"), batch.column("digest"), pa.array(payloads, pa.binary())],
            ["record_id", "page_id", "url", "digest", "payload"],
        )


def reassemble(records: DataFrame) -> DataFrame:
    """``record_id, page_id, url, digest, payload`` of each response of ``read_records``.

    Segments meet under their origin and are put in order by number. ``payload`` is null
    where a number is missing or doubled, the total length differs, no last segment tells
    it, or the chunked framing is broken. Continuations without their origin give nothing.
    """
    blank = F.array(F.lit(None).cast("bigint"))
    whole = records.where("type = 'response' and number is null").select(
        "record_id", "page_id", "url", "digest", F.array("block").alias("blocks"),
        F.array(F.lit(1)).alias("numbers"), blank.alias("totals"),
    )
    segments = records.where("number is not null and type in ('response', 'continuation')")
    # A group is one record: what a single page holds.
    grouped = segments.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("digest").alias("digest"),
        F.max((F.col("type") == "response").cast("int")).alias("known"),
        F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"),
    )
    parted = grouped.where("known = 1").select(
        "record_id", "page_id", "url", "digest", F.col("parts.block").alias("blocks"),
        F.col("parts.number").alias("numbers"), F.col("parts.total").alias("totals"),
    )
    return whole.unionByName(parted).mapInArrow(
        _joined, "record_id string, page_id bigint, url string, digest string, payload binary"
    )


def archive_index(records: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` per record.

    A revisit takes length and digest from the response it names, as read back; where that
    is missing they are null.
    """
    responses = cut_lineage(
        reassemble(records).select(
            "record_id", "page_id", "url", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_digest"),
        )
    )
    revisits = cut_lineage(
        records.where("type = 'revisit'").select("page_id", "url", F.col("refers_to_id").alias("key"), "record_id")
    )
    known = responses.select(
        F.col("record_id").alias("key"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest"
    )
    # A response may be named by a third of all records: the lookup is by (id, salt).
    salted = revisits.withColumn("salt", salt_of("record_id"))
    answers = salted.select("key", "salt").distinct().join(known, "key")
    found = salted.repartition("key", "salt").join(answers, ["key", "salt"], "left")
    first = responses.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("bigint").alias("refers_to"),
    )
    return first.unionByName(
        found.select("page_id", "url", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    )
