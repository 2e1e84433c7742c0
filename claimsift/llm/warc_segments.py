"""WARC archives with segmented, chunk-framed records: writing, reading back, reassembly.

A page becomes one record, or a record and continuations when its framed payload is longer than a
segment.  Archives are written by Spark's text writer (the record ends with CRLF CRLF, which is the
line separator), whole archives are read by the binary reader and cut by Content-Length, continuations
are grouped by the id of the record they continue, put in order and checked against the total length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimsift.session import materialise, new_path

LEAST_BYTES = 1000  # smaller payloads are always stored whole
SEGMENT_BYTES = 32 << 10  # framed bytes of one record
CHUNK_BYTES = 8 << 10  # bytes of one chunk of the transfer framing
RECORDS_PER_ARCHIVE = 512  # at most RECORDS_PER_ARCHIVE * SEGMENT_BYTES and headers are read at once
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"  # written dates are fixed: equal pages give equal archives

_RECORD = "page_id bigint, refers_to bigint, kind string, digest string, origin string, segment int, total bigint, block binary"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(piece := payload[at:at + size]), piece) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        size = int(framed[at:line].partition(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(parts)
        parts.append(framed[at:at + size])
        if len(parts[-1]) != size or framed[at + size:at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + END + block


def records(page_id, url: str, payload: bytes, digest: str, refers_to, name: str, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit without payload, or a response with its continuations."""
    own = f"<urn:row:{name}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Page-ID", page_id)]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END
    if refers_to is not None:
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Refers-To", f"<urn:page:{refers_to}>")], http)
        return
    block = http + chunked(payload, chunk)
    pieces = [block[at:at + segment] for at in range(0, len(block), segment)]
    several = len(pieces) > 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Segment-Number", 1 if several else None)], pieces[0])
    for k, piece in enumerate(pieces[1:], 2):
        last = k == len(pieces)
        yield record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:row:{name}:{k}>"), ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if last else None)], piece)


def split_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, cut by Content-Length."""
    at = 0
    while at < len(content):
        stop = content.index(END, at)
        lines = content[at:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = stop + len(END)
        end = start + int(headers["Content-Length"])
        if content[end:end + len(END)] != END:
            raise ValueError(f"record at {at} has another length")
        yield headers, content[start:end]
        at = end + len(END)


def plan_pages(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set where the page is a revisit."""
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = materialise(rows.select("page_id", "digest", F.length("payload").alias("size")), "payload-keys")
    keepers = (
        keys.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and keeper is not null").select("digest", "keeper"))
    # Only copies are looked up, so pages without a copy stay where they are when the copies are few.
    return rows.join(materialise(keepers, "payload-keepers"), "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("keeper") != F.coalesce("page_id", F.col("keeper") - 1), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, chunk: int = CHUNK_BYTES,
                   per_archive: int = RECORDS_PER_ARCHIVE, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for every page to gzipped archives of at most ``per_archive`` records under ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [r for row in batch.slice(at, 256).to_pylist() for r in records(segment=segment, chunk=chunk, **row)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    planned = plan_pages(pages, least_bytes).withColumn("name", F.monotonically_increasing_id().cast("string"))
    written = planned.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    (written.write.option("lineSep", END.decode()).option("maxRecordsPerFile", per_archive)
     .option("compression", "gzip").text(path))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for every record of the archives under ``path``, in columns of ``_RECORD``."""
    import gzip

    def number(text: str | None) -> int | None:
        return None if text is None else int(text.strip("<>").rsplit(":", 1)[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("page_id", pa.int64()), ("refers_to", pa.int64()), ("kind", pa.string()), ("digest", pa.string()),
                           ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for content in batch.column("content"):
                out = []
                for head, block in split_archive(gzip.decompress(content.as_py())):
                    out.append({
                        "page_id": number(head.get("Page-ID")), "refers_to": number(head.get("WARC-Refers-To")), "kind": head["WARC-Type"],
                        "digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:"), "block": block,
                        "origin": head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"] if "WARC-Segment-Number" in head else None),
                        "segment": number(head.get("WARC-Segment-Number")), "total": number(head.get("WARC-Segment-Total-Length"))})
                yield pa.RecordBatch.from_pylist(out, schema=types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, _RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """(page_id, kind, refers_to, digest, payload) of responses and revisits, payload null for revisits.

    Segments are grouped by origin and put in order of segment number; numbers must run from 1
    without a gap and the joined length must be the total stated by the last one, otherwise the query fails.
    """
    whole = found.where("segment is null").select("page_id", "kind", "refers_to", "digest", "block")
    parts = found.where("segment is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"),
        F.max("refers_to").alias("refers_to"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))  # one page's segments
    block = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all_, part: F.concat(all_, part["block"]))
    joined = parts.withColumn("block", block)
    good = (F.col("parts")[F.size("parts") - 1]["segment"] == F.size("parts")) & (F.length("block") == F.col("total"))
    joined = joined.withColumn("block", F.when(good, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("broken segments of "), "origin"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = []
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("block").to_pylist(), strict=True):
                body = data.partition(END)[2]
                payloads.append(unchunked(body) if kind == "response" else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "kind", "refers_to", "digest")), pa.array(payloads, pa.binary())],
                names=["page_id", "kind", "refers_to", "digest", "payload"])

    return whole.unionByName(joined.select(whole.columns)).mapInArrow(
        run, "page_id bigint, kind string, refers_to bigint, digest string, payload binary")


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the archives under ``path``.

    Bytes and digest of a response are those of the payload read back; a revisit takes them from
    the response that it refers to.  A digest that differs from the one stated fails the query.
    """
    read = materialise(
        reassemble(read_records(spark, path)).select(
            "page_id", "kind", "refers_to", F.col("digest").alias("stated"), F.length("payload").cast("bigint").alias("payload_bytes"),
            F.sha1("payload").alias("payload_digest")), "records")
    full = read.where("kind = 'response'").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    full = full.where("refers_to is not null").dropDuplicates(["refers_to", "payload_digest"])
    again = read.where("kind = 'revisit'").select("page_id", "kind", "refers_to", "stated").join(
        full.withColumnRenamed("payload_digest", "stated").withColumn("payload_digest", F.col("stated")), ["refers_to", "stated"], "left")
    every = read.where("kind = 'response'").unionByName(again)
    digest = F.when(F.col("payload_digest") == F.col("stated"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("another digest")))
    return every.select("page_id", "payload_bytes", digest.alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives in the shared folder and return what reading them gives.

    A null html is an empty payload; a null url has no target header.  Of rows with equal payloads of
    LEAST_BYTES or more, those with the largest page_id are responses (repeated rows all are), others
    revisit it; rows without page_id count as lower than any, and are all responses when no row has one.
    Empty tables give no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path)
    return read_archives(spark, path)
