"""WARC archives of pages: written in segments, read back by reassembly.

A response whose block exceeds SEGMENT bytes is written as a first record and
continuation records.  Reading groups them by the identifier of the first, orders
them by segment number, verifies numbers and total length, takes off the HTTP
head, decodes the chunked transfer framing and verifies the payload's digest.
Pages with equal payloads are written once, the others as revisit records.

Archives are written and read through Spark's own text and binary-file sources,
so they can be in any store that Spark reaches.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, frugal, scratch, stored

#: Largest block of one record, largest chunk of the transfer framing, records of one archive file.
SEGMENT, CHUNK, RECORDS_PER_FILE = 16 << 10, 4 << 10, 1000
#: Smaller payloads are always written as responses.
LEAST_REVISIT = 100
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def decided(pages: DataFrame, *, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null: response) for each page.

    Groups are counted before pages are dealt out by digest; only digests that
    repeat take part in the join, and its large partitions can be split.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= least
    groups = pages.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.filter("n > 1").select(F.col("digest").alias("_digest"), "first"))
    out = pages.join(groups, (F.col("digest") == F.col("_digest")) & large, "left")
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    parts = [payload[i : i + chunk] for i in range(0, len(payload), chunk)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """A WARC record without the two line ends after its block."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + END).encode() + block


def page_records(ident: str, page_id, url, payload: bytes, digest: str, refers_to, *, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a revisit, a response, or a response in segments."""
    uri = "".join((url or "urn:page:unknown").split()) or "urn:page:unknown"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-ID", page_id)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        extra = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", refers_to), ("X-Payload-Length", len(payload))]
        return [record([*extra, *common, ("Content-Type", "application/http; msgtype=response")], head + b"\r\n")]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{ident}>"), *common, ("Content-Type", "application/http; msgtype=response")]
    if len(block) <= segment:
        return [record(first, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for no, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{ident}/{no}').urn}>"), ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", no), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
        out.append(record([*own, ("WARC-Segment-Total-Length", len(block) if no == len(parts) else None)], part))
    return out


def write_archives(pages: DataFrame, path: str, *, segment: int = SEGMENT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write decided pages as WARC files below path.

    Record identifiers are those of the writing task and row, so that repeated
    rows have records of their own.
    """
    schema = pa.schema([("value", pa.binary())])

    def run(batches):
        task, no = TaskContext.get().partitionId(), 0
        for b in batches:
            out, size = [], 0
            for row in zip(*(c.to_pylist() for c in b.columns)):
                out += page_records(uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{task}/{no}").urn, *row, segment=segment)
                no += 1
                size += len(row[2])
                if size > 4 << 20:
                    yield batch(schema, out)
                    out, size = [], 0
            yield batch(schema, out)

    lines = pages.mapInArrow(frugal(run), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def parse(data: bytes):
    """Headers (names in lower case) and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = end + 4
        size = int(headers["content-length"])
        if data[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at + size} has another length")
        yield headers, data[at : at + size]
        at += size + 4


_RECORD = "origin string, segment int, total long, kind string, page_id long, refers_to long, digest string, payload_bytes long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below path, with the identifier of the record they belong to."""
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])

    def run(batches):
        number = lambda h, k: int(h[k]) if k in h else None
        for b in batches:
            for data in b.column(0):
                out, size = [], 0
                for h, block in parse(data.as_buffer().to_pybytes()):
                    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    out.append((h.get("warc-segment-origin-id", h["warc-record-id"]), number(h, "warc-segment-number"), number(h, "warc-segment-total-length"), h["warc-type"], number(h, "x-page-id"), number(h, "x-refers-to-page-id"), digest, number(h, "x-payload-length"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch(schema, *map(list, zip(*out)))
                        out, size = [], 0
                if out:
                    yield batch(schema, *map(list, zip(*out)))

    # part files only: what a committer leaves beside them is no archive
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(frugal(run), _RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest, problem.

    problem names what was wrong with a response: a missing segment, a wrong total
    length, broken chunks or another digest; it is null when all is well.
    """
    single = records.filter("segment IS NULL").select("kind", "page_id", "refers_to", "digest", "payload_bytes", F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("long").alias("total"), F.array("block").alias("blocks"))
    parts = records.filter("segment IS NOT NULL").groupBy("origin").agg(
        F.max(F.when(F.col("segment") == 1, F.struct("kind", "page_id", "refers_to", "digest", "payload_bytes"))).alias("h"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    parts = parts.select("h.*", F.col("parts.segment").alias("numbers"), "total", F.col("parts.block").alias("blocks"))
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("problem", pa.string())])

    def whole(numbers, total, blocks, digest):
        if numbers is not None:
            if numbers != [*range(1, len(numbers) + 1)] or total is None:
                return None, "a segment is missing"
            if sum(map(len, blocks)) != total:
                return None, "the total length is another one"
        block = b"".join(blocks)
        head, _, body = block.partition(b"\r\n\r\n")
        try:
            payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        except ValueError as e:
            return None, f"broken chunks: {e}"
        if digest is not None and hashlib.sha256(payload).hexdigest() != digest:
            return payload, "the digest is another one"
        return payload, None

    def run(batches):
        for b in batches:
            out, size = [], 0
            for kind, page, refers, digest, length, numbers, total, blocks in zip(*(c.to_pylist() for c in b.columns)):
                if kind == "revisit":
                    out.append((page, kind, refers, None, length, digest, None))
                    continue
                payload, problem = whole(numbers, total, blocks, digest)
                known = payload is not None
                out.append((page, kind, refers, payload, len(payload) if known else None, hashlib.sha256(payload).hexdigest() if known else None, problem))
                size += len(payload or b"")
                if size > 4 << 20:
                    yield batch(schema, *map(list, zip(*out)))
                    out, size = [], 0
            if out:
                yield batch(schema, *map(list, zip(*out)))

    names = ["kind", "page_id", "refers_to", "digest", "payload_bytes", "numbers", "total", "blocks"]
    return single.select(names).unionByName(parts.select(names)).mapInArrow(frugal(run), "page_id long, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, problem string")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as WARC archives in the scratch folder and read them back: one row for each page.

    A null html is an empty payload, a null url a placeholder.  Of pages with equal
    payloads of at least LEAST_REVISIT bytes the smallest page_id is the response
    (all its rows, where it repeats); rows without id are never that one unless
    all are.  A page that does not come back whole is an error.  An empty table
    gives an empty result; other columns do not matter.
    """
    spark = pages.sparkSession
    path = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(decided(pages), path)
    back = reassembled(read_records(spark, path))
    sound = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(": "), F.col("problem")))).otherwise(F.col("payload_bytes"))
    return back.select("page_id", sound.cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
