"""WARC archives: written with an index, read by coalesced byte ranges.

Every record is one gzip member of a WARC/1.1 file, so a byte range of the index
(file, offset, length, URL, digest) is a record by itself. Among records with
equal payloads of at least ``min_payload`` bytes the one with the smallest
page_id is a response and the others are revisits that name it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _packed(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed; a revisit (refers_to given) carries no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {uri}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, payload) of a record; checks its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: None if x == "none" else int(x)
    page_id = number(fields["WARC-Record-ID"].removeprefix("<urn:page:")[:-1])
    if fields["WARC-Type"] == "revisit":
        return page_id, "revisit", size, digest, number(fields["WARC-Refers-To"].removeprefix("<urn:page:")[:-1]), None
    if hashlib.sha256(payload).hexdigest() != digest or size != len(payload):
        raise ValueError(f"record of page {page_id} is damaged")
    return page_id, "response", len(payload), digest, None, payload


def write(pages: DataFrame, folder: str, *, min_payload: int = 100, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) and returns the index.

    The payload is the html in UTF-8; a null html is an empty payload, a null url
    leaves the target URI out. Rows whose page_id equals the smallest one of their
    payload are all responses (repeated rows); a null page_id is never the smallest,
    and payloads that only null page_ids have are all responses. An empty table
    writes no file; other columns are ignored.

    One task attempt writes one file, which its rows of the index name. Payloads are shuffled once, by digest, to learn the
    response of their group; those of the commonest digests stay where they are.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    source = source.withColumn("digest", F.sha2("html", 256))
    first = source.where(F.octet_length("html") >= min_payload).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = shared.written(first, "warc-payloads")
    # at most 1000 payloads can belong to over a thousandth of the pages each: these are broadcast, so no task gets a hot payload
    often = F.col("n") * 1000 > pages.count()
    hot = F.broadcast(first.where(often).drop("n"))
    marked = source.join(hot, "digest").unionByName(source.join(hot, "digest", "left_anti").join(first.where(~often & (F.col("n") > 1)).drop("n"), "digest", "left"))
    marked = marked.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, index = TaskContext.get(), []
        name = f"pages-{context.partitionId():06d}.warc.gz"

        def records():
            at = 0
            for b in batches:
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    data = _packed(record(page_id, url, html.encode(), digest, refers_to, date))
                    index.append((at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit"))
                    at += len(data)
                    yield data

        ahead = records()
        if (one := next(ahead, None)) is not None:
            name, _ = shared.write_file(folder, name, context.taskAttemptId(), _chain(one, ahead))
        for i in range(0, len(index), 10_000):
            cols = list(zip(*index[i : i + 10_000], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cols[0]), pa.string()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["file", "offset", "length", "url", "digest", "page_id", "record_type"])

    return shared.written(marked.mapInArrow(run, INDEX), "warc-index")


def _chain(one, rest):
    yield one
    yield from rest


def coalesced(ranges: list[tuple[int, int]], gap: int, most: int) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, low, high): runs of the sorted ``ranges`` (offset, length) that are read at once."""
    runs = []
    for i, (offset, length) in enumerate(ranges):
        if runs and offset - runs[-1][3] <= gap and offset + length - runs[-1][2] <= most:
            runs[-1][1], runs[-1][3] = i + 1, max(runs[-1][3], offset + length)
        else:
            runs.append([i, i + 1, offset, offset + length])
    return [tuple(r) for r in runs]


def read(spark: SparkSession, folder: str, index: DataFrame, where: Column | None = None, *, payloads: bool = True, gap: int = 65536, most: int = 8 << 20) -> DataFrame:
    """The records of ``index`` that satisfy ``where``, read by byte range.

    Selected records are sorted by file and offset; ranges at most ``gap`` bytes apart
    are read together, up to ``most`` bytes at once. Columns as in ``RECORDS``.
    """
    chosen = index if where is None else index.where(where)
    region = (F.col("offset") / F.lit(32 << 20)).cast("long")
    chosen = chosen.select("file", "offset", "length", "url", region.alias("region"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = chosen.repartition(n, "file", "region").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = shared.filesystem(folder)
        for b in batches:
            names, urls = b.column(0).to_pylist(), b.column(3).to_pylist()
            ranges = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            i = 0
            while i < len(names):
                j = i
                while j < len(names) and names[j] == names[i]:
                    j += 1
                with files.open_input_file(f"{base}/{names[i]}") as f:
                    for first, last, low, high in coalesced(ranges[i:j], gap, most):
                        data = f.read_at(high - low, low)
                        rows = []
                        for k in range(i + first, i + last):
                            o, n = ranges[k]
                            page_id, kind, size, digest, refers, payload = parse(zlib.decompress(data[o - low : o - low + n], 31))
                            rows.append((page_id, urls[k], kind, size, digest, refers, payload if payloads else None))
                        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
                i = j

    out = chosen.drop("region").mapInArrow(run, RECORDS)
    return out if payloads else out.drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT q.page_id, q.payload_bytes, q.payload_digest,
       CASE WHEN f.first_id IS NOT NULL AND q.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN q.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM q LEFT JOIN f USING (payload_digest)
"""
