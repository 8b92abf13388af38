"""WARC archives, index first.

``write_archives`` writes one gzip member per record and returns the index (file, offset, length, URL, digest,
page_id) before anything is read; ``read_records`` takes any selection of index rows, sorts it by place, joins
neighbouring byte ranges into few reads and parses the members. Both stream: a task holds one range at a time.

Records whose payload is shorter than ``least`` bytes are all responses. Of longer ones with equal payloads the
smallest page_id is the response (null counts as the largest; of repeated ids the first written keeps the role by
row number within the id), the others are revisits that carry the payload's digest and length, refer to the
response and hold no payload. Null html is the empty payload, null URLs are written as empty. Empty tables
give no archive. Extra columns are ignored.

The digests of a hot payload meet as one partial minimum per task. A payload with over a thousandth of the shared ones'
copies is hot: there are less than a thousand of those, so their responses are broadcast, and their pages take no part in
the join on the digest but are dealt by their own hash. Long pages are held a record at a time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

INDEX_DDL = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
_FIELD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def plan_records(pages: DataFrame, least: int = 100, hot: int = 1000) -> DataFrame:
    """pages with digest, payload_bytes, record_type and refers_to. Fewer than ``hot`` payloads are broadcast."""
    pages = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    keys = pages.where(F.col("payload_bytes") >= least).select("digest", "page_id")
    shared = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1 and first_id is not null")
    shared = common.materialize(shared, "shared-payloads")
    total = shared.agg(F.sum("n")).first()[0] or 0
    wide = shared.where(F.col("n") * hot > total).select("digest", F.col("first_id").alias("hot_id"))
    known = pages.join(F.broadcast(wide), "digest", "left")
    known = known.withColumn("_key", F.when(F.col("hot_id").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id").cast("string")))
    cold = shared.where(F.col("n") * hot <= total).select(F.col("digest").alias("_key"), "first_id")
    found = known.join(cold, "_key", "left").withColumn("first_id", F.coalesce("hot_id", "first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return found.select("page_id", "url", "html", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def _uid(page_id, digest: str) -> str:
    h = hashlib.sha256(f"{page_id}:{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def render(page_id, url: str, html: str, digest: str, kind: str, refers_to, size: int, date: str) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (html.encode() if kind == "response" else b"")
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _uid(page_id, digest).encode(), b"WARC-Date: " + date.encode(), b"WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url).encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"X-Payload-Length: " + str(size).encode(), b"X-Page-ID: " + (b"" if page_id is None else str(page_id).encode())]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _uid(refers_to, digest).encode(), b"X-Refers-To-Page: " + str(refers_to).encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: " + str(len(body)).encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the planned records below ``folder``; returns the stored index."""
    html = records.columns.index("html")

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, seq, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            nonlocal seq, held, size, rows
            name = f"{folder}/part-{part:06d}-{seq:05d}.warc.gz"
            common.write_blob(name, *held)
            out = pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], strict=True))], ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
            seq, held, size, rows = seq + 1, [], 0, []
            return out

        for batch in batches:
            for some in common.parts(batch, html, 200):
                for r in some.to_pylist():
                    packer = zlib.compressobj(level, wbits=31)
                    member = packer.compress(render(r["page_id"], r["url"], r["html"], r["digest"], r["record_type"], r["refers_to"], r["payload_bytes"], date)) + packer.flush()
                    held.append(member)
                    rows.append((size, len(member), r["url"], r["digest"], r["page_id"], r["record_type"]))
                    size += len(member)
                    if size >= archive_bytes:
                        yield close()
        if rows:
            yield close()

    return common.materialize(records.mapInArrow(write, INDEX_DDL), "warc-index")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = {k.decode(): v.decode() for k, v in _FIELD.findall(head + b"\r\n", len(head.split(b"\r\n", 1)[0]) + 2)}
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't fit")
    return fields, rest[:n]


def ranges(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(file, offset, length, first row, end row) of the reads that cover rows sorted by file and offset."""
    at = 0
    while at < len(rows):
        file, lo, n = rows[at]
        hi, to = lo + n, at + 1
        while to < len(rows) and rows[to][0] == file and rows[to][1] - hi <= gap and rows[to][1] + rows[to][2] - lo <= most:
            hi, to = max(hi, rows[to][1] + rows[to][2]), to + 1
        yield file, lo, hi - lo, at, to
        at = to


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 4 << 20) -> DataFrame:
    """Read the records of the given index rows: page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    html. A response's payload is hashed again and must fit its header; a revisit states its response's."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for file, lo, n, first, end in ranges(places, gap, most):
                data, out = common.read_range(file, lo, n), []
                for _, offset, length in places[first:end]:
                    fields, block = parse(zlib.decompress(data[offset - lo : offset - lo + length], wbits=31))
                    payload, kind = block.partition(b"\r\n\r\n")[2], fields["WARC-Type"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError(f"{file}: the payload at {offset} doesn't fit its digest")
                    out.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, int(fields["X-Payload-Length"]), digest, kind, int(fields["X-Refers-To-Page"]) if kind == "revisit" else None, fields["WARC-Target-URI"], payload.decode()))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"])

    near = index.select("file", "offset", "length").repartition(common.partitions(index.sparkSession), "file", (F.col("offset") / F.lit(most)).cast("long")).sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages", "page_id", "url", "html")
    index = write_archives(plan_records(pages), common.work_dir(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
