"""WARC archives: payloads written as responses, revisits and continuation segments, then read back and put together.

Each payload becomes an HTTP message with chunked transfer framing. A message longer than ``SEGMENT`` is cut: the first
part is the response record, the others are continuation records that name it as their origin. Reading groups the parts
by origin, orders them by segment number, checks that none is missing and that the total length is as stated, and
undoes the framing. Archives are written and read by Spark's own file writers and readers, so any store will do.

A null html is an empty payload. Of rows with equal payloads the largest page_id is the response; rows with that same id
are all responses, null ids count as smallest. Repeated rows stay separate records. A message with missing parts or a wrong
length comes back with a null payload. An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.store import keep, shared_folder

#: Bytes of a record block, bytes of a transfer chunk, records of an archive file, least payload that can be a revisit.
SEGMENT, CHUNK, RECORDS, LEAST = 32 << 10, 8 << 10, 2000, 0
_END = b"\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """An HTTP message whose body is the payload in chunks."""
    parts = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"]
    for i in range(0, len(payload), chunk):
        piece = payload[i : i + chunk]
        parts += [b"%x\r\n" % len(piece), piece, _END]
    return b"".join([*parts, b"0\r\n\r\n"])


def unframed(message: bytes) -> bytes | None:
    """The payload of an HTTP message; None where its chunks are broken."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        stop = body.find(_END, at)
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return None
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if stop < 0 or body[at + size : at + size + 2] != _END:
            return None
        out.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without the two line ends that close it; the writer adds them."""
    lines = [b"WARC/1.1", *(k + b": " + v for k, v in fields), b"Content-Length: %d" % len(block)]
    return _END.join(lines) + b"\r\n\r\n" + block


def _records(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            name = b"<urn:page:%s:%d>" % (str(r["page_id"]).encode(), r["uid"])
            base = [(b"WARC-Target-URI", (r["url"] or "").encode().replace(b"\r", b"").replace(b"\n", b"")), (b"WARC-Payload-Digest", b"sha1:" + r["digest"].encode())]
            if r["revisit"]:
                fields = [(b"WARC-Type", b"revisit"), (b"WARC-Record-ID", name), *base, (b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", b"<urn:page:%d>" % r["largest"])]
                out.append(_record(fields, b"HTTP/1.1 200 OK\r\n\r\n"))
                continue
            message = framed(r["payload"])
            parts = [message[i : i + SEGMENT] for i in range(0, len(message), SEGMENT)]
            for k, part in enumerate(parts, 1):
                own = name if k == 1 else b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, f"{name.decode()}#{k}")).encode()
                fields = [(b"WARC-Type", b"response" if k == 1 else b"continuation"), (b"WARC-Record-ID", own)]
                fields += base if k == 1 else [(b"WARC-Segment-Origin-ID", name)]
                if len(parts) > 1:
                    fields.append((b"WARC-Segment-Number", b"%d" % k))
                    if k == len(parts):
                        fields.append((b"WARC-Segment-Total-Length", b"%d" % len(message)))
                out.append(_record(fields, part))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _digests(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [digest(x) for x in batch.column("payload").to_pylist()]
        yield batch.append_column("digest", pa.array(found, pa.string()))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html) as compressed archives in ``folder``."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.mapInArrow(_digests, "page_id long, url string, payload binary, uid long, digest string")
    known = rows.groupBy("digest").agg(F.max("page_id").alias("largest"))
    marked = rows.join(known, "digest")
    marked = marked.withColumn("revisit", (F.octet_length("payload") >= least) & F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest")))
    records = marked.mapInArrow(_records, "record binary")
    # two line ends close a record; bytes pass through unchanged
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)


def _unpacked(content: bytes) -> bytes:
    """All members of a gzip file, or the bytes themselves."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def _parsed(content: bytes) -> list[tuple]:
    """origin, page, kind, refers, digest, number, total and block of every record of a file."""
    data, at, out = _unpacked(content), 0, []
    while (stop := data.find(b"\r\n\r\n", at)) >= 0:
        head = dict(line.split(b": ", 1) for line in data[at:stop].split(_END)[1:])
        size = int(head[b"Content-Length"])
        name = head.get(b"WARC-Segment-Origin-ID", head[b"WARC-Record-ID"]).decode()
        out.append((
            name, name.split(":")[2], head[b"WARC-Type"].decode(), head.get(b"WARC-Refers-To", b"").decode() or None,
            head.get(b"WARC-Payload-Digest", b"").decode().removeprefix("sha1:") or None, int(head.get(b"WARC-Segment-Number", 1)),
            int(head[b"WARC-Segment-Total-Length"]) if b"WARC-Segment-Total-Length" in head else (None if b"WARC-Segment-Number" in head or b"WARC-Segment-Origin-ID" in head else size),
            data[stop + 4 : stop + 4 + size],
        ))
        at = stop + 4 + size + 4
    return out


def _single(record: tuple) -> bool:
    return record[5] == 1 and record[6] is not None


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _singles(batches) -> Iterator[pa.RecordBatch]:
    """The messages that are one record, their framing undone."""
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for r in filter(_single, _parsed(content.as_py())):
                _, page, kind, refers, stated, _, total, block = r
                out.append((page, kind, refers, stated, unframed(block) if kind == "response" and total == len(block) else None))
            yield _batch(out, ["page", "kind", "refers", "digest", "payload"], [pa.string()] * 4 + [pa.binary()])


def _parts(batches) -> Iterator[pa.RecordBatch]:
    """The records of messages that were cut."""
    names = ["origin", "page", "kind", "refers", "digest", "number", "total", "block"]
    for batch in batches:
        for content in batch.column("content"):
            cut = [r for r in _parsed(content.as_py()) if not _single(r)]
            yield _batch(cut, names, [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.binary()])


def _whole(batches) -> Iterator[pa.RecordBatch]:
    """Put the ordered parts together, check them, undo the framing."""
    for batch in batches:
        out = []
        for parts, kind in zip(batch.column("parts").to_pylist(), batch.column("kind").to_pylist()):
            message = b"".join(p["block"] for p in parts)
            sound = [p["number"] for p in parts] == list(range(1, len(parts) + 1)) and parts[-1]["total"] == len(message)
            out.append(unframed(message) if sound and kind == "response" else None)
        keep = [batch.column(c) for c in ("page", "kind", "refers", "digest")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.binary())], ["page", "kind", "refers", "digest", "payload"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page, kind (response or revisit), refers, digest (as stated) and payload (null for revisits and broken messages)."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    schema = "origin string, page string, kind string, refers string, digest string, number long, total long, block binary"
    out = "page string, kind string, refers string, digest string, payload binary"
    first = lambda c: F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c)
    parts = F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts")
    joined = files.mapInArrow(_parts, schema).groupBy("origin").agg(F.max("page").alias("page"), first("kind"), first("refers"), first("digest"), parts)
    return files.mapInArrow(_singles, out).union(joined.drop("origin").mapInArrow(_whole, out))


def _told(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(None, None) if x is None else (len(x), digest(x)) for x in batch.column("payload").to_pylist()]
        keep = [batch.column(c) for c in ("page", "kind", "refers", "digest")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["page", "kind", "refers", "digest", "size", "own"])


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record read back from the archives.

    A revisit has no payload of its own: its length is that of the response with the same digest.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    # one short row a record; written once, so that the archives are not read again for the lengths of revisits
    told = keep(read_archives(spark, folder).mapInArrow(_told, "page string, kind string, refers string, digest string, size long, own string"))
    sizes = told.where("kind = 'response'").groupBy(F.col("own").alias("digest")).agg(F.max("size").alias("full"))
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return told.join(sizes, "digest", "left").select(
        number("page").alias("page_id"), F.coalesce("size", F.when(F.col("kind") == "revisit", F.col("full"))).alias("payload_bytes"),
        F.when(F.col("kind") == "revisit", F.col("digest")).otherwise(F.col("own")).alias("payload_digest"),
        F.col("kind").alias("record_type"), number("regexp_extract(refers, 'page:(-?[0-9]+)', 1)").alias("refers_to"),
    )
