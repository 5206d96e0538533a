"""WARC archives, index first: write, index, and read back selected records by coalesced byte ranges.

Every task writes one or more archives of gzip members into the shared folder, under a name of its own attempt, and
returns the index row of each record (file, offset, length, URL, digest). The index is what Spark commits: an archive
of a lost attempt is named nowhere. Readers select from the index, sort by file and offset, and join neighbouring
ranges to reads of up to ``READ_BYTES``.

Of payloads that are equal (SHA-1 and length) and at least ``MIN_BYTES`` long, the record of the largest page number is
the response and the others are revisits without payload. Groups are found by an aggregation of digests alone; they
are broadcast if at most ``MAX_GROUPS`` exist, else joined by digest, where adaptive execution splits hot digests.

Nulls: null html is an empty payload, a null URL gives no target header, a null page number is smaller than any and
refers to its group's largest. Rows tied at the largest number, repeated rows included, are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_BYTES, MAX_GROUPS, ARCHIVE_BYTES, READ_BYTES, TASK_BYTES = 1000, 200_000, 1 << 30, 8 << 20, 128 << 20
INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])
INDEX_DDL = "file string, offset long, length long, url string, digest string, record_type string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CLEAN = {i: f"%{i:02X}" for i in [*range(32), 127]}


def record_id(page_id, digest: str) -> str:
    """The same on every run, so that a revisit can tell the record that it refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"


def target(name: str, url: str | None) -> list[str]:
    """A header of a URL; where control characters had to be escaped, one more has its bytes as they are."""
    clean = url and url.translate(CLEAN)
    return [] if url is None else [f"{name}: {clean}", *([] if clean == url else [f"X-{name}-Base64: {base64.b64encode(url.encode()).decode()}"])]


def info(date: str) -> bytes:
    """The record that opens an archive."""
    body = b"software: pagewright\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to, refers_url: str | None, date: str) -> bytes:
    """One record, uncompressed. A revisit (``refers_to``) has the HTTP head only, which tells the payload's length."""
    b32 = base64.b32encode(bytes.fromhex(digest)).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block, refers = head + payload, []
    if refers_to is not None:
        block = head
        refers = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", *target("WARC-Refers-To-Target-URI", refers_url), f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest) if refers_to is None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}",
        *target("WARC-Target-URI", url), *([] if page_id is None else [f"X-Page-ID: {page_id}"]), f"WARC-Payload-Digest: sha1:{b32}", *refers,
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one uncompressed record."""
    at = data.index(b"\r\n\r\n")
    lines = data[:at].decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = data[at + 4 : at + 4 + int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def tagged(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload (null for revisits), size, digest, refers_to, refers_url."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("c"), F.max("page_id").alias("largest"), F.max_by("url", "page_id").alias("largest_url"))
    groups = common.materialize(large.where("c > 1 and largest is not null").drop("c"), "equal-payloads")
    groups = F.broadcast(groups) if common.bounded(groups, MAX_GROUPS) else groups
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    rows = rows.join(groups, ["digest", "size"], "left").withColumn("refers_to", refers)
    return rows.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to", F.when(F.col("refers_to").isNotNull(), F.col("largest_url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all ``pages`` (page_id, url, html); returns their index, already committed."""
    spark = pages.sparkSession
    common.ship(spark)
    folder = folder or common.temporary(spark, "warc")

    def write(batches):
        out, path, offset = None, "", 0
        for batch in batches:
            index = []
            for at in range(0, batch.num_rows, 200):
                for r in batch.slice(at, 200).to_pylist():
                    if out is None:
                        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = common.open_output(path)
                        first = gzip.compress(info(date), 6, mtime=0)
                        out.write(first)
                        offset = len(first)
                    member = gzip.compress(record(r["page_id"], r["url"], r["payload"] or b"", r["size"], r["digest"], r["refers_to"], r["refers_url"], date), 6, mtime=0)
                    out.write(member)
                    index.append((path, offset, len(member), r["url"], r["digest"], "response" if r["refers_to"] is None else "revisit"))
                    offset += len(member)
                    if offset >= archive_bytes:
                        out.close()
                        out = None
            yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, x)) for x in index], INDEX)
        if out is not None:
            out.close()

    return common.materialize(tagged(pages).mapInArrow(write, INDEX_DDL), "warc-index")


def ranges(entries, limit: int):
    """``(file, offset, length, [(offset, length)])``: sorted neighbouring entries of a file joined up to ``limit``."""
    run = None
    for file, offset, length in entries:
        if run and run[0] == file and run[1] + run[2] == offset and run[2] + length <= limit:
            run[2] += length
            run[3].append((offset, length))
            continue
        if run:
            yield tuple(run)
        run = [file, offset, length, [(offset, length)]]
    if run:
        yield tuple(run)


def read_records(index: DataFrame, read_bytes: int = READ_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The selected records: page_id, url, payload_bytes, payload_digest (hex), record_type, refers_to, payload.

    The index is small beside the archives, so readers are dealt by the bytes of the archives: one for each
    ``task_bytes``, and as many as there are shuffle partitions at least.
    """
    common.ship(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(common.shuffle_parts(index.sparkSession), -(-total // task_bytes))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            columns = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for file, offset, length, members in ranges(columns, read_bytes):
                with common.open_input(file) as source:
                    source.seek(offset)
                    data = source.read(length)
                rows = []
                for at, n in members:
                    headers, http, payload = parse_record(zlib.decompress(data[at - offset : at - offset + n], 31))
                    told = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind, size = headers["warc-type"], len(payload)
                    if kind == "revisit":
                        size = int(http.decode().rpartition("Content-Length: ")[2])
                    elif hashlib.sha1(payload).hexdigest() != told:
                        raise ValueError("a payload does not have the digest that its record tells")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
                    url = headers.get("x-warc-target-uri-base64")
                    url = headers.get("warc-target-uri") if url is None else base64.b64decode(url).decode()
                    rows.append((page and int(page), url, size, told, kind, refers and int(refers), payload))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in rows], schema)

    dealt = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op1_warc_roundtrip(spark, sf_dir: str) -> DataFrame:
    """A record for every row of ``pages``, written and read back by the index."""
    pages = spark.read.parquet(common.table_path(sf_dir, "pages"))
    return read_records(write_archives(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d, n HAVING count(*) > 1)
SELECT page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN m IS NOT NULL AND (page_id IS NULL OR page_id < m) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m IS NOT NULL AND (page_id IS NULL OR page_id < m) THEN m END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
