"""WARC archives with a two-level capture index.

Records are gzip members of .warc.gz files. The index is sorted by reversed-host URL key in range
partitions; a shard of it is a file of compressed blocks of entries and, at its end, the sparse
directory of the first key of each block. A lookup finds the shard by its first key, the block by
binary search in the directory and the entry in the block; records are then read by byte range.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, new_path, open_input, open_output, spread, written

#: Payloads of fewer bytes are stored as often as they occur.
LEAST_PAYLOAD = 100
BLOCK_ENTRIES = 1000
FILE_BYTES = 256 << 20
#: Bytes of records that a task reads by ranges.
READ_BYTES = 64 << 20
FOOTER = "<QQ8s"
MAGIC = b"WFCDX01\n"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: com,example,www)/path?query in lower case; '-' for none."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return quote(url, safe="/:?&=#,;@!+%")
    where = ",".join(reversed(host.split(".")))
    port = f":{port}" if port and (u.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return quote(f"{where}{port})" + (u.path or "/").lower() + (f"?{u.query.lower()}" if u.query else ""), safe="/:?&=,;@!+%)")


def entry_key(url: str | None, page_id: int | None) -> str:
    """Entries of one URL are ordered by page, so that a URL of many captures spreads over blocks and shards."""
    return f"{url_key(url)} {LAST_ID if page_id is None else page_id + 2**62:020d}"


def record_id(url: str | None, page_id: int | None) -> str:
    """The same for rows that repeat url and id: they are one capture."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, entry_key(url, page_id))}>"


def _info(name: str) -> bytes:
    """The warcinfo record that a file begins with."""
    block = b"software: weftline\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 2025-01-01T00:00:00Z", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def _record(url: str | None, page_id: int | None, html: str | None, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(url, page_id)}", "WARC-Date: 2025-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {quote(url, safe='/:?&=#,;@!+%~()[]$*')}"] if url else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_url, refers_to)}", "WARC-Refers-To-Date: 2025-01-01T00:00:00Z", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (of a revisit: none) of one gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns entries: key, page_id, uri, offset, length.

    Of equal payloads of LEAST_PAYLOAD bytes or more the smallest page_id is the response and larger ones
    revisit it; rows that repeat that id are responses too. A null page_id comes after every id, so it
    revisits a page that has one, else it is a response. A null html is an empty payload, a null url has
    the key '-'; extra columns are ignored, an empty table writes nothing, and a page of any length is one record. Equal payloads meet by digest and smallest id only, never as a group. Files are named
    anew by each attempt of a task; only those in the returned written table count.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")), 256)
    first = pages.where(F.octet_length("html") >= LEAST_PAYLOAD).groupBy(digest.alias("of")).agg(F.min("page_id").alias("first"), F.min_by("url", F.struct("page_id", "url")).alias("first_url"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    first = written(first, "warc-first")
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", digest.alias("digest")).join(first, F.col("digest") == F.col("of"), "left")
    later = F.col("first").isNotNull() & (F.octet_length("html") >= LEAST_PAYLOAD) & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    each = each.select("page_id", "url", "html", "digest", F.when(later, F.col("first")).alias("refers_to"), "first_url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, at = None, "", 0
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for r in batch.slice(i, 500).to_pylist():
                    if out is None or at > FILE_BYTES:
                        if out:
                            out.close()
                        uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                        out = open_output(uri)
                        info = _info(uri.rpartition("/")[2])
                        out.write(info)
                        at = len(info)
                    data = _record(r["url"], r["page_id"], r["html"], r["digest"], r["refers_to"], r["first_url"])
                    out.write(data)
                    rows.append((entry_key(r["url"], r["page_id"]), r["page_id"], uri, at, len(data)))
                    at += len(data)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), ENTRY.types)], schema=ENTRY)
        if out:
            out.close()

    return written(each.mapInArrow(write, "key string, page_id long, uri string, offset long, length long"), "warc-entries")


ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PLACE = pa.schema([("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_index(entries: DataFrame, folder: str) -> DataFrame:
    """Sorted shards of the index; returns their list: shard (uri), first_key, n_blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, directory, at, held = None, f"{folder}/{uuid.uuid4().hex}.cdx", [], 0, []

        def flush() -> int:
            data = zlib.compress("\n".join(held).encode(), 6)
            directory.append((held[0].split("\t")[0], at, len(data)))
            out.write(data)
            held.clear()
            return at + len(data)

        for batch in batches:
            out = out or open_output(uri)
            for r in batch.to_pylist():
                held.append("\t".join((r["key"], r["uri"], str(r["offset"]), str(r["length"]))))
                if len(held) == BLOCK_ENTRIES:
                    at = flush()
        if out:
            if held:
                at = flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail)
            out.write(struct.pack(FOOTER, at, len(tail), MAGIC))
            out.close()
            yield pa.record_batch({"shard": [uri], "first_key": [directory[0][0]], "n_blocks": pa.array([len(directory)], pa.int64())})

    ordered = entries.select("key", "uri", "offset", "length").repartitionByRange("key", "uri", "offset").sortWithinPartitions("key", "uri", "offset")
    return written(ordered.mapInArrow(write, "shard string, first_key string, n_blocks long"), "warc-shards")


class IndexShard:
    def __init__(self, uri: str):
        self.file = open_input(uri)
        self.file.seek(self.file.size() - struct.calcsize(FOOTER))
        at, size, magic = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri}: not a capture index")
        self.file.seek(at)
        self.directory = json.loads(zlib.decompress(self.file.read(size)))
        self.firsts = [d[0] for d in self.directory]
        self.last, self.block = -1, ([], [])

    def _block(self, n: int) -> tuple[list[str], list[list[str]]]:
        if n != self.last:
            self.file.seek(self.directory[n][1])
            rows = [line.split("\t") for line in zlib.decompress(self.file.read(self.directory[n][2])).decode().split("\n")]
            self.last, self.block = n, ([r[0] for r in rows], rows)
        return self.block

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """Every record of key in this shard: uri, offset, length."""
        found, n = [], bisect_right(self.firsts, key) - 1
        while n >= 0:
            keys, rows = self._block(n)
            to = bisect_right(keys, key)
            at = to
            while at and keys[at - 1] == key:
                at -= 1
            found += [(r[1], int(r[2]), int(r[3])) for r in rows[at:to]]
            if at or to == 0:
                break
            n -= 1  # the key fills the block from its start: the one before may end with it
        return found


def lookup(keys: DataFrame, shards: DataFrame) -> DataFrame:
    """keys: distinct key. Returns uri, offset, length of each record that has one of them.

    The list of shards (one for each task that sorted the index) is all that the driver sees. A key that
    fills several shards is looked up in each of them.
    """
    known = sorted((r["first_key"], r["shard"]) for r in shards.collect())
    firsts, names = [k for k, _ in known], [s for _, s in known]

    @F.pandas_udf("array<int>")
    def route(key: pd.Series) -> pd.Series:
        def of(k: str) -> list[int]:
            hi = bisect_right(firsts, k) - 1
            lo = hi
            while lo > 0 and firsts[lo] == k:
                lo -= 1
            return list(range(max(lo, 0), hi + 1))

        return key.map(of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = -1, None
        for batch in batches:
            found = []
            for n, key in zip(batch["n"].to_pylist(), batch["key"].to_pylist()):
                if n != last:
                    last, index = n, IndexShard(names[n])
                found += index.find(key)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), PLACE.types)] if found else [pa.array([], t) for t in PLACE.types], schema=PLACE)

    # as many tasks as shards or cores: the keys are small, what is read by them isn't, which Spark can't tell
    tasks = max(len(names), keys.sparkSession.sparkContext.defaultParallelism)
    sent = keys.select("key", F.explode(route("key")).alias("n")).repartitionByRange(tasks, "n", "key").sortWithinPartitions("n", "key")
    return sent.mapInArrow(read, "uri string, offset long, length long")


def read_records(places: DataFrame) -> DataFrame:
    """Range reads, in the order of each file; payloads are checked against their digest.

    Returns page_id, record_type, payload_digest, refers_to, payload_bytes (of a revisit null: it has no payload).
    """
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, file = "", None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(batch[c].to_pylist() for c in ("uri", "offset", "length"))):
                if uri != last:
                    last, file = uri, open_input(uri)
                file.seek(offset)
                headers, payload = parse_record(file.read(length))
                kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].partition(":")[2]
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{uri} at {offset}: the payload doesn't have its digest")
                number = lambda name: int(v) if (v := headers.get(name)) else None  # noqa: E731, B023
                rows.append((number("X-Page-ID"), kind, digest, number("X-Refers-To-Page-ID"), len(payload) if kind == "response" else None))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)

    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(-(-size // READ_BYTES), places.sparkSession.sparkContext.defaultParallelism)  # by the bytes that they read
    ordered = places.repartitionByRange(tasks, "uri", "offset").sortWithinPartitions("uri", "offset")
    return ordered.mapInArrow(read, "page_id long, record_type string, payload_digest string, refers_to long, payload_bytes long")


RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])


def write_and_read(pages: DataFrame) -> DataFrame:
    """Archives pages, indexes them, looks every page up and reads its record back: a row for each row of pages."""
    spark = pages.sparkSession
    entries = write_archives(pages, new_path(spark, "warc"))
    shards = write_index(entries, new_path(spark, "cdx"))

    @F.pandas_udf("string")
    def key(url: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([entry_key(u, int(p) if p else None) for u, p in zip(url, page_id)], dtype=object)

    keys = pages.select(key("url", F.col("page_id").cast("string")).alias("key")).distinct()
    records = written(read_records(written(lookup(keys, shards), "warc-places")), "warc-records")
    sizes = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("of"), F.col("payload_digest").alias("of_digest")).agg(F.max("payload_bytes").alias("of_bytes"))
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("of_digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(*columns).union(revisits.withColumn("payload_bytes", F.col("of_bytes")).select(*columns))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    return write_and_read(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(encode(coalesce(html, ''))) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""
