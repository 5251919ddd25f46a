"""Operator 2: WARC archives with a two-level capture index.

Writing: tasks append one gzip member per record to an archive file of their own in the shared folder and return a
manifest row for it. Index: manifest rows are range-sorted by reversed-host URL key; each range becomes one file of
compressed blocks of lines and a sparse directory with the first key of every block. Look-up: a key finds its ranges
by their first keys, its blocks by binary search in that range's directory, and its lines in those blocks only.
Reading: captures are sorted by file and offset and read by byte ranges.

Files are named by a fresh id for each attempt and count only through stored rows, so lost or repeated tasks leave at
most files that nothing refers to. The only data on the driver are the ranges' first keys, one a partition.

Null html is the empty payload; a null url has the empty key. Records of equal payloads of MIN_REVISIT bytes or more
revisit that of the largest page id; rows of that same id are all responses. A null id is never the largest. Very long
pages are one record. Empty tables give an empty archive and no rows. Extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.llm.common import n_partitions, scratch, stored, table

MIN_REVISIT, BLOCK_LINES = 1000, 1000
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(base: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, as executors see it."""
    if "://" in base or base.startswith("file:"):
        return pafs.FileSystem.from_uri(base if "://" in base else "file://" + base.removeprefix("file:"))
    return pafs.LocalFileSystem(), base


def url_key(url: str | None) -> str:
    """Reversed-host key: http://a.b.com:80/x?y becomes com,b,a:80)/x?y, the host in lower case."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    if not m:
        return url or ""
    return ",".join(reversed(m[1].lower().split("."))) + (m[2] or "") + ")" + (m[3] if m[3].startswith("/") else "/" + m[3])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: bytes) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=''.join(map(chr, range(33, 127))))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """(page id, full payload bytes, full payload digest in hex, type, refers to, payload held here)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    whole = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:"))
    number = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).digest() != digest or len(payload) != whole):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), whole, digest.hex(), kind, number(fields.get("WARC-Refers-To")), payload


_MANIFEST = "url_key string, page_id long, file string, offset long, length long"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, base: str) -> DataFrame:
    """Write pages(page_id, url, html) below base and return the stored manifest, a row a record.

    The largest id of each repeated payload comes from an aggregate over digests; html moves once, to meet it. Payloads too
    small to be revisited, nulls among them, do not move.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"digest": F.sha1(html), "size": F.octet_length(html)})
    same = own.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    refers = F.when((F.col("size") >= MIN_REVISIT) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    large = own.where(F.col("size") >= MIN_REVISIT).join(same, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))
    small = own.where(F.col("size") < MIN_REVISIT).select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    rows = large.unionByName(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        fs.create_dir(f"{root}/warc", recursive=True)
        name, at, out = f"warc/{uuid.uuid4().hex}.warc.gz", 0, None
        for b in batches:
            done = []
            for page_id, url, text, refers_to in zip(*(b.column(i).to_pylist() for i in range(4))):
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (text or "").encode()
                raw = _gzip(record(page_id, url, payload, refers_to, hashlib.sha1(payload).digest()))
                out.write(raw)
                done.append((url_key(url), page_id, name, at, len(raw)))
                at += len(raw)
            yield _table(done, _MANIFEST)
        if out:
            out.close()

    return stored(rows.mapInArrow(run, _MANIFEST))


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


_RANGE = "first string, last string, file string"


def write_index(manifest: DataFrame, base: str, lines: int = BLOCK_LINES) -> list[tuple[str, str]]:
    """Write the index below base; (first key, file) of every range, in order of key: one a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        fs.create_dir(f"{root}/index", recursive=True)
        name = f"index/{uuid.uuid4().hex}"
        out, at, last, directory, held = None, 0, "", [], []

        def flush() -> None:
            nonlocal out, at, last
            out = out or fs.open_output_stream(f"{root}/{name}.blocks", compression=None)
            raw = zlib.compress("\n".join(map(json.dumps, held)).encode(), 3)
            out.write(raw)
            directory.append((held[0][0], at, len(raw)))
            at, last = at + len(raw), held[-1][0]
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                if len(held) == lines:
                    flush()
        if held:
            flush()
        if out:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write("\n".join(map(json.dumps, directory)).encode())
            yield _table([(directory[0][0], last, name)], _RANGE)

    ranges = manifest.repartitionByRange(n_partitions(manifest.sparkSession), "url_key", "page_id").sortWithinPartitions("url_key", "page_id")
    made = stored(ranges.mapInArrow(run, _RANGE))
    # one row a partition; of ranges that begin with the same key, the one that goes on to other keys must be the last
    return [(r["first"], r["file"]) for r in sorted(made.collect())]


def look_up(keys: DataFrame, base: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """All captures of keys(url_key): the manifest's columns."""
    spark = keys.sparkSession
    if not ranges:
        return spark.createDataFrame([], _MANIFEST)
    first, files = [r[0] for r in ranges], [r[1] for r in ranges]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ranges of every key, by bisection; a key that fills several ranges is looked up in each."""
        for b in batches:
            keys_ = b.column(0).to_pylist()
            spans = [range(max(0, bisect.bisect_left(first, k) - 1), bisect.bisect_right(first, k)) for k in keys_]
            yield _table([(k, at) for k, span in zip(keys_, spans) for at in span], _ROUTE)

    routed = keys.distinct().mapInArrow(route, _ROUTE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        now, directory, starts, file, held = -1, [], [], None, (-1, [])
        for b in batches:
            found = []
            for key, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if at != now:
                    with fs.open_input_stream(f"{root}/{files[at]}.directory", compression=None) as f:
                        directory = [json.loads(x) for x in f.read().decode().split("\n")]
                    starts, file, now, held = [d[0] for d in directory], fs.open_input_file(f"{root}/{files[at]}.blocks"), at, (-1, [])
                for block in range(max(0, bisect.bisect_left(starts, key) - 1), bisect.bisect_right(starts, key)):
                    if held[0] != block:
                        _, offset, length = directory[block]
                        held = block, [json.loads(x) for x in zlib.decompress(file.read_at(length, offset)).decode().split("\n")]
                    lines = held[1]
                    found += lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]
                    if len(found) >= 50_000:
                        yield _table(found, _MANIFEST)
                        found = []
            yield _table(found, _MANIFEST)

    return routed.repartition(n_partitions(spark), "range").sortWithinPartitions("range", "url_key").mapInArrow(run, _MANIFEST)


_ROUTE = "url_key string, range long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(captures: DataFrame, base: str, payloads: bool = False) -> DataFrame:
    """Read the captures' records by byte ranges, in order of file and offset; with payloads=True also payload (binary)."""
    schema = _READ + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(base)
        name, file = None, None
        for b in batches:
            out = []
            for own, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                if own != name:
                    name, file = own, fs.open_input_file(f"{root}/{own}")
                out.append(parsed(zlib.decompress(file.read_at(length, offset), 31)))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k, _ in zip(cols, kinds, names)], names)

    ordered = captures.select("file", "offset", "length").repartition(n_partitions(captures.sparkSession), "file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, base = table(spark, sf_dir, "pages"), scratch(spark)
    manifest = write_archives(pages, base)
    ranges = write_index(manifest, base)
    return read_captures(look_up(manifest.select("url_key"), base, ranges), base)


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to FROM q
"""
