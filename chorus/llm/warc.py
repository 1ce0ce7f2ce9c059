"""WARC archives with a two-level capture index.

Archives: one gzip member per record, so a record is read by its (file, offset, length).
Of records with equal payloads, that with the largest page_id is the response and the
others are revisits that refer to it.

Index: capture lines ``reversed-host key {json}`` are range-partitioned and sorted on
(key, page_id); every partition writes one file of compressed blocks of ``BLOCK_LINES``
lines and a directory with the first and last key of each block.  A lookup binary-searches
the list of index files (at most ``INDEX_FILES``, the bound of what the driver ships), the
file's directory, and the block that it range-reads; then it range-reads the records.

Defined results: a null html is an empty payload; a null, empty or malformed url has a key
below ``-)``; rows that repeat page_id and payload are all of the same type; a null page_id
is smaller than any other; a page whose payload is alone is a response.

Scale: files go to the shared folder through pyarrow's file systems (local, hdfs, s3, gs).
Each task attempt writes names of its own, and only finished tasks' rows reach the index, so
a lost executor leaves unused files at most.  The key is followed by page_id in the sort, so
a host or url with a third of all captures spreads over many blocks and files.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm.common import by_group, cut, own
from chorus.session import scratch_path

BLOCK_LINES = 1000
INDEX_FILES = 1024
FILE_BYTES = 512 << 20
DATE = "2024-01-01T00:00:00Z"
_DEFAULT_PORT = {"http": 80, "https": 443}


def filesystem(uri: str):
    """pyarrow file system and path of a URI or local path."""
    from pyarrow import fs

    if uri.startswith("/") or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """``http://a.example.net/x?y`` -> ``net,example,a)/x?y``; white space is escaped."""
    try:
        u = urlsplit(url or "")
        host, port = u.hostname, u.port
    except ValueError:
        host = None
    if not host:
        return "-)" + quote(url or "", safe="/:?&=%#")
    port = f":{port}" if port and port != _DEFAULT_PORT.get(u.scheme) else ""
    rest = (u.path or "/") + (f"?{u.query}" if u.query else "")
    host = re.sub(r"\s", lambda m: quote(m[0]), host)  # a space ends the key in its index line
    return ",".join(reversed(host.strip(".").split("."))) + port + ")" + quote(rest, safe="/:?&=%;,@+!$'()*~[]")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _digest(hex_sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_sha1)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit carries no payload, only what it refers to."""
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Target-URI", quote(url or "", safe="/:?&=%#;,@+!$'()*~[]")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return _header(fields) + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of an uncompressed record."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.split(b"\r\n\r\n", 1)[1]


_CAPTURE = "key string, page_id long, file string, offset long, length long"


def _write_records(root: str):
    def run(batches):
        fs, base = filesystem(root)
        out, name, at = None, "", 0
        for b in batches:
            rows = {n: [] for n in ("key", "page_id", "file", "offset", "length")}
            cols = [b.column(n).to_pylist() for n in ("page_id", "url", "sha1", "refers_to")]
            for page, url, sha1, refers, html in zip(*cols, b.column("html").cast(pa.binary())):
                if out is None or at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = gzip.compress(record(page, url, html.as_py() or b"", _digest(sha1), refers), 6, mtime=0)
                out.write(raw)
                for n, v in zip(rows, (url_key(url), page, name, at, len(raw))):
                    rows[n].append(v)
                at += len(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["key"], pa.string()), pa.array(rows["page_id"], pa.int64()), pa.array(rows["file"], pa.string()),
                 pa.array(rows["offset"], pa.int64()), pa.array(rows["length"], pa.int64())], names=list(rows),
            )
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row below ``root``; the captures (key, page_id, file, offset, length)."""
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    src = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.sha1(F.coalesce(F.col(html_col), F.lit(""))).alias("sha1"),
    )
    # the digest is re-expressed on the small side: its join then has an exchange of its own
    last = src.groupBy("sha1").agg(F.max("page_id").alias("last")).select(F.concat("sha1", F.lit("")).alias("s"), "last")
    rows = src.join(last, F.col("sha1") == F.col("s")).select(
        "page_id", "url", "html", "sha1", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to")
    )
    return cut(rows.mapInArrow(_write_records(root), _CAPTURE))


_FILE = pa.schema([("name", pa.string()), ("first", pa.string()), ("last", pa.string()), ("blocks", pa.int64())])


def _write_index(root: str):
    def run(batches):
        fs, base = filesystem(root)
        name = f"index-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        out, held, at, directory = None, [], 0, []

        def flush():
            nonlocal at
            raw = gzip.compress("".join(f"{k} {j}\n" for k, j in held).encode(), 6, mtime=0)
            out.write(raw)
            directory.append([held[0][0], held[-1][0], at, len(raw)])
            at += len(raw)
            held.clear()

        for b in batches:
            cols = [b.column(n).to_pylist() for n in ("key", "page_id", "file", "offset", "length")]
            for key, *rest in zip(*cols):
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}.gz", compression=None)
                held.append((key, json.dumps(rest)))
                if len(held) == BLOCK_LINES:
                    flush()
        if out is not None:
            if held:
                flush()
            out.close()
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pydict(
                {"name": [name], "first": [directory[0][0]], "last": [directory[-1][1]], "blocks": [len(directory)]}, schema=_FILE
            )

    return run


def build_index(captures: DataFrame, root: str) -> list[tuple[str, str, str]]:
    """Write the index of ``captures`` below ``root``; its files as (first key, last key, name)."""
    fs, base = filesystem(root)
    fs.create_dir(base, recursive=True)
    spark = captures.sparkSession
    parts = min(INDEX_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "page_id", "file", "offset"]
    lines = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    files = lines.mapInArrow(_write_index(root), "name string, first string, last string, blocks long").collect()
    return sorted((r["first"], r["last"], r["name"]) for r in files)


def _blocks_of(root: str, files: list[tuple[str, str, str]]):
    """(file number, block offset, block length, key) of the blocks that can hold a key."""

    def run(batches):
        fs, base = filesystem(root)
        first = [f[0] for f in files]
        number, directory, lasts = -1, [], []
        for b in batches:
            rows = {"file_no": [], "at": [], "size": [], "key": []}
            for key in b.column(0).to_pylist():
                n = bisect.bisect_right(first, key) - 1  # the last file that starts at or before
                while n >= 0 and files[n][1] >= key:
                    if n != number:
                        with fs.open_input_stream(f"{base}/{files[n][2]}.dir", compression=None) as f:
                            directory = json.loads(f.read())
                        number, lasts = n, [d[1] for d in directory]
                    for d in directory[bisect.bisect_left(lasts, key) :]:
                        if d[0] > key:
                            break
                        for c, v in zip(rows, (n, d[2], d[3], key)):
                            rows[c].append(v)
                    n -= 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["file_no"], pa.int64()), pa.array(rows["at"], pa.int64()), pa.array(rows["size"], pa.int64()), pa.array(rows["key"], pa.string())],
                names=list(rows),
            )

    return run


def _scan_block(root: str, files: list[tuple[str, str, str]]):
    def run(table: pa.Table):
        fs, base = filesystem(root)
        number, at, size = (table.column(n)[0].as_py() for n in ("file_no", "at", "size"))
        with fs.open_input_file(f"{base}/{files[number][2]}.gz") as f:
            lines = gzip.decompress(f.read_at(size, at)).decode().split("\n")[:-1]
        found = [k.partition(" ")[0] for k in lines]
        rows = []
        for key in table.column("key").to_pylist():
            i = bisect.bisect_left(found, key)
            while i < len(found) and found[i] == key:
                rows.append((key, *json.loads(lines[i].partition(" ")[2])))
                i += 1
        cols = list(zip(*rows)) if rows else [[]] * 5
        types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "page_id", "file", "offset", "length"])

    return run


def lookup(keys: DataFrame, root: str, files: list[tuple[str, str, str]]) -> DataFrame:
    """Captures of the keys in column ``key``, through the index."""
    spread = keys.select("key").where("key IS NOT NULL").distinct().repartitionByRange("key").sortWithinPartitions("key")
    blocks = spread.mapInArrow(_blocks_of(root, files), "file_no long, at long, size long, key string")
    return by_group(blocks, ["file_no", "at"], _scan_block(root, files), _CAPTURE)


def _read_records(root: str):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())

    def run(batches):
        fs, base = filesystem(root)
        name, source = None, None
        for b in batches:
            rows = []
            for file, at, size in zip(*[b.column(n).to_pylist() for n in ("file", "offset", "length")]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{base}/{file}")
                fields, payload = parse(gzip.decompress(source.read_at(size, at)))
                page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
                refers = fields.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                here = fields["WARC-Type"] == "response"
                seen = base64.b32encode(hashlib.sha1(payload).digest()).decode() if here else digest
                rows.append((int(page) if page else None, len(payload) if here else None, seen, fields["WARC-Type"], int(refers) if refers else None, seen == digest))
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
        if source is not None:
            source.close()

    return run


def read_records(captures: DataFrame, root: str) -> DataFrame:
    """Records of the captures by range reads; a revisit gets the payload size of the
    response that it refers to.  ``intact`` tells that the payload has its digest."""
    dealt = captures.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    got = cut(dealt.mapInArrow(
        _read_records(root),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean",
    ))
    full = got.where("record_type = 'response'").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("full"))
    full = full.select(own("page_id").alias("p"), F.concat("payload_digest", F.lit("")).alias("d"), "full")
    out = got.join(full, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    return out.select(
        "page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "intact"
    )


def archive_round_trip(spark: SparkSession, pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write all pages, index them, look every url up through the index and read the
    records back."""
    root = root or scratch_path(spark, "warc")
    captures = write_archives(pages, f"{root}/archive")
    files = build_index(captures, f"{root}/index")
    found = lookup(captures.select("key"), f"{root}/index", files)
    return read_records(found, f"{root}/archive")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31) + 1)::BIGINT, 1)
           FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, true AS intact
FROM s
"""
