"""WARC archives with a two-level capture index.

Every task writes one archive of gzip members, a record each.  Index lines, keyed by the URL with its host
reversed and the page's id, are sorted by ranges of the key into shards.  A shard holds its lines in
compressed blocks and ends with a sparse directory: the first key of each block and where the block lies.  A
lookup finds the shard among the shards' first keys, the block in its directory, the line in the block, each
by binary search, and then reads just the record's bytes from its archive.

Files are written below the shared folder through pyarrow's file systems, so any store that those reach will
do.  Names end in a random part: a task that runs twice leaves a file that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, join_counted, map_rows, scratch, written

#: Lines in a compressed block, and lines in a shard.
BLOCK_LINES, SHARD_LINES = 512, 100_000
#: Records, and bytes of them as they lie in archives, that a task reads.
READ_RECORDS, READ_BYTES = 4096, 64_000_000
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:page:"


def surt(url: str | None) -> str:
    """The URL with its host's labels reversed: org,example,)/path?query.  Scheme, www, user and default port go."""
    m = re.match(r"(?i)\s*(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)", url or "")
    host, port, rest = m[1].lower(), m[2] or "", m[3] or "/"
    host = re.sub(r"^www\d*\.", "", host)
    port = "" if port in (":80", ":443") else port
    return ",".join(reversed(host.split("."))) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def index_key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'-' if page_id is None else page_id}".replace("\n", "%0A")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri_name(page_id: int | None) -> str:
    return f"<{_URN}{'-' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record.  A revisit holds the HTTP headers alone, whose Content-Length is that of the whole payload."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uri_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri_name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one record; header names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.lower()] = value.strip()
    return out


def _page_of(urn: str) -> int | None:
    s = urn.strip("<>").removeprefix(_URN)
    return None if s == "-" else int(s)


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _gunzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


@dataclass
class Archive:
    """Where an archive and its index lie: `lines` the index lines as a table, `shards` (first key, file, directory's place)."""

    root: str
    lines: DataFrame
    shards: list[tuple[str, str, int, int]]


def _record_types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages with body, its digest in hex and keeper: the largest id among equal payloads of min_bytes or more that repeat."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    small = pages.select("page_id", F.sha1(body).alias("digest"), F.length(body).alias("n")).where(F.col("n") >= min_bytes)
    kept = small.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows")).where("rows > 1 and keeper is not null")
    kept = written(kept.select("digest", "keeper"), "warc-equal")
    return join_counted(pages.select("page_id", "url", body.alias("body"), F.sha1(body).alias("digest")), kept, "digest", "left")


_LINES = "key string, page_id long, file string, offset long, length long"


def write(pages: DataFrame, min_bytes: int = 0) -> Archive:
    """Archive every row of pages and index it.

    A null html is an empty payload, a null url an empty one; null ids are written as "-".  Of rows with equal
    payloads those of the largest id are responses (all of them, if that id repeats) and the others revisit
    it; where all ids are null, all are responses.  An empty table gives an archive without records.
    """
    spark = pages.sparkSession
    root = scratch(spark, "warc")

    def archive(rows: Iterator[tuple]) -> Iterator[tuple]:
        fs, top = filesystem(root)
        out, name, at = None, f"{uuid.uuid4().hex}.warc.gz", 0
        try:
            for digest, page_id, url, body, keeper in rows:
                if out is None:
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)
                revisit = keeper is not None and keeper != page_id
                raw = _member(record(page_id, url, body, base64.b32encode(bytes.fromhex(digest)).decode(), keeper, revisit))
                out.write(raw)
                yield index_key(url, page_id), page_id, name, at, len(raw)
                at += len(raw)
        finally:
            if out is not None:
                out.close()

    lines = written(map_rows(_record_types(pages, min_bytes).select("digest", "page_id", "url", "body", "keeper"), _LINES, archive), "warc-lines")
    return Archive(root, lines, _index(lines, root))


def _index(lines: DataFrame, root: str) -> list[tuple[str, str, int, int]]:
    """Write the shards; the driver gets a row for each, of some SHARD_LINES lines."""
    n = max(1, -(-lines.count() // SHARD_LINES))

    def shard(rows: Iterator[tuple]) -> Iterator[tuple]:
        fs, top = filesystem(root)
        first = next(rows, None)
        if first is None:
            return
        fs.create_dir(top, recursive=True)
        name, at, directory, block = f"{uuid.uuid4().hex}.cdx.gz", 0, [], []
        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:

            def flush() -> int:
                raw = _member("\n".join(json.dumps(x, separators=(",", ":")) for x in block).encode())
                out.write(raw)
                directory.append((block[0][0], at, len(raw)))
                return at + len(raw)

            block.append(first)
            for row in rows:
                if len(block) >= BLOCK_LINES:
                    at, block[:] = flush(), []
                block.append(row)
            at = flush()
            raw = _member(json.dumps(directory).encode())
            out.write(raw)
        yield first[0], name, at, len(raw)

    ordered = lines.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    out = map_rows(ordered.select("key", "page_id", "file", "offset", "length"), "first string, shard string, at long, length long", shard)
    return sorted(tuple(r) for r in written(out, "warc-shards").collect())


class Shard:
    """An open shard: its directory, and the block read last."""

    def __init__(self, root: str, name: str, at: int, length: int):
        fs, top = filesystem(root)
        self._file = fs.open_input_file(f"{top}/{name}")
        self.directory = json.loads(_gunzip(self._file.read_at(length, at)))
        self._first = [d[0] for d in self.directory]
        self._block = lru_cache(4)(self._read)

    def _read(self, k: int) -> list[list]:
        _, at, length = self.directory[k]
        return [json.loads(x) for x in _gunzip(self._file.read_at(length, at)).decode().split("\n")]

    def find(self, key: str) -> Iterator[list]:
        """All lines of a key, from the first block that can hold it."""
        k = bisect_right(self._first, key) - 1
        while k > 0 and self._first[k] == key:
            k -= 1  # lines of the key may have begun in the block before
        for b in range(max(k, 0), len(self.directory)):
            if self._first[b] > key:
                return
            lines = self._block(b)
            lo, hi = 0, len(lines)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if lines[mid][0] < key else (lo, mid)
            while lo < len(lines) and lines[lo][0] == key:
                yield lines[lo]
                lo += 1
            if lo < len(lines):
                return

    def close(self) -> None:
        self._file.close()


def lookup(keys: DataFrame, archive: Archive) -> DataFrame:
    """page_id, file, offset, length of the records of every different key (column key, as of index_key())."""
    shards, root = archive.shards, archive.root
    firsts = [s[0] for s in shards]

    @F.pandas_udf("array<int>")
    def candidates(key):  # the shard that the key falls in, and those before that end with it
        def of(k: str) -> list[int]:
            hi = bisect_right(firsts, k) - 1
            lo = hi
            while lo > 0 and firsts[lo] == k:
                lo -= 1
            return list(range(max(lo, 0), hi + 1))

        return pd.Series([of(k) for k in key])

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        is_open, shard = -1, None
        for k, key in rows:
            if k != is_open:
                if shard:
                    shard.close()
                shard, is_open = Shard(root, *shards[k][1:]), k
            for line in shard.find(key):
                yield tuple(line[1:])
        if shard:
            shard.close()

    asked = keys.select("key").where("key is not null").distinct().select("key", F.explode(candidates("key")).alias("shard"))
    asked = asked.repartition(max(1, min(len(shards), 20_000)), "shard").sortWithinPartitions("shard", "key")
    return map_rows(asked.select("shard", "key"), "page_id long, file string, offset long, length long", run)


def read(places: DataFrame, archive: Archive) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of records by their places.

    A response's digest is taken from the payload that was read.  A revisit's payload is null; its length and
    digest are those that it states.
    """
    root = archive.root

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        fs, top = filesystem(root)
        name, file = None, None
        for f, offset, length in rows:
            if f != name:
                if file:
                    file.close()
                name, file = f, fs.open_input_file(f"{top}/{f}")
            warc, http, payload = parse(_gunzip(file.read_at(length, offset)))
            page_id, url, kind = _page_of(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"]
            if kind == "revisit":
                yield page_id, url, None, int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"), kind, _page_of(warc["warc-refers-to"])
            else:
                yield page_id, url, payload, len(payload), digest32(payload), kind, None
        if file:
            file.close()

    # places are few bytes and much to read: they are dealt out by what is to be read, each stretch of an archive to one task
    n, size = archive.lines.agg(F.count("*"), F.sum("length")).first()
    tasks = min(max(1, -(-n // READ_RECORDS), -(-(size or 0) // READ_BYTES)), 20_000)
    stretch = F.floor(F.col("offset") / F.lit(max(1, (size or 0) // (4 * tasks)))) if tasks > 1 else F.lit(0)
    ordered = places.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return map_rows(ordered, schema, run)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive pages, then look every page up by URL and id and read its record back; a row per page."""
    archive = write(pages, min_bytes)

    @F.pandas_udf("string")
    def key_of(url, page_id):
        return pd.Series([index_key(u, None if pd.isna(p) else int(p)) for u, p in zip(url, page_id)])

    keys = pages.select(key_of("url", F.col("page_id").cast("decimal(20,0)")).alias("key"))
    return read(lookup(keys, archive), archive)
