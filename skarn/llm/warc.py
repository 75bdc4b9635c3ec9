"""WARC archives with a two-level capture index.

``write_archive`` deals the pages by range of their reversed-host key (``com,example)/path``)
and each task writes one archive file (gzip, one member per record), beside it one index
file and one directory file:

* index: capture lines ``key, page id, offset, length`` in key order, in zlib blocks of
  ``block_lines`` lines;
* directory: for each block its first key, offset and length - one entry per block.

``lookup`` deals queries to shards by the shards' key ranges, binary-searches the shard's
directory, then range-reads and binary-searches the few blocks that can hold the key, and
range-reads the records.  ``read_archive`` reads every capture through the index.

Revisits: records whose payloads have equal digests point to the one with the smallest
page id.  That join is on the digest with one row per page and no payload; Spark splits a
digest that a third of the pages share.  Payloads are moved once, by the range sort.

Files are written by name of task attempt and listed in the returned table only when the
task has ended, so a lost executor leaves unlisted files and no damage.

Defined results: null html is an empty payload; a null or empty url is kept under the key
``)/``; a null page_id is larger than all others (of payloads known under null ids only,
every record is a response); rows that repeat a page_id are all written, each with its own
payload's digest; records of the smallest id with an equal payload are all responses; an
empty table gives an archive of no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._jobs import arrow_stage, fresh_dir, text_of, written

BLOCK_LINES = 256
MANIFEST = "shard bigint, file string, index string, directory string, first_key string, last_key string, records bigint, blocks bigint"


def surt(url: Column) -> Column:
    """The reversed-host key of a URL: ``https://www.a.org/x?y#z`` -> ``org,a)/x?y``."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^[^@]*@", ""), r":(80|443)?$", "")
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    path = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\d*\.", ""), r"\.")), ","), F.lit(")"), path)


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        # a URL with a line break or other control would end the header; it is escaped
        f"WARC-Target-URI: {json.dumps(url)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (names in lower case) and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(out["content-length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return out | {"body": rest[:n]}


class _Shard:
    """Writes one archive file with its index and directory."""

    def __init__(self, base: str, block_lines: int):
        self.base, self.block_lines = f"{base}/{uuid.uuid4().hex}", block_lines
        self.fs, self.path = _fs(self.base)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = {x: self.fs.open_output_stream(self.path + x, compression=None) for x in (".warc.gz", ".idx", ".dir")}
        self.at = self.index_at = self.records = self.blocks = 0
        self.lines: list[tuple[str, str]] = []
        self.first = self.last = ""

    def add(self, key: str, page_id: int | None, record: bytes) -> None:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        raw = packer.compress(record) + packer.flush()
        self.out[".warc.gz"].write(raw)
        self.lines.append((key, json.dumps([key, page_id, self.at, len(raw)])))
        self.at += len(raw)
        self.first = key if not self.records else self.first
        self.last = key
        self.records += 1
        if len(self.lines) >= self.block_lines:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            raw = zlib.compress("\n".join(x for _, x in self.lines).encode())
            self.out[".idx"].write(raw)
            self.out[".dir"].write((json.dumps([self.lines[0][0], self.index_at, len(raw)]) + "\n").encode())
            self.index_at += len(raw)
            self.blocks += 1
            self.lines = []

    def close(self, shard: int) -> dict:
        self.flush()
        for f in self.out.values():
            f.close()
        return {"shard": shard, "file": self.base + ".warc.gz", "index": self.base + ".idx", "directory": self.base + ".dir", "first_key": self.first, "last_key": self.last, "records": self.records, "blocks": self.blocks}


def write_archive(pages: DataFrame, min_bytes: int = 0, block_lines: int = BLOCK_LINES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", base: str | None = None) -> DataFrame:
    """Write all pages; the manifest (one row per archive file) comes back.

    Pages with payloads of ``min_bytes`` at least are deduplicated by digest.
    """
    spark = pages.sparkSession
    base = base or fresh_dir(spark, "warc")
    rows = text_of(pages, {"page_id": id_col, "url": url_col, "html": html_col})
    rows = rows.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    key = surt(F.col("url"))
    digests = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "url", "digest")
    firsts = digests.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = digests.join(firsts, "digest").where("first_id IS NOT NULL AND NOT page_id <=> first_id").select(key.alias("key"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), F.col("first_id").alias("refers_to"), "digest")
    every = links.unionByName(rows.select(key.alias("key"), "page_id", "url", "html", F.lit(None).cast("bigint").alias("refers_to"), "digest"))
    # the link row (no html) of a page and digest sorts before its page row, and both fall in one range
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = every.repartitionByRange(parts, "key", "page_id", "digest").sortWithinPartitions("key", "page_id", "digest", F.col("html").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, pending, refers_to = None, None, None
        for b in batches:
            for k, page, url, html, refers, digest in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                if html is None:
                    pending, refers_to = (page, digest), refers
                    continue
                shard = shard or _Shard(base, block_lines)
                shard.add(k, page, _record(page, url, html.encode(), refers_to if pending == (page, digest) else None))
        if shard:
            row = shard.close(TaskContext.get().partitionId())
            yield pa.RecordBatch.from_pylist([row])

    return written(arrow_stage(dealt, run, MANIFEST), "warc-manifest")


def _range(fs_path: tuple[pafs.FileSystem, str], cache: dict, offset: int, length: int) -> bytes:
    fs, path = fs_path
    if path not in cache:
        if len(cache) > 16:
            cache.pop(next(iter(cache))).close()
        cache[path] = fs.open_input_file(path)
    cache[path].seek(offset)
    return cache[path].read(length)


def _directory(uri: str) -> list[list]:
    fs, path = _fs(uri)
    with fs.open_input_stream(path) as f:
        return [json.loads(x) for x in f.read().decode().splitlines()]


def _capture(line: list, file: str, cache: dict) -> dict:
    key, page, offset, length = line
    r = parse_record(zlib.decompress(_range(_fs(file), cache, offset, length), 31))
    revisit = r["warc-type"] == "revisit"
    payload = None if revisit else r["body"]
    digest = r["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and _digest(payload) != digest:
        raise ValueError(f"digest of page {page} differs")
    return {
        "key": key, "page_id": page, "url": json.loads(f'"{r["warc-target-uri"]}"'), "payload_bytes": int(r["x-payload-length"]), "payload_digest": digest,
        "record_type": r["warc-type"], "refers_to": int(r["warc-refers-to"][10:-1]) if revisit else None, "payload": payload,
    }


CAPTURE = "key string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_archive(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every capture, through the index: blocks in order, then each record's byte range."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = _directory(r["directory"])
                yield pa.RecordBatch.from_pydict({"file": [r["file"]] * len(found), "index": [r["index"]] * len(found), "at": [x[1] for x in found], "length": [x[2] for x in found]})

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            for r in b.to_pylist():
                lines = zlib.decompress(_range(_fs(r["index"]), cache, r["at"], r["length"])).decode().split("\n")
                got = [_capture(json.loads(x), r["file"], cache) for x in lines]
                if not payloads:
                    got = [x | {"payload": None} for x in got]
                yield pa.RecordBatch.from_pylist(got, schema=_CAPTURE)

    listed = arrow_stage(manifest.select("file", "index", "directory"), blocks, "file string, index string, at bigint, length bigint")
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_stage(listed.repartition(parts, "index", "at"), captures, CAPTURE)


def lookup(manifest: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each queried URL (one row per query row and capture).

    Queries meet a shard by comparing keys with the shard's first and last key, which is
    a table of one row per archive file; then directory, block and record as above.
    """
    shards = manifest.select("index", "directory", "file", "first_key", "last_key").orderBy("first_key")
    edges = [(r.first_key, r.last_key, r.file, r["index"], r.directory) for r in shards.toLocalIterator()]  # one row per file of many MB

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        directories: dict = {}
        firsts = [e[0] for e in edges]
        key_of = lambda line: json.loads(line)[0]
        for b in batches:
            got = []
            for url, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = bisect.bisect_right(firsts, key) - 1
                while shard >= 0 and edges[shard][1] >= key:
                    _, _, file, index, directory = edges[shard]
                    shard -= 1
                    if directory not in directories:
                        if len(directories) > 64:
                            directories.pop(next(iter(directories)))
                        entries = _directory(directory)
                        directories[directory] = entries, [e[0] for e in entries]
                    entries, starts = directories[directory]
                    block = max(bisect.bisect_left(starts, key) - 1, 0)
                    while block < len(entries) and starts[block] <= key:
                        _, offset, length = entries[block]
                        block += 1
                        lines = zlib.decompress(_range(_fs(index), cache, offset, length)).decode().split("\n")
                        for at in range(bisect.bisect_left(lines, key, key=key_of), len(lines)):
                            line = json.loads(lines[at])
                            if line[0] != key:
                                break
                            got.append({"query": url} | _capture(line, file, cache))
            if got:
                yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("query", pa.string()), *_CAPTURE]))

    asked = urls.select(F.col(f"`{url_col}`").alias("query"), surt(F.col(f"`{url_col}`")).alias("key"))
    return arrow_stage(asked, find, "query string, " + CAPTURE)
