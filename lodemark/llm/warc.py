"""WARC archives with a two-level capture index.

Pages are written as records of one gzip member each. Equal payloads are stored once: the page of
smallest id is the response, the others are revisits that name it. Captures are sorted by their URL
key (host reversed) and written in compressed blocks of lines; a sparse directory keeps the first and
last key of each block. A lookup finds the index file by its key range, the blocks in the directory and
the lines in a block by binary search, and then reads one byte range of one archive. Many keys are
looked up together: they meet the directory of their index file in one task each.

Files are written below the shared folder through its own file system. A task names its files by a
random suffix and reports what it wrote, so a repeated or speculative attempt leaves files that
nothing refers to, never half a result.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.session import cut, discard, work_dir

BLOCK_LINES = 300
FILE_BYTES = 1 << 30
INDEX_ROWS = 100_000  # captures of an index file
READ_BYTES = 64 << 20  # stored bytes that one task reads back
MAX_INDEX_FILES = 200_000  # key ranges that a task may hold to find the file of a key
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "urlkey string, page_id long, file string, offset long, length long"
BLOCK = "first_key string, last_key string, file string, offset long, length long, lines int"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; scheme, www, fragment and default ports go."""
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)", (url or "").strip(), re.S)
    if not m:
        return ")" + (url or "").strip().split("#")[0].lower()
    labels = m[1].lower().removeprefix("www.").split(".")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(labels)) + port + ")" + ((m[3] or "/").rstrip("/").lower() or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record, compressed."""
    mark = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{mark}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        head.insert(4, "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record; the payload of a response is checked."""
    raw = gzip.decompress(member)
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    lines = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "response" and "sha1:" + digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match")
    return fields, lines, payload


def _row(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, http, payload = parse(member)
    page = fields["WARC-Record-ID"][10:-1]
    to = fields.get("WARC-Refers-To")
    size = len(payload) if to is None else int(http["Content-Length"])
    return int(page) if page else None, size, fields["WARC-Payload-Digest"][5:], fields["WARC-Type"], int(to[10:-1]) if to else None


def _writer(folder: str, file_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    fs.create_dir(path, recursive=True)
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                member = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), to.as_py(), revisit.as_py())
                out.write(member)
                rows.append((url_key(url.as_py()), page_id.as_py(), f"{folder}/{name}", at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["urlkey", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return run


def _indexer(folder: str, lines: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pafs.FileSystem.from_uri(folder)
        out, name, at, block, done = None, f"captures-{uuid.uuid4().hex}.gz", 0, [], []

        def flush() -> None:
            nonlocal out, at
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            packed = gzip.compress("\n".join(json.dumps(x) for x in block).encode(), 4, mtime=0)
            out.write(packed)
            done.append((block[0][0], block[-1][0], f"{folder}/{name}", at, len(packed), len(block)))
            at += len(packed)
            block.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("urlkey", "page_id", "file", "offset", "length")), strict=True):
                block.append(row)
                if len(block) == lines:
                    flush()
        if block:
            flush()
        if out is not None:
            out.close()
        if done:
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["first_key", "last_key", "file", "offset", "length", "lines"])

    return run


class _Files:
    """Byte ranges of files; the last file stays open."""

    def __init__(self):
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            fs, path = pafs.FileSystem.from_uri(name)
            self.name, self.file = name, fs.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name = self.file = None


def _block_lines(packed: bytes) -> list[list]:
    return [json.loads(x) for x in gzip.decompress(packed).decode().split("\n")]


def _open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
            rows = _block_lines(files.read(name, offset, length))
            yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["file", "offset", "length"])
    files.close()


def _open_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files = _Files()
    for batch in batches:
        rows = [_row(files.read(*x)) for x in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True)]
        if rows:
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    files.close()


def _router(los: list[str], his: list[str], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, files = [], []
            for key in batch.column("urlkey").to_pylist():
                for i in range(bisect.bisect_left(his, key), bisect.bisect_right(los, key)):
                    keys.append(key)
                    files.append(names[i])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string())], ["urlkey", "file"])

    return run


def _find_lines(asked: pa.Table, blocks: pa.Table) -> pa.Table:
    """Captures of the asked keys of one index file: blocks by binary search in the directory, lines by binary search in the block."""
    rows = sorted(zip(*(blocks.column(c).to_pylist() for c in ("offset", "first_key", "last_key", "file", "length")), strict=True))
    firsts, lasts = [r[1] for r in rows], [r[2] for r in rows]
    wanted: dict[int, list[str]] = {}
    for key in asked.column("urlkey").to_pylist():
        for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
            wanted.setdefault(i, []).append(key)
    files, out = _Files(), []
    for i, keys in sorted(wanted.items()):
        lines = _block_lines(files.read(rows[i][3], rows[i][0], rows[i][4]))
        have = [x[0] for x in lines]
        for key in keys:
            out += lines[bisect.bisect_left(have, key) : bisect.bisect_right(have, key)]
    files.close()
    cols = list(zip(*out, strict=True)) if out else [()] * 5
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["urlkey", "page_id", "file", "offset", "length"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], ["urlkey"])


def url_keys(pages: DataFrame) -> DataFrame:
    """(urlkey) of the URLs of ``pages``, each once."""
    return pages.select(F.col("url").cast("string").alias("url")).mapInArrow(_keys, "urlkey string").distinct()


class Archive:
    """Archives with their capture index below ``folder``; ``stored`` is the number of bytes of all records."""

    def __init__(self, spark: SparkSession, folder: str, directory: DataFrame, stored: int):
        self.spark, self.folder, self.directory, self.stored = spark, folder, directory, stored

    def captures(self) -> DataFrame:
        """(file, offset, length) of all captures, from all blocks of the index."""
        n = self.spark.sparkContext.defaultParallelism
        return self.directory.repartition(n, "file", "offset").mapInArrow(_open_blocks, "file string, offset long, length long")

    def find(self, keys: DataFrame) -> DataFrame:
        """(urlkey, page_id, file, offset, length) of the captures under ``keys`` (urlkey, each once).

        The key ranges of the index files, one for ``INDEX_ROWS`` captures, are the only thing that the
        driver sees; their number is checked.
        """
        ranges = self.directory.groupBy("file").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
        files = ranges.orderBy("lo", "hi").limit(MAX_INDEX_FILES + 1).collect()
        if len(files) > MAX_INDEX_FILES:
            raise ValueError("too many index files; write them with more captures each")
        route = _router([r["lo"] for r in files], [r["hi"] for r in files], [r["file"] for r in files])
        asked = keys.mapInArrow(route, "urlkey string, file string")
        return asked.groupBy("file").cogroup(self.directory.groupBy("file")).applyInArrow(_find_lines, CAPTURE)

    def read(self, captures: DataFrame) -> DataFrame:
        """A row for each capture, parsed from its byte range; tasks are dealt by stored bytes, neighbours together."""
        parts = max(self.spark.sparkContext.defaultParallelism, -(-self.stored // READ_BYTES))
        near = captures.select("file", "offset", "length", F.expr("shiftright(offset, 22)").alias("_part"))
        near = near.repartition(parts, "file", "_part").sortWithinPartitions("file", "offset")
        return near.select("file", "offset", "length").mapInArrow(_open_records, RESULT)

    def read_back(self) -> DataFrame:
        """A row for each record of the archives."""
        return self.read(self.captures())

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Records (headers, payload as stored) captured under a URL: directory, block, lines, byte range."""
        key, files, out = url_key(url), _Files(), []
        blocks = self.directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect()
        for b in blocks:
            lines = _block_lines(files.read(b["file"], b["offset"], b["length"]))
            keys = [x[0] for x in lines]
            for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                fields, _, payload = parse(files.read(x[2], x[3], x[4]))
                out.append((fields, payload))
        files.close()
        return out


def write_archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, block_lines: int = BLOCK_LINES, file_bytes: int = FILE_BYTES) -> Archive:
    """Write ``pages`` (page_id, url, html) as records, and their index.

    A null html is an empty payload. Among equal payloads of at least ``min_bytes`` the rows of the
    smallest page_id are responses and all others revisits; rows that repeat that page_id are all
    responses. A null page_id is never referred to: alone with its payload it is a response. A null
    url has no target and sorts first. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_d", F.sha1("html")).withColumn("_n", F.octet_length("html"))
    first = rows.where(F.col("_n") >= min_bytes).groupBy("_d", "_n").agg(F.min("page_id").alias("_first"))
    rows = rows.join(first, ["_d", "_n"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    rows = rows.select("page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))
    captures = cut(rows.mapInArrow(_writer(f"{folder}/archive", file_bytes), CAPTURE))
    size = captures.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    files = max(spark.sparkContext.defaultParallelism, -(-size["n"] // INDEX_ROWS))
    ordered = captures.repartitionByRange(files, "urlkey", "page_id", "offset").sortWithinPartitions("urlkey", "page_id", "file", "offset")
    directory = cut(ordered.mapInArrow(_indexer(f"{folder}/index", block_lines), BLOCK))
    discard(captures)
    return Archive(spark, folder, directory, size["bytes"])


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives written:
    every URL of ``pages`` is looked up in the index.

    Nulls, empty and repeated rows are treated as ``write_archive`` says: each row of ``pages`` is one
    record, so repeated rows come back as often; an empty table gives an empty result.
    """
    archive = write_archive(pages)
    return archive.read(archive.find(url_keys(pages)))
