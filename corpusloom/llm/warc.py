"""Operator 9: a WARC reader that salvages what damage leaves.

A file is read from its start, record by record; a record is a gzip member or stands plain.  A record is checked: the
member's own checksum, the version line, the header (lines that begin with a space go on with the one before),
Content-Length, the end mark and, where the header has one, the digest of the block (SHA-1, SHA-256 or MD5; others aren't
checked).  When a check fails the reader searches from the next byte for a place that starts a valid
record (a gzip member, or a version line), takes up reading there, and logs the bytes between as a quarantined gap.  A
place in damaged bytes that only looks like a start fails its own checks and the search goes on.

Plan.  Tasks get (path, length) of files, never their bytes through Spark's rows; a task reads its files from the shared
file system by blocks, with memory for one record and one block.  What a record says of its length is believed once its
end mark stands there, and a record of over ``MOST`` bytes, unzipped, is a gap: a Spark row couldn't hold it.  Files are spread over the tasks by size by the file
source.  Nothing is shuffled.

Defined results: an empty file has neither records nor gaps.  A file without any valid record is one gap.  Bytes of an
unfinished last record are a gap up to the end of the file.  Line ends between records are no gap.  A record
without a target address has a null one.  Equal records are all returned.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh

BLOCK, HEADER, MOST = 1 << 20, 1 << 20, 1 << 30
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
SCHEMA = "file string, kind string, start long, length long, reason string, type string, record_id string, url string, date string, block binary"
_FIELDS = [("file", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("block", pa.binary())]
#: Bytes of rows that go back to Spark at a time, about.
BATCH = 4 << 20


class Damage(ValueError):
    pass


def parsed(data: bytes, whole: bool) -> tuple[dict[str, str], bytes, int]:
    """Header, block and length in bytes of the record at the start of ``data``; ``whole``: there must be nothing after it."""
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n")):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise Damage("header without end")
    header: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data[10:end]).split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("header line without colon")
        header[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not re.fullmatch(r"[0-9]{1,18}", size := header.get("content-length", "")):
        raise Damage("no Content-Length")
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise Damage("no end mark where Content-Length says")
    if whole and len(data) != stop + 4:
        raise Damage("bytes after the record")
    block = data[start:stop]
    how, _, said = header.get("warc-block-digest", "").partition(":")
    if how.lower() in ("sha1", "sha256", "md5"):
        found = hashlib.new(how.lower(), block, usedforsecurity=False).digest()
        if said.upper().rstrip("=") not in (base64.b32encode(found).decode().rstrip("="), found.hex().upper()):
            raise Damage("digest differs")
    return header, block, stop + 4


class File:
    """Random reads of one file through a block that is kept."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, size: int):
        self.handle, self.size, self.at, self.have = fs.open_input_file(path), size, 0, b""

    def read(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if not (self.at <= start and start + n <= self.at + len(self.have)):
            self.at, self.have = start, self.handle.read_at(min(max(n, BLOCK), self.size - start), start)
        return self.have[start - self.at : start - self.at + n]

    def glance(self, start: int, n: int) -> bytes:
        """A few bytes, without giving up the block that is kept."""
        if self.at <= start and start + n <= self.at + len(self.have):
            return self.read(start, n)
        return self.handle.read_at(max(0, min(n, self.size - start)), start)

    def member(self, start: int) -> tuple[dict[str, str], bytes, int]:
        unzip, parts, at, held = zlib.decompressobj(31), [], start, 0
        try:
            while not unzip.eof:
                if not (some := self.read(at, 1 << 16)):
                    raise Damage("member without end")
                parts.append(unzip.decompress(some, MOST - held + 1))
                held += len(parts[-1])
                if held > MOST:
                    raise Damage("record too long")
                if len(parts) == 1 and not (parts[0] or b"WARC/").startswith(b"WARC/"[: len(parts[0]) or 5]):
                    raise Damage("no version line")
                at += len(some)
        except zlib.error as e:
            raise Damage("gzip: " + str(e).rpartition(": ")[2]) from None
        header, block, _ = parsed(b"".join(parts), True)
        return header, block, at - len(unzip.unused_data) - start

    def plain(self, start: int) -> tuple[dict[str, str], bytes, int]:
        n = 4096
        while (end := (data := self.read(start, n)).find(b"\r\n\r\n")) < 0:
            if n >= min(HEADER, self.size - start):
                raise Damage("header without end")
            n *= 4
        size = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", data[:end].replace(b"\r\n", b"\n"))
        if size is None:
            raise Damage("no Content-Length")
        stop = start + end + 4 + int(size[1])
        if stop + 4 > self.size:
            raise Damage("record goes past the file's end")
        if int(size[1]) > MOST:
            raise Damage("record too long")
        if self.glance(stop, 4) != b"\r\n\r\n":
            raise Damage("no end mark where Content-Length says")
        return parsed(self.read(start, stop + 4 - start), False)

    def record(self, start: int) -> tuple[dict[str, str], bytes, int]:
        head = self.read(start, 10)
        if head.startswith(b"\x1f\x8b\x08"):
            return self.member(start)
        if head.startswith(b"WARC/"):
            return self.plain(start)
        raise Damage("no start of a record")

    def next_start(self, start: int) -> int:
        """The next place from ``start`` on that looks like a record's start; the file's end if there is none."""
        while start < self.size:
            data = self.read(start, BLOCK)
            if found := START.search(data):
                return start + found.start()
            if start + len(data) >= self.size:
                break
            start += len(data) - 9  # a start may lie across two blocks
        return self.size


def salvaged(file: File, name: str) -> Iterator[tuple]:
    """Rows of SCHEMA: the records and gaps of a file in order."""
    at, gap = 0, None
    while at < file.size:
        if gap is None and file.read(at, 1) in (b"\r", b"\n"):
            at += 1
            continue
        try:
            header, block, length = file.record(at)
        except Damage as e:
            if gap is None:
                gap = (at, str(e))
            at = file.next_start(at + 1)
            continue
        if gap is not None:
            yield name, "gap", gap[0], at - gap[0], gap[1], None, None, None, None, None
            gap = None
        yield name, "record", at, length, None, header.get("warc-type"), header.get("warc-record-id"), header.get("warc-target-uri"), header.get("warc-date"), block
        at += length
    if gap is not None:
        yield name, "gap", gap[0], file.size - gap[0], gap[1], None, None, None, None, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of the files ``*.warc`` and ``*.warc.gz`` in ``path``, which every executor must reach under the same name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                fs, inner = pyarrow.fs.FileSystem.from_uri(name)
                rows, held = [], 0
                for row in salvaged(File(fs, inner, size), name.rpartition("/")[2]):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("path", "length").mapInArrow(read, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def record_bytes(page_id: int | None, url: str | None, html: str | None) -> bytes:
    block = (html or "").encode()
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", "Content-Type: text/html", f"Content-Length: {len(block)}", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def harm(page_id: int | None) -> str:
    """What ``write_warc`` does to the record of a page when it is told to damage some, by a digest of page_id."""
    n = int(hashlib.md5(str(page_id).encode()).hexdigest()[:2], 16)
    return "changed" if n < 8 else "cut" if n < 12 else "junk before" if n < 16 else ""


def write_warc(pages: DataFrame, path: str, damage: bool = False) -> None:
    """A WARC file for each input partition, every fourth one plain and the others gzip member by member.

    A file is written under a name of its attempt and then renamed, so a repeated task leaves one whole file.
    """

    there, inside = pyarrow.fs.FileSystem.from_uri(path)
    there.create_dir(inside, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(f"{inner}/_attempts", recursive=True)
        plain = part % 4 == 0
        name, n = f"part-{part:06d}.warc" + ("" if plain else ".gz"), 0
        tried = f"{inner}/_attempts/{task.taskAttemptId()}-{name}"
        with fs.open_output_stream(tried, compression=None) as out:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    data = record_bytes(*row)
                    if not plain:
                        zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = zipped.compress(data) + zipped.flush()
                    what = harm(row[0]) if damage else ""
                    if what == "changed":
                        middle = len(data) - 12 if plain else len(data) * 2 // 3
                        data = data[:middle] + bytes([data[middle] ^ 0x55]) + data[middle + 1 :]
                    elif what == "cut":
                        data = data[: len(data) // 2]
                    elif what == "junk before":
                        data = b"\x00junk\x1f\x8b\x08 that is no member, WARC/1.0\r\n and no record\xff" + data
                    out.write(data)
                    n += 1
        try:
            fs.move(tried, f"{inner}/{name}")
        except OSError:  # some file systems don't replace; another attempt of this task has put the same file there
            if fs.get_file_info(f"{inner}/{name}").type != pyarrow.fs.FileType.File:
                raise
            fs.delete_file(tried)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    pages.select(F.col("page_id").try_cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def round_trip(pages: DataFrame) -> DataFrame:
    """(kind, page_id, url, html, file, start, length, reason): the pages, written as WARC files with some damage, as they are salvaged.

    The driver's tables have no WARC files.  Of a page's record that is changed or cut nothing is left but a gap.
    """
    path = fresh(pages.sparkSession, "warc")
    write_warc(pages, path, damage=True)
    found = read_warc(pages.sparkSession, path)
    page = F.nullif(F.regexp_extract("record_id", "<urn:page:([0-9-]*)>", 1), F.lit("")).cast("long")
    return found.select("kind", page.alias("page_id"), "url", F.decode("block", "UTF-8").alias("html"), "file", "start", "length", "reason")
