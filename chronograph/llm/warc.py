"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader splits every archive into byte ranges. A task scans its range for the gzip magic, validates each candidate by
inflating its first bytes and checking for a WARC version line and headers, and owns the records that *start* inside its
range, reading past the range's end to finish the last one. After a valid member it continues at the member's end, so
compressed bytes that look like a magic are passed over; at the start of a range they fail validation.

Nothing is lost silently: an archive must begin with a member, each member must end where the next one or the file's end
is, and a record that has a header must inflate to its end. What breaks this is an error, or a row of type ``damaged``.

Both sides open files through pyarrow's filesystems. Writers write under a temporary name and rename, so a task that is
run again after a lost executor replaces its own file with equal content.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograph.llm.storage import ensure_local_parent, filesystem, local_path, make_folder

MAGIC = b"\x1f\x8b\x08"
RECORD = "archive string, offset long, record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def _clean(value: str) -> str:
    """A header value: line ends would end the header early, so they are percent-encoded."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers (with the full payload's length) but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: of the pages with equal payloads of at least ``min_bytes`` bytes,
    all but those with the largest page_id refer to it.

    A null html is an empty payload. Pages that share the largest id are all responses, and so are those of a group
    without any id. Digests are counted before they are joined, so a payload that a third of the pages share is one row
    of the small side and its pages are split over many tasks.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    groups = base.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("g"), "first")
    x = base.join(groups, F.col("sha1") == F.col("g"), "left")
    return x.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", flush_bytes: int = 4 << 20) -> None:
    """Write a record for each page into archives below ``path``, one per task; memory holds one record and a buffer."""

    def write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/part-{task.partitionId():06d}.warc.gz"
        fs, target = filesystem(name)
        temp, out, buffered, n = f"{target}.{task.taskAttemptId()}.tmp", None, bytearray(), 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i) for i in range(4)), strict=True):
                payload = html.as_buffer().to_pybytes()
                buffered += encode_record(page_id.as_py(), url.as_py(), payload, digest_of(payload), refers_to.as_py(), date)
                n += 1
                if len(buffered) >= flush_bytes:
                    out = out or _create(fs, name, temp)
                    out.write(bytes(buffered))
                    buffered.clear()
        if n:
            out = out or _create(fs, name, temp)
            out.write(bytes(buffered))
            out.close()
            os.replace(temp, target) if local_path(name) else fs.move(temp, target)
        yield pa.RecordBatch.from_pydict({"records": pa.array([n], pa.int64())})

    make_folder(pages.sparkSession, path)  # an empty table leaves an empty folder
    planned(pages, min_bytes).mapInArrow(write_part, "records long").agg(F.sum("records")).collect()


def _create(fs, name: str, temp: str):
    ensure_local_parent(os.path.dirname(name))
    return fs.open_output_stream(temp)


def _header(head: bytes) -> dict[str, str] | None:
    """The named fields of a record's first bytes, or None if they are not a WARC header."""
    if not head.startswith(b"WARC/"):
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return fields if {"warc-type", "content-length"} <= fields.keys() else None


class Damaged(ValueError):
    """A record that can't be read whole."""


class _Window:
    """Reads forward through a file, keeping a bounded stretch of it."""

    def __init__(self, file, size: int, step: int = 1 << 20):
        self.file, self.size, self.step, self.at, self.data = file, size, step, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        if not (self.at <= pos and pos + n <= self.at + len(self.data)):
            self.file.seek(pos)
            self.at, self.data = pos, self.file.read(min(max(n, self.step), max(0, self.size - pos)))
        return self.data[pos - self.at : pos - self.at + n]


def _member(window: _Window, pos: int, whole: bool = True) -> tuple[dict[str, str], bytes, int] | None:
    """The header, block and end of the gzip member at ``pos``; None if there is no valid record. A record with a valid
    header that is cut short, does not inflate or is shorter than its header says is a Damaged error. Unless ``whole``, the
    header is enough."""
    z, parts, head, at, got = zlib.decompressobj(31), [], None, pos, b""
    while not z.eof:
        raw = window.get(at, 1 << 14 if head is None else 1 << 18)
        try:
            data = z.decompress(raw) if raw else None
        except zlib.error:
            data = None
        if data is None:
            if head is None:
                return None
            raise Damaged
        at += len(raw)
        if head is None:
            got += data
            if len(got) >= 5 and not got.startswith(b"WARC/"):
                return None
            before, mark, rest = got.partition(b"\r\n\r\n")
            if mark:
                if (head := _header(before)) is None:
                    return None
                if not whole:
                    return head, rest, at
                parts.append(rest)
        else:
            parts.append(data)
    if head is None:
        return None
    block = b"".join(parts)
    if len(block) < int(head["content-length"]):
        raise Damaged
    return head, block[: int(head["content-length"])], at - len(z.unused_data)


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """The records that start in [start, end): offset, header and block; the header is None for damage: a record that
    can't be read whole, or bytes other than a record at the file's start or after a record, wherever that ends."""
    window, pos, bound = _Window(file, size), start, start == 0 and size > 0
    while pos < end or bound and pos < size:
        if bound:  # a member must start here
            try:
                record = _member(window, pos, pos < end)
            except Damaged:
                record = None
            if record is None:
                yield pos, None, b""
                pos, bound = pos + 1, False
            elif pos >= end:
                return  # the next range's own
            else:
                yield pos, record[0], record[1]
                pos = record[2]
            continue
        stretch = window.get(pos, min(1 << 16, end - pos + len(MAGIC) - 1, size - pos))
        found = stretch.find(MAGIC)
        if found < 0:
            pos += max(1, len(stretch) - len(MAGIC) + 1)
            continue
        pos += found
        if pos >= end:
            return
        try:
            record = _member(window, pos)
        except Damaged:
            yield pos, None, b""
            record = None
        if record is None:
            pos += 1
            continue
        yield pos, record[0], record[1]
        pos, bound = record[2], True


def _row(archive: str, offset: int, head: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    payload, length = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if head["warc-type"] == "revisit" and (m := re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)):
            length = int(m[1])
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if head["warc-type"] == "response" and digest != (found := digest_of(payload)):
        if digest is not None:
            raise ValueError(f"{archive} at {offset}: the payload's digest is {found}, the header says {digest}")
        digest = found
    return archive, offset, head.get("warc-record-id"), head["warc-type"], head.get("warc-target-uri"), digest, length, head.get("warc-refers-to"), payload if with_payload else None


def read(spark: SparkSession, path: str, split_bytes: int = 8 << 20, with_payload: bool = True, damaged: str = "error") -> DataFrame:
    """The records of the archives below ``path``, in RECORD's columns; no archives give no rows.

    Record order within an archive is its offset. A response whose payload does not match its digest is an error, and so
    is a damaged place of an archive; with ``damaged="rows"`` the latter is a row with its offset and the record_type
    ``damaged``, and reading goes on at the next record. Repeated records, and records without an id, each give their row.
    """
    if damaged not in ("error", "rows"):
        raise ValueError(f"damaged is error or rows, not {damaged}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path", "start")

    def read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "offset", "record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for uri, length, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, local = filesystem(uri)
                with fs.open_input_file(local) as file:
                    for offset, head, block in records_in(file, length, start, min(length, start + split_bytes)):
                        if head is None and damaged == "error":
                            raise Damaged(f"{uri} at {offset}: no whole record")
                        rows.append((uri, offset, None, "damaged", *[None] * 5) if head is None else _row(uri, offset, head, block, with_payload))
                        held += len(block) if with_payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pack()
                            rows, held = [], 0
        if rows:
            yield pack()

    return ranges.mapInArrow(read_part, RECORD)


def page_id_of(column: str) -> Column:
    """The page number in a record id that :func:`write` made; null where the page had none."""
    return F.expr(f"try_cast(nullif(regexp_extract({column}, '<urn:page:(-?[0-9]*)>', 1), '') as bigint)")
