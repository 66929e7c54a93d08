"""Zstandard WARC archives (operator 2).

An archive (``.warc.zst``) is a leading skippable frame that holds a
dictionary, then one Zstandard frame per record.

*Writing*: payloads are digested (SHA-1).  Of records with equal payloads
the one with the smallest id is the response, the others are revisits of it
and hold no payload.  Each task writes archives of about ``ARCHIVE_BYTES``
of records to the shared folder, each with a dictionary trained from its
own first records.  An archive gets its name only when it is whole, and the
name holds the attempt of its task: a lost or repeated attempt may leave
archives behind, but the manifest lists those of the committed attempts
only, and these are read back.

*Reading*: archives are listed by Spark and read as streams, a record at a
time.  The dictionary is loaded from the leading frame (which may itself be
compressed), each frame must hold exactly one record, and the record is
validated: version, required headers, lengths, digests.

Defined results: a null payload is empty, a null or empty url leaves out
the target header.  Rows that repeat the smallest id with the same payload
are each a response.  A row without an id is a response unless an equal
payload has an id, and ``refers_to`` never names it.  Other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import salted_left_join
from revlens.session import NO_MARKER, fresh_path

ARCHIVE_BYTES = 64 << 20
MANIFEST_ROWS = 10_000  # of a manifest's file
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
SUFFIX = ".warc.zst"
# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D  # the skippable frame that holds the dictionary
ZSTD_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive or record that does not keep to the format."""


# ---------------------------------------------------------------- files

def _file(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a path; Hadoop writes local URIs as ``file:/...``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def archives(spark: SparkSession, folder: str, manifest: str | None = None) -> DataFrame:
    """(path, length) of the archives in a folder, listed by Spark; their content is not read.

    With a ``manifest``, the path of a table as ``write_archives`` leaves
    it, only the archives that it lists.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SUFFIX).load(folder).select("path", "length")
    if manifest is None:
        return found
    listed = spark.read.parquet(manifest).select("archive").distinct()
    return found.join(listed, F.substring_index("path", "/", -1) == F.col("archive"), "left_semi")


# ---------------------------------------------------------------- records

def digest_text(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(row: int | None, payload_sha1: bytes) -> str:
    """An id that follows from the row, so that a revisit can name its response."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'row:{row}:{payload_sha1.hex()}')}>"


def build_record(row: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """A response record, or a revisit without the payload but with its length in the HTTP header."""
    sha1 = hashlib.sha1(payload).digest()
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
             + (b"" if revisit else payload))
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row, sha1)), ("WARC-Date", date)]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if row is not None:
        head.append(("WARC-Source-Row", str(row)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("WARC-Refers-To-Row", str(refers_to))]
    head += [("WARC-Payload-Digest", digest_text(sha1)), ("WARC-Block-Digest", digest_text(hashlib.sha1(block).digest())),
             ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head), b"\r\n", block, b"\r\n\r\n"])


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one whole record; raises WarcError on any fault."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("the record does not begin with a WARC version and headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header line: {name[:80]!r}")
        if name.lower() in headers and name.lower() != "warc-concurrent-to":
            raise WarcError(f"the header {name} is repeated")
        headers[name.lower()] = value.strip()
    for name in REQUIRED:
        if not headers.get(name):
            raise WarcError(f"the header {name} is missing")
    if not re.fullmatch(r"<[^<>\s]+>", headers["warc-record-id"]):
        raise WarcError("the record id is not a URI in angle brackets")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z", headers["warc-date"]):
        raise WarcError("the date is not a UTC timestamp")
    if not re.fullmatch(r"[0-9]+", headers["content-length"]):
        raise WarcError("the length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the length is {n}, but {len(rest) - 4} bytes and the end of the record follow")
    block = rest[:n]
    if (want := headers.get("warc-block-digest", "")).startswith("sha1:") and want != digest_text(hashlib.sha1(block).digest()):
        raise WarcError("the block does not have its digest")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """(payload or None for a revisit, length of the full payload) of an HTTP record."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise WarcError("the block does not begin with an HTTP header")
    found = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
    n = int(found[1]) if found else len(body)
    if headers["warc-type"] == "revisit":
        return None, n
    if n != len(body):
        raise WarcError(f"the payload has {len(body)} bytes, not {n}")
    if (want := headers.get("warc-payload-digest", "")).startswith("sha1:") and want != digest_text(hashlib.sha1(body).digest()):
        raise WarcError("the payload does not have its digest")
    return body, n


# ---------------------------------------------------------------- archive streams

def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records, or nothing when there are too few to train from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to a stream, one frame each, after a dictionary trained from the first ones."""

    def __init__(self, out: BinaryIO, level: int = 3):
        self.out, self.level, self.held, self.size, self.compressor = out, level, [], 0, None
        self.count = self.written = 0

    def add(self, record: bytes) -> None:
        self.count += 1
        self.written += len(record)
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self._begin()

    def _begin(self) -> None:
        raw = train_dictionary(self.held)
        if raw:
            self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        options = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
        self.compressor = zstandard.ZstdCompressor(level=self.level, write_checksum=True, write_content_size=True, **options)
        for record in self.held:
            self.out.write(self.compressor.compress(record))
        self.held = []

    def close(self) -> None:
        if not self.compressor:
            self._begin()


def _exactly(stream: BinaryIO, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise WarcError("the archive ends within a frame")
    return data


def records(stream: BinaryIO, block: int = 1 << 16) -> Iterator[bytes]:
    """The decoded records of an archive, one per frame, with the dictionary of its leading skippable frame."""
    head, options = stream.read(8), {}
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_MAGIC:
        raw = _exactly(stream, struct.unpack("<I", head[4:])[0])
        if raw[:4] == struct.pack("<I", ZSTD_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        options, head = {"dict_data": zstandard.ZstdCompressionDict(raw)}, b""
    decompressor, rest = zstandard.ZstdDecompressor(**options), head
    while True:
        rest = rest or stream.read(block)
        if not rest:
            return
        while len(rest) < 8 and (more := stream.read(block)):
            rest += more
        if len(rest) >= 8 and 0x184D2A50 <= struct.unpack("<I", rest[:4])[0] <= 0x184D2A5F:  # any other skippable frame
            n = 8 + struct.unpack("<I", rest[4:8])[0]
            if len(rest) < n:
                rest += _exactly(stream, n - len(rest))
            rest = rest[n:]
            continue
        frame, out = decompressor.decompressobj(), []
        try:
            while True:
                out.append(frame.decompress(rest))
                if frame.eof:
                    rest = frame.unused_data
                    break
                rest = stream.read(block)
                if not rest:
                    raise WarcError("the archive ends within a frame")
        except zstandard.ZstdError as e:
            raise WarcError(f"not a whole frame: {e}") from e
        yield b"".join(out)


# ---------------------------------------------------------------- Spark

def with_revisits(pages: DataFrame, key: str, payload: Column) -> DataFrame:
    """``pages`` with refers_to: the smallest key of the rows with an equal payload, null for that row itself."""
    rows = pages.withColumn("_sha1", F.sha1(payload)).withColumn("_size", F.octet_length(payload))
    digests = pages.select(F.col(key), F.sha1(payload).alias("_sha1"), F.octet_length(payload).alias("_size"))
    first = digests.groupBy("_sha1", "_size").agg(F.min(key).alias("_first"), F.count("*").alias("_n")) \
        .filter("_n > 1 and _first is not null").drop("_n")
    rows = salted_left_join(rows, first, ["_sha1", "_size"], F.col(key))
    return rows.withColumn("refers_to", F.when(~F.col(key).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_sha1", "_size", "_first")


def _write_task(folder: str, archive_bytes: int) -> Callable:
    def run(batches):
        files, base = _file(folder)
        task, made, writer, out, name = TaskContext.get(), 0, None, None, ""

        def finish():
            writer.close()
            out.close()
            files.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [writer.count], "bytes": [writer.written]})

        for b in batches:
            for row, url, html, refers in zip(*(b.column(i) for i in range(4))):
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{made:04d}-{task.taskAttemptId()}{SUFFIX}"
                    out, made = files.open_output_stream(f"{base}/{name}.part", compression=None), made + 1
                    writer = ArchiveWriter(out)
                refers = refers.as_py()
                writer.add(build_record(row.as_py(), url.as_py(), (html.as_py() or "").encode(), refers, refers is not None))
                if writer.written >= archive_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write every row as a record below ``folder``; the archives' names, records and bytes go to ``folder/manifest``."""
    rows = pages.select(F.col(key).cast("long").alias("row"), F.col(url).cast("string").alias("url"), F.col(payload).alias("payload"))
    rows = with_revisits(rows, "row", F.coalesce(F.col("payload"), F.lit("")).cast("binary"))
    # A first small table, so that the folder exists where the tasks write.
    spark, listed = pages.sparkSession, "archive string, records long, bytes long"
    done = rows.select("row", "url", "payload", "refers_to").mapInArrow(_write_task(folder, archive_bytes), listed)
    spark.createDataFrame([], "archive string").write.mode("ignore").options(**NO_MARKER).parquet(f"{folder}/begun")
    # One short row per archive, of each task's committed attempt: few files, not one per task.
    names = done.collect()
    spark.createDataFrame(names, listed).coalesce(1 + len(names) // MANIFEST_ROWS) \
        .write.mode("overwrite").options(**NO_MARKER).parquet(f"{folder}/manifest")


_FIELDS = ("archive string, offset long, record_type string, record_id string, target_uri string, row long, refers_to long, "
           "payload_bytes long, payload_digest string, payload binary, error string")


def _read_task(with_payload: bool, stop: bool, rows_at_once: int = 64, bytes_at_once: int = 8 << 20) -> Callable:
    names = [f.split(" ")[0] for f in _FIELDS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.split(" ")[0], types[f.split(" ")[1]]) for f in _FIELDS.split(", ")])

    def one(path: str) -> Iterator[dict]:
        files, place = _file(path)
        number = 0
        with files.open_input_stream(place, compression=None) as stream:
            try:
                for data in records(stream):
                    row = dict.fromkeys(names) | {"archive": path, "offset": number}
                    try:
                        headers, block = parse_record(data)
                        row |= {"record_type": headers["warc-type"], "record_id": headers["warc-record-id"], "target_uri": headers.get("warc-target-uri"),
                                "payload_digest": headers.get("warc-payload-digest", "").removeprefix("sha1:") or None}
                        for field, name in (("row", "warc-source-row"), ("refers_to", "warc-refers-to-row")):
                            row[field] = int(headers[name]) if name in headers else None
                        if row["record_type"] in ("response", "revisit"):
                            payload, row["payload_bytes"] = payload_of(headers, block)
                            row["payload"] = payload if with_payload else None
                    except WarcError as e:
                        if stop:
                            raise WarcError(f"{path}, record {number}: {e}") from e
                        row["error"] = str(e)
                    yield row
                    number += 1
            except WarcError as e:
                if stop:
                    raise
                yield dict.fromkeys(names) | {"archive": path, "offset": number, "error": str(e)}

    def run(batches):
        held, size = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in one(path):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if len(held) >= rows_at_once or size >= bytes_at_once:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return run


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True, on_error: str = "raise",
                  manifest: str | None = None) -> DataFrame:
    """Every record of the archives in ``folder``, or of those that a ``manifest`` lists.

    ``on_error="raise"`` stops at the first fault; ``"report"`` returns the
    faulty record with its fault in ``error``.  An archive that cannot be
    read on is reported once, after the records before.
    """
    if on_error not in ("raise", "report"):
        raise ValueError("on_error is raise or report")
    return archives(spark, folder, manifest).select("path").mapInArrow(_read_task(with_payload, on_error == "raise"), _FIELDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all rows of ``pages`` to archives in the shared folder and read these back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder, with_payload=False, manifest=f"{folder}/manifest").select(
        F.col("row").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
