"""WARC archives in Zstandard form: a dictionary in a leading skippable frame, then one frame for each record.

``write_archives`` writes a record per page and a manifest of the finished files; ``read_archives``
takes such files (or any that follow the same layout), loads the dictionary, decodes frame after
frame, and validates version line, headers, block length, trailer and payload digest. A record that
fails is returned with its reason in ``error``.

Defined results: null html is an empty payload; pages with null id are written under an id of
their own kind and never referred to; of pages that share both id and payload each is a response; an empty table
gives no archive and no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import fresh_path, picked, stored, text_rows

# Fixed values of the formats: Zstandard's skippable and data frame magics, and WARC's revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A task starts a new archive after so many bytes of records.
ARCHIVE_BYTES = 32 << 20
#: Pages that the dictionary is trained on, at most, and its size.
DICTIONARY_PAGES, DICTIONARY_BYTES = 256, 32 << 10
READ_BYTES = 1 << 20
FEED_BYTES = 1 << 14
PAGE, NO_PAGE = "urn:page:", "urn:nopage:"

RECORD_DDL = "record_id string, record_type string, uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame, html_column: str = "html") -> bytes:
    """A dictionary from at most ``DICTIONARY_PAGES`` pages; empty where they are too few to train on."""
    body = F.col(html_column).cast("binary")
    sample = pages.where(F.octet_length(html_column).between(256, 1 << 16)).select(body.alias("b")).limit(DICTIONARY_PAGES).collect()
    samples = [bytes(r.b) for r in sample]
    if len(samples) < 32:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _clean(value: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record_bytes(record_id: str, uri: str, payload: bytes, date: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that keeps the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Writes archives next to each other under a folder; names hold a random part, so attempts of a task never meet."""

    def __init__(self, folder: str, dictionary: bytes, level: int = 3):
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.folder, self.dictionary = folder, dictionary
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True)
        self.out = None

    def _open(self) -> None:
        self.name, self.raw, self.count = f"pages-{uuid.uuid4().hex}.warc.zst", 0, 0
        self.fs.create_dir(self.base, recursive=True)
        self.out = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None)
        if self.dictionary:
            packed = zstandard.ZstdCompressor(level=9).compress(self.dictionary)
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)

    def add(self, record: bytes) -> tuple[str, int] | None:
        """Writes one record; gives path and records of an archive that is full."""
        if self.out is None:
            self._open()
        self.out.write(self.compressor.compress(record))
        self.raw += len(record)
        self.count += 1
        return self.close() if self.raw >= ARCHIVE_BYTES else None

    def close(self) -> tuple[str, int] | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        return f"{self.folder}/{self.name}", self.count


def _frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive; the dictionary, if there is one, comes from the leading skippable frame."""
    buffered = b""
    decompressor = zstandard.ZstdDecompressor()
    first = True
    while True:
        if len(buffered) < 8:
            buffered += stream.read(READ_BYTES)
        if not buffered:
            return
        if len(buffered) < 8:
            raise ValueError("truncated frame header")
        magic, size = struct.unpack("<II", buffered[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            while len(buffered) < 8 + size:
                more = stream.read(max(READ_BYTES, 8 + size - len(buffered)))
                if not more:
                    raise ValueError("truncated skippable frame")
                buffered += more
            content, buffered = buffered[8 : 8 + size], buffered[8 + size :]
            if first and magic == SKIPPABLE_MAGIC:
                if content[:4] == FRAME_MAGIC:
                    content = zstandard.ZstdDecompressor().decompress(content)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
            first = False
            continue
        first = False
        one, parts, at = decompressor.decompressobj(), [], 0
        while not one.eof:
            if at >= len(buffered):
                buffered, at = stream.read(READ_BYTES), 0
                if not buffered:
                    raise ValueError("truncated frame")
            piece = buffered[at : at + FEED_BYTES]
            parts.append(one.decompress(piece))
            at += len(piece)
        buffered = buffered[at - len(one.unused_data) :]
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """The fields of one record; ``error`` says what is wrong with it, or is null."""
    out = dict.fromkeys(("record_id", "record_type", "uri", "date", "refers_to", "payload_digest", "payload_bytes", "payload", "error"))
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC version line"}
    fields = {k.strip().lower(): v.strip() for k, mark, v in (x.partition(":") for x in lines[1:]) if mark}
    out |= {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None}
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        return out | {"error": "missing " + ", ".join(missing)}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        return out | {"error": "block length differs from Content-Length"}
    if rest[-4:] != b"\r\n\r\n":
        return out | {"error": "no record trailer"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap:
        return out | {"error": "no HTTP head"}
    told = [x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "response":
        if told and told[0] != str(len(payload)).encode():
            return out | {"error": "payload length differs from HTTP Content-Length"}
        found = sha1_base32(payload)
        if digest and digest != found:
            return out | {"error": "payload digest differs"}
        return out | {"payload_digest": found, "payload_bytes": len(payload), "payload": payload}
    return out | {"payload_digest": digest or None, "payload_bytes": int(told[0]) if told and told[0].isdigit() else None}


def page_urn(page) -> str:
    """The record id of a page; a page without id has one of its own, which no text can equal."""
    return NO_PAGE if page is None else PAGE + quote(str(page), safe="")


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Writes a record for each page and returns the stored manifest (path, records) of the finished archives.

    The first page of each group of equal payloads is found by a partial aggregation on SHA-256; only
    groups of two or more are joined back, narrow on one side, so that a hot payload can be split.
    """
    pages = picked(pages, id_column, url_column, html_column)
    body = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).alias("page"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), body.alias("body")).withColumn("key", F.sha2("body", 256))
    groups = rows.where(F.octet_length("body") >= min_revisit_bytes).groupBy("key").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    firsts = stored(groups.select(F.col("key").alias("first_key"), "first"), "warc-firsts")
    dictionary = train_dictionary(pages, html_column)
    joined = text_rows(rows.join(firsts, F.col("key") == F.col("first_key"), "left"), "page", "url", "body", "first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = ArchiveWriter(folder, dictionary), []
        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                page, first, payload = page.as_py(), first.as_py(), payload.as_py()
                refers = page_urn(first) if first is not None and first != page else None
                done.append(writer.add(record_bytes(page_urn(page), url.as_py(), payload, date, refers)))
        done.append(writer.close())
        done = [x for x in done if x]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return stored(joined.mapInArrow(work, "path string, records long"), "warc-manifest")


def read_archives(paths: DataFrame, *, payloads: bool = True, tasks: int | None = None) -> DataFrame:
    """Every record of the archives named in column ``path``."""
    schema = RECORD_DDL if payloads else RECORD_DDL.replace(" payload binary,", "")
    spark = paths.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism * 4
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(k, pa.string())) for k in names], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = pafs.FileSystem.from_uri(path)
                rows, held = [], 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for raw in _frames(stream):
                        rows.append(parse_record(raw))
                        held += len(raw) if payloads else 500
                        if held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return paths.select("path").repartition(tasks).mapInArrow(work, schema)


def round_trip(spark: SparkSession, pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """The contract's rows: writes all pages, reads the archives back, one row per record."""
    manifest = write_archives(pages, fresh_path(spark, "warc"), min_revisit_bytes=min_revisit_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = lambda c: F.when(F.startswith(F.col(c), F.lit(PAGE)), F.url_decode(F.substr(F.col(c), F.lit(len(PAGE) + 1)))).cast(kind)
    return read_archives(manifest, payloads=False).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "error")
