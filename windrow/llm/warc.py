"""WARC archives compressed with Zstandard, one frame per record, behind a dictionary in a leading skippable frame.

Writing: every task trains a dictionary on its own first records and emits, as rows, the dictionary's frame and
then one frame per record; Spark's text sink writes the rows, so its commit protocol covers retried tasks and any
file system that Spark knows will do. The sink ends each row with a line feed, which a frame may not contain at
that place; each row therefore ends with the head of a one-byte skippable frame whose content is that line feed.

Reading: Spark's ``binaryFile`` source hands whole archives to tasks, which walk the frames. An archive holds what
one task read, so the scan's split size bounds it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Fixed values of the formats: magic numbers of a Zstandard frame, of skippable frames and of the dictionary's frame.
FRAME, SKIPPABLE, DICTIONARY = 0xFD2FB528, 0x184D2A50, 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:windrow:page:"
PAD = struct.pack("<II", SKIPPABLE, 1)
#: A dictionary's size, and the records and bytes it is trained on at most.
DICTIONARY_BYTES, SAMPLE_RECORDS, SAMPLE_BYTES, LEVEL = 32_768, 256, 1_000_000, 3
#: Pages without a crawl date get this one, so that archives don't depend on when they are written.
DATE = "2024-01-01T00:00:00Z"

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


class WarcError(ValueError):
    """An archive whose frames, headers, lengths or digests are not as they should be."""


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A response record with the payload, or a revisit record that names the response with the same payload."""
    name = lambda x: f"<{RECORD_ID}{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))).replace('%', '') + '%')}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: The record types of the format, and headers that a record has once.
KINDS = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
ONCE = ("content-length", "warc-type", "warc-record-id", "warc-date", "warc-payload-digest", "warc-refers-to")


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Headers by their names in lower case; of a header that may be repeated the first counts."""
    out: dict[str, str] = {}
    for line in lines:
        key, colon, value = line.partition(b":")
        if not colon or not key or key != key.strip():
            raise WarcError(f"not a header: {line[:80]!r}")
        name = key.decode("ascii", "replace").lower()
        if name in out and name in ONCE:
            raise WarcError(f"a record with two headers {name}")
        out.setdefault(name, value.strip().decode("utf-8", "replace"))
    return out


def _length(fields: dict[str, str], what: str) -> int:
    if not (value := fields.get("content-length", "")).isascii() or not value.isdigit():
        raise WarcError(f"{what} without a valid Content-Length")
    return int(value)


def _page(name: str) -> int | None:
    """The page that a record id of write_archives names; None for other ids."""
    if len(name) < 3 or name[0] != "<" or name[-1] != ">":
        raise WarcError(f"not a record id: {name[:80]!r}")
    number = name[len(RECORD_ID) + 1 : -1] if name.startswith(f"<{RECORD_ID}") else ""
    return int(number) if re.fullmatch(r"-?[0-9]+", number) else None


def _digest(value: str, payload: bytes | None) -> str | None:
    """A payload digest as bare base32 SHA-1; other algorithms, which the format allows, count as none."""
    algorithm, _, digest = value.partition(":")
    if algorithm.lower() != "sha1":
        return None
    if not re.fullmatch(r"[A-Z2-7]{32}", digest := digest.upper()):
        raise WarcError(f"not a SHA-1 digest: {value[:80]!r}")
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise WarcError("a payload that does not match its digest")
    return digest


def parse_record(data: bytes) -> dict:
    """The fields of one record, checked: version, headers, both lengths, the record's end and the payload's digest.

    Records of all types are read. The payload is what follows the HTTP head, or the whole block where there is none;
    a digest in another algorithm than SHA-1 is not checked and given as null.
    """
    head, end, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not end or not lines[0].startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    fields = _fields(lines[1:])
    length = _length(fields, "a record")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"a record's block has {len(rest) - 4} bytes; its header says {length}")
    kind = fields.get("warc-type", "").lower()
    if kind not in KINDS:
        raise WarcError(f"unknown record type {kind!r}")
    page = _page(fields.get("warc-record-id", ""))
    payload, size = rest[:length], length
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http") and kind in ("response", "revisit"):
        http, end, payload = payload.partition(b"\r\n\r\n")
        if not end or not http.startswith(b"HTTP/"):
            raise WarcError("a block that is not an HTTP response")
        own = _fields(http.split(b"\r\n")[1:])
        size = _length(own, "a response") if "content-length" in own or kind == "revisit" and page is not None else len(payload)
        if kind == "response" and len(payload) != size and not {"transfer-encoding", "content-encoding"} & set(own):
            raise WarcError("a payload that does not match its length")
    elif kind == "response" and fields.get("warc-target-uri", "").startswith("http"):
        raise WarcError("a block that is not an HTTP response")
    digest = _digest(fields.get("warc-payload-digest", ""), payload if kind == "response" else None)
    if page is not None and digest is None:
        raise WarcError("no SHA-1 payload digest")
    refers_to = None
    if kind == "revisit":
        if payload or not {"warc-refers-to", "warc-refers-to-target-uri"} & set(fields):
            raise WarcError("a revisit with a payload or without the record it refers to")
        refers_to = _page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
    return {
        "page_id": page,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
        "url": fields.get("warc-target-uri"),
        "payload": None if kind == "revisit" else payload,
    }


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) for each frame of an archive; skippable frames come without their heads."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise WarcError("an archive ends within a frame")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIPPABLE:
            if at + 8 + size > len(data):
                raise WarcError("an archive ends within a skippable frame")
            yield magic, data[at + 8 : at + 8 + size]
            at += 8 + size
        elif magic == FRAME:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                if end + 3 > len(data):
                    raise WarcError("an archive ends within a frame")
                head = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 * (data[at + 4] >> 2 & 1)
            if end > len(data):
                raise WarcError("an archive ends within a frame")
            yield magic, data[at:end]
            at = end
        else:
            raise WarcError(f"unknown frame {magic:#x}")


def read_archive(data) -> Iterator[dict]:
    """The records of one archive. An empty archive has none; the dictionary's frame, if any, must come first."""
    reader = zstandard.ZstdDecompressor()
    for n, (magic, frame) in enumerate(frames(memoryview(data))):
        if magic == DICTIONARY:
            if n:
                raise WarcError("a dictionary that is not the first frame")
            raw = bytes(frame)
            if raw[:4] == struct.pack("<I", FRAME):  # the dictionary itself may be compressed
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == FRAME:
            try:
                record = (one := reader.decompressobj()).decompress(frame)  # frames of other writers may not tell their size
            except zstandard.ZstdError as error:
                raise WarcError(f"a frame that can't be decompressed: {error}") from error
            if not one.eof:
                raise WarcError("a frame without an end")
            yield parse_record(record)


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from some of an archive's own records; None where they are too few to train on."""
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:  # samples that have nothing in common
        return None


def _write_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    writer = None
    for batch in batches:
        columns = [batch.column(k) for k in ("page_id", "url", "html", "digest", "revisit", "refers_to")]
        out: list[bytes] = []

        def records(columns=columns, n=batch.num_rows):
            for i in range(n):
                page_id, url, html, digest, revisit, refers_to = (c[i].as_py() for c in columns)
                yield make_record(page_id, url, (html or "").encode(), digest, revisit, refers_to)

        made = records()
        if writer is None and batch.num_rows:
            first: list[bytes] = []
            total = 0
            for record in made:
                first.append(record)
                total += len(record)
                if len(first) >= SAMPLE_RECORDS or total >= SAMPLE_BYTES:
                    break
            trained = train_dictionary(first)
            writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
            if trained:
                out.append(struct.pack("<II", DICTIONARY, len(raw := trained.as_bytes())) + raw + PAD)
            out += [writer.compress(x) + PAD for x in first]
        for record in made:
            out.append(writer.compress(record) + PAD)
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record per row of ``pages`` (page_id, url, html; other columns are not read) as archives under path.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id is the response
    and the others revisit it; rows that repeat that page_id are responses too. Null ids are smaller than all
    others; a payload seen only under null ids is a response each time. A null html is the empty payload. A table
    without rows gives archives without records. One task writes one archive, whose dictionary its records need, so
    files are not split by number of rows.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    digested = pages.select("page_id", "url", "html", F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    largest = materialise(
        digested.filter(F.col("size") >= least_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and refers_to is not null").drop("n"),
        "repeated",
    )
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = digested.drop("size").join(largest, "digest", "left").withColumn("revisit", revisit)
    rows.mapInArrow(_write_part, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 0).text(path)


def _read_part(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    if payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    some = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds, strict=True)], names)
    for batch in batches:
        for content in batch.column("content"):
            rows: list[dict] = []
            held = 0
            for record in read_archive(content.as_buffer()):
                rows.append(record)
                held += len(record["payload"] or b"")
                if len(rows) >= 2000 or held >= 8_000_000:
                    yield some(rows)
                    rows, held = [], 0
            if rows:
                yield some(rows)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per record of the archives under path, with the payload of responses if asked for.

    Every record is decompressed and checked; WarcError ends the job at the first that is not valid. Records of all
    types are read; those that write_archives did not name have no page_id. A task holds one archive at a time, so
    archives must fit a worker's memory.
    """
    archives = spark.read.format("binaryFile").load(path).select("content")
    return archives.mapInArrow(lambda batches: _read_part(batches, payload), RECORDS + (", payload binary" if payload else ""))


def dangling(records: DataFrame) -> DataFrame:
    """The revisits among records whose ``refers_to`` is no response's page_id with the same digest."""
    responses = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest").distinct()
    return records.filter("record_type = 'revisit'").join(responses, ["refers_to", "payload_digest"], "left_anti")
