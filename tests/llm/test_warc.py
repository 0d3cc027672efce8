import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from windrow.llm import warc
from windrow.llm.common import shared_path, table


def round_trip(spark, pages, **options):
    path = shared_path(spark, "archives")
    warc.write_archives(pages, path, **options)
    return path, warc.read_archives(spark, path, payload=True)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


SCHEMA = "page_id long, url string, html string, page_id_ string, payload string, digest string"


def test_whole_table(spark, sf):
    pages = table(spark, sf, "pages")
    _, back = round_trip(spark, pages)
    want = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = back.collect()
    assert len(rows) == len(want) and {r["page_id"] for r in rows} == set(want)
    by_id = {r["page_id"]: r for r in rows}
    for r in rows:
        html = want[r["page_id"]] or ""
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html.encode()), digest(html))
        assert r["record_type"] == "response" and r["payload"].decode() == html or want[r["refers_to"]] == html
        assert r["refers_to"] is None or by_id[r["refers_to"]]["record_type"] == "response"


def test_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "http://a/ü \n", "same"), (2, None, "same"), (5, "u", "same"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", ""), (None, "v", "only"), (None, "w", "only"), (9, "", "x" * 300_000)]
    pages = spark.createDataFrame([(*r, "c", "p", "d") for r in rows], SCHEMA)
    _, back = round_trip(spark, pages)
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in back.collect()), key=repr)
    assert found == sorted([
        (1, 4, "revisit", 5), (2, 4, "revisit", 5), (5, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (4, 0, "response", None),
        (None, 0, "revisit", 4), (None, 4, "response", None), (None, 4, "response", None), (9, 300_000, "response", None),
    ], key=repr)
    _, back = round_trip(spark, pages, least_bytes=5)
    assert {r["record_type"] for r in back.collect()} == {"response"}


def test_empty_table(spark):
    _, back = round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert back.count() == 0


def test_archives_lead_with_their_dictionary_and_any_reader_can_read_them(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.concat(F.lit("lorem ipsum dolor "), F.repeat(F.concat(F.col("id"), F.lit(" sit amet ")), 60)).alias("html"))
    path, _ = round_trip(spark, pages.coalesce(1))
    data = bytes(spark.read.format("binaryFile").load(path).filter("length > 0").first()["content"])
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICTIONARY and 0 < size <= warc.DICTIONARY_BYTES
    frames = [f for m, f in warc.frames(memoryview(data)) if m == warc.FRAME]
    assert len(frames) == 400
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert all(reader.decompress(bytes(f)).startswith(b"WARC/1.1\r\n") for f in frames)


def archive(*records, tail=b""):
    writer = zstandard.ZstdCompressor(write_checksum=True)
    return b"".join(writer.compress(r) + warc.PAD + b"\n" for r in records) + tail


def good(payload=b"<p>", **options):
    return warc.make_record(7, "http://a", payload, hashlib.sha1(payload).digest(), options.get("revisit", False), options.get("refers_to"))


@pytest.mark.parametrize(
    "data",
    [
        archive(good().replace(b"WARC/1.1", b"WRAC/1.1")),
        archive(good().replace(b"<p>", b"<q>")),
        archive(good().replace(b"<p>", b"<pp>")),
        archive(good()[:-1]),
        archive(good().replace(b"Content-Length: 3", b"Content-Length: x")),
        archive(good().replace(b"WARC-Type: response", b"WARC-Type: other")),
        archive(good().replace(b"WARC-Type: response", b"WARC-Type response")),
        archive(good().replace(b"<urn:windrow:page:7>", b"urn:windrow:page:7")),
        archive(good().replace(b"Content-Length: 3", b"Content-Length: 3\r\nContent-Length: 3")),
        archive(good().replace(b"WARC-Date", b"Content-Length: 9\r\nWARC-Date")),
        archive(good().replace(b"sha1:", b"md5:")),
        archive(good(revisit=True, refers_to=8).replace(b"WARC-Refers-To", b"WARC-Refers-At")),
        archive(good())[:-12],
        archive(good(), tail=b"junk after the end"),
        archive(good(), tail=struct.pack("<II", warc.DICTIONARY, 4) + b"abcd"),
    ],
)
def test_damage_is_found(data):
    with pytest.raises((warc.WarcError, zstandard.ZstdError)):
        list(warc.read_archive(data))


def test_records():
    assert list(warc.read_archive(b"")) == []
    first, second = warc.read_archive(archive(good(b""), good(b"x" * 1_000_000)))
    assert (first["page_id"], first["payload"], second["payload_bytes"]) == (7, b"", 1_000_000)
    revisit = warc.parse_record(good(b"abc", revisit=True, refers_to=8))
    assert (revisit["refers_to"], revisit["payload_bytes"], revisit["payload"]) == (8, 3, None)


def record(kind, block, *headers):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0b1c>", "WARC-Date: 2024-01-01T00:00:00Z", *headers, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_other_crawlers_archives_are_read():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n<p>"
    records = [
        record("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"),
        record("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"),
        record("response", http, "Content-Type: application/http;msgtype=response", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: sha1:{digest('<p>')}"),
        record("resource", b"\x89PNG", "Content-Type: image/png", "WARC-Payload-Digest: md5:abc"),
        record("metadata", b"via: y\r\n"),
        record("conversion", b"plain text", "Content-Type: text/plain"),
    ]
    found = list(warc.read_archive(archive(*records)))
    assert [r["record_type"] for r in found] == ["warcinfo", "request", "response", "resource", "metadata", "conversion"]
    assert {r["page_id"] for r in found} == {None} and (found[2]["payload"], found[2]["payload_digest"]) == (b"<p>", digest("<p>"))
    assert found[3]["payload_digest"] is None and found[5]["payload"] == b"plain text"


def test_a_compressed_dictionary():
    samples = [good(b"lorem ipsum dolor sit amet %d " % i * 30) for i in range(600)]
    trained = warc.train_dictionary(samples)
    raw = zstandard.ZstdCompressor().compress(trained.as_bytes())
    writer = zstandard.ZstdCompressor(dict_data=trained, write_content_size=False)
    data = struct.pack("<II", warc.DICTIONARY, len(raw)) + raw + b"".join(writer.compress(s) for s in samples[:20])
    assert len(list(warc.read_archive(data))) == 20


def test_a_session_that_splits_files_leaves_archives_whole(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.repeat(F.concat(F.col("id"), F.lit(" lorem ipsum ")), 60).alias("html"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 50)
    try:
        _, back = round_trip(spark, pages.coalesce(1))
        assert back.count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_dangling_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "a"), (4, "u", "b")], "page_id long, url string, html string")
    _, back = round_trip(spark, pages)
    assert warc.dangling(back).count() == 0 and sorted(r["page_id"] for r in warc.dangling(back.filter("page_id <> 3")).collect()) == [1, 2]
