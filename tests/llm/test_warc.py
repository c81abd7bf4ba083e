"""WARC archives: round trips, edge rows, and archives with faults."""

import base64
import gzip
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from bugroute.llm import warc
from bugroute.session import scratch_path


def reference(rows, min_bytes=0):
    """rows: (page_id, payload or None) -> the rows of the contract."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        first = least.get(t or "")
        again = len(data) >= min_bytes and first is not None and i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


EDGE = [(5, None), (3, ""), (7, "<p>é日本\x00</p>"), (2, "x" * 3_000_000), (9, "x" * 3_000_000), (4, "\r\n\r\nWARC/1.1\r\n"),
        (6, "same"), (6, "same"), (1, "same"), (None, "same"), (None, "alone"), (8, "alone too"), (8, "not alone"), (8, "same")]


def pages(spark, rows):
    """Pages with columns whose names the operator uses itself."""
    data = [(i, f"http://x/{i}\n a", t, "k", "f", b"v") for i, t in rows]
    return spark.createDataFrame(data, "page_id long, url string, html string, key string, first string, payload binary").repartition(3)


@pytest.mark.parametrize("archive_bytes", [warc.ARCHIVE_BYTES, 500])
def test_edge_rows(spark, archive_bytes):
    got = warc.archive_round_trip(pages(spark, EDGE), archive_bytes=archive_bytes)
    assert rows_of(got) == reference(EDGE)
    assert got.schema["page_id"].dataType.simpleString() == got.schema["refers_to"].dataType.simpleString() == "bigint"


def test_short_payloads_are_responses(spark):
    assert rows_of(warc.archive_round_trip(pages(spark, EDGE), min_bytes=5)) == reference(EDGE, 5)


def test_empty_table(spark):
    assert warc.archive_round_trip(pages(spark, EDGE).limit(0)).collect() == []


def test_pages_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = df.select((F.col("page_id") % 7 + 1_000_000).alias("page_id"), "url", "html")
    both = df.unionByName(more)
    assert rows_of(warc.archive_round_trip(both)) == reference([(r.page_id, r.html) for r in both.collect()])


def test_archives_are_plain_zstandard(spark):
    """Dictionary first, one frame a record; the payloads come back."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df, path, archive_bytes=400_000)
    files = spark.read.format("binaryFile").load(path).where("length > 0").collect()
    assert len(files) > 1
    for f in files:
        data = bytes(f.content)
        assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
        raw = zstandard.decompress(data[8:8 + int.from_bytes(data[4:8], "little")])
        decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        whole = decoder.stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(x for _, x in warc.frames(memoryview(data)))
    records = warc.read_archives(spark, path)
    assert sorted((int(r.page_id), r.payload.decode()) for r in records.collect()) == sorted((r.page_id, r.html) for r in df.collect())
    assert records.select("record_id").distinct().count() == records.count() == df.count()


def archive(records, dictionary=None, sizes=True, raw=False):
    packer = zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=sizes)
    head = b""
    if dictionary:
        content = dictionary.as_bytes() if raw else zstandard.compress(dictionary.as_bytes())
        head = warc.skippable(content, 0x184D2A5D)
    return head + b"".join(packer.compress(r) for r in records)


RECORD = warc.warc_record("1", "http://x/", b"<p>one</p>", b"k", None, "2024-01-01T00:00:00Z")
SECOND = warc.warc_record("2", "http://y/", b"<p>two</p>", b"l", None, "2024-01-01T00:00:00Z")


def test_foreign_archives():
    raw = zstandard.ZstdCompressionDict(b"WARC-Record-ID: <urn:uuid: HTTP/1.1 200 OK" * 9, zstandard.DICT_TYPE_RAWCONTENT)
    for data in (archive([RECORD, SECOND]), archive([RECORD, SECOND], raw), archive([RECORD, SECOND], raw, False, True),
                 archive([RECORD]) + warc.skippable(b"abc", 0x184D2A53) + archive([SECOND], sizes=False)):
        assert [x for _, x in warc.frames(memoryview(data))] == [RECORD, SECOND]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: d\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"
    assert warc.parse_record(info)["payload"] == b"a:b"


@pytest.mark.parametrize("old, new, says", [
    (b"WARC/1.1", b"WARC/9.9", "no WARC record"), (b"WARC-Date", b"Any-Date", "warc-date"), (b"WARC-Type: ", b"WARC-Type ", "header"),
    (b"<p>one", b"<p>onE", "digest of the block"), (b"<p>one", b"<p>more", "content length"), (b"</p>\r\n\r\n", b"</p>....", "end"),
    (b"Digest: sha1:A", b"Digest: sha1:B", "digest"), (b"Content-Length: 10", b"Content-Length: 11", "digest of the block"),
])
def test_faulty_records(old, new, says):
    record = RECORD
    if old == b"Digest: sha1:A":
        digest = warc.sha1_base32(b"<p>one</p>").encode()
        old, new = b"Payload-Digest: sha1:" + digest, b"Payload-Digest: sha1:" + digest[::-1]
    assert old in record
    with pytest.raises(ValueError, match=says):
        warc.parse_record(record.replace(old, new, 1))


@pytest.mark.parametrize("change", [lambda d: d[:-3], lambda d: d[:20], lambda d: b"junk" + d, lambda d: d + b"\0", gzip.compress,
                                    lambda d: d[:-5] + bytes([d[-5] ^ 255]) + d[-4:]])
def test_faulty_archives(spark, change):
    path = scratch_path(spark, "faulty-warc")
    packer = zstandard.ZstdCompressor(write_checksum=True)
    data = change(packer.compress(RECORD * 50))
    with pytest.raises(ValueError, match="at byte"):
        list(warc.frames(memoryview(data)))
    rows = spark.createDataFrame([(data,)], "value binary").select(F.col("value").cast("string").alias("value"))
    rows.coalesce(1).write.text(path)
    with pytest.raises(Exception, match="at byte"):
        warc.read_archives(spark, path).collect()


def test_dangling_revisits(spark):
    schema = warc.RECORD_SCHEMA
    response = ("f", 0, "response", "<a>", "u", "1", None, 3, "D", None)
    good, other, lost = (("f", 1, "revisit", "<b>", "u", "2", r, None, d, None) for r, d in (("<a>", "D"), ("<a>", "E"), ("<c>", "D")))
    assert warc.resolved(spark.createDataFrame([response, good], schema)).where("refers_to = '1'").first().payload_bytes == 3
    for bad in (other, lost):
        with pytest.raises(Exception, match="revisit of no equal response"):
            warc.resolved(spark.createDataFrame([response, bad], schema)).collect()
