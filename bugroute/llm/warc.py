"""WARC archives in Zstandard frames (`.warc.zst`), written and read back.

An archive begins with a skippable frame that holds the dictionary of its
records (itself compressed); then each record is one frame.  Spark's text source
writes the archives, so any store that Spark knows can hold them: a row is one
frame's bytes and the head of a skippable frame of one byte, which takes in the
line end that the source appends.

The reader takes archives of any origin.  It loads the dictionary from the leading
skippable frame, walks from frame to frame by their block sizes, decodes one
frame a record, and checks the version, the mandatory headers, the content
length, the record's end and the digests of block and payload; a fault raises an
error that names the file and the frame's place.

Of records with equal payloads the one with the smallest page id is a response;
the others are revisits, without payload, that refer to its record id.  Pages are
found equal by SHA-256 and length; only these digests are grouped and joined, and
the pages themselves are shuffled once, by page, into archives of a bounded size.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugroute.llm.common import lean, materialize, prepare
from bugroute.session import scratch_path

#: Payload bytes of an archive, on average; a longer payload makes a longer archive.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is made from the first records of the archive, this many bytes
#: of them; it changes the archive's size, never what is read back.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3

# Fixed values of the formats.
_DICTIONARY_MAGIC = 0x184D2A5D
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_FRAME_MAGIC = 0xFD2FB528
_LINE_END = (0x184D2A50).to_bytes(4, "little") + (1).to_bytes(4, "little")  # its one byte is the line end
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSIONS = (b"WARC/1.0", b"WARC/1.1")
_MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

RECORD_SCHEMA = ("file string, offset long, record_type string, record_id string, target_uri string, page_id string, "
                 "refers_to string, payload_bytes long, payload_digest string, payload binary")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing

def record_id(page_id: str | None, key: bytes) -> str:
    """The id of a page's record, from the page's id and its payload's digest."""
    seed = hashlib.sha256((b"" if page_id is None else b"=" + page_id.encode()) + b"\n" + key).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def _uri(url: str | None) -> str:
    """The URL with blanks and control characters as percent codes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:unknown")


def warc_record(page_id: str | None, url: str | None, payload: bytes, key: bytes, first: str | None, date: str) -> bytes:
    """One WARC record; a revisit of page ``first`` where that is given."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = head if first is not None else head + payload
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id, key)),
              ("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)),
              ("WARC-Block-Digest", "sha1:" + sha1_base32(block))]
    if page_id is not None:
        fields.append(("Page-ID", page_id))
    if first is not None:
        fields += [("WARC-Refers-To", record_id(first, key)), ("WARC-Profile", _REVISIT_PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def skippable(content: bytes, magic: int) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the records; None if they are too few or too much alike."""
    samples = [r[:SAMPLE_BYTES] for r in records]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(sum(map(len, samples)) // 8, 256)), samples)
    except zstandard.ZstdError:
        return None


def archive_rows(records: Iterator[bytes]) -> Iterator[bytes]:
    """The rows of one archive: the dictionary's frame, then a frame a record."""
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= SAMPLE_BYTES:
            break
    trained = _dictionary(held) if held else None
    if trained:
        yield skippable(zstandard.compress(trained.as_bytes()), _DICTIONARY_MAGIC) + _LINE_END
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    for source in (held, records):
        for record in source:
            yield compressor.compress(record) + _LINE_END


def _frame_rows(date: str):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, key, first = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "key", "first"))
                yield warc_record(page_id, url, payload, key, first, date)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in archive_rows(records(batches)):
            held.append(row)
            size += len(row)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["frame"])

    return rows


def _row_key(page_id: str, key: str):
    return F.concat_ws(":", F.coalesce(F.col(page_id), F.lit("")), F.col(page_id).isNull().cast("string"), F.hex(key))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A record for every row of ``pages``, in archives below ``path``.

    Payloads of fewer than ``min_bytes`` are never revisits.  A null payload is
    empty; a null id has no Page-ID field and is smaller than none, so that it
    is a response only where all ids of the payload are null; rows that
    repeat the smallest id are all responses.
    """
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    digest = F.unhex(F.sha2(payload, 256))
    keys = pages.select(F.col(f"`{id_col}`").alias("id"), digest.alias("key"), F.octet_length(payload).alias("n_bytes"))
    keys = materialize(keys, "page-digests")
    firsts = keys.where(F.col("n_bytes") >= min_bytes).groupBy("key", "n_bytes").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = keys.join(firsts, ["key", "n_bytes"]).where("id is null or id > first").select(
        F.col("id").cast("string").alias("page_id"), "key", F.col("first").cast("string").alias("first"))
    again = again.select(_row_key("page_id", "key").alias("row_key"), "first").distinct()
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    rows = pages.select(F.col(f"`{id_col}`").cast("string").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                        payload.alias("payload"), digest.alias("key"))
    rows = rows.withColumn("row_key", _row_key("page_id", "key"))
    rows = rows.repartition(max(1, math.ceil(total / archive_bytes)), "row_key")
    rows = rows.join(materialize(again, "page-revisits"), "row_key", "left").sortWithinPartitions("row_key")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    frames = rows.select("page_id", "url", "payload", "key", "first").mapInArrow(lean(_frame_rows(date)), "frame binary")
    # one file a task, in the task's order: the dictionary leads
    frames.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", 0).option(
        "compression", "none").text(path)


# ---------------------------------------------------------------- reading

def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that begins at ``at`` ends."""
    head = bytes(data[at:at + 18])
    pos = at + zstandard.frame_header_size(head)
    last = False
    while not last:
        if pos + 3 > len(data):
            raise ValueError("the frame is cut off")
        block = int.from_bytes(data[pos:pos + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a block of no known kind")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 * zstandard.get_frame_parameters(head).has_checksum
    if pos > len(data):
        raise ValueError("the frame is cut off")
    return pos


def frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(place, decoded bytes) of every frame of an archive but skippable ones."""
    at, decoder = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        try:
            if magic in _SKIPPABLE:
                end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
                if at + 8 > len(data) or end > len(data):
                    raise ValueError("the skippable frame is cut off")
                if at == 0 and magic == _DICTIONARY_MAGIC:
                    raw = bytes(data[8:end])
                    if raw[:4] == _FRAME_MAGIC.to_bytes(4, "little"):
                        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            elif magic == _FRAME_MAGIC:
                end = frame_end(data, at)
                yield at, decoder.decompressobj().decompress(data[at:end])
            else:
                raise ValueError("no frame begins here")
        except (ValueError, zstandard.ZstdError) as error:
            raise ValueError(f"at byte {at}: {error}") from None
        at = end


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"no header: {line[:80]!r}")
        out.setdefault(name.decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace"))
    return out


def _same_digest(field: str | None, data: bytes, what: str) -> None:
    kind, _, value = (field or "").partition(":")
    if kind.lower() == "sha1" and value.upper() != sha1_base32(data):
        raise ValueError(f"the digest of the {what} is another")


def parse_record(data: bytes) -> dict:
    """A record's fields and payload; a fault raises ValueError."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or version not in _VERSIONS:
        raise ValueError("no WARC record")
    fields = _fields(lines)
    for name in _MANDATORY:
        if not fields.get(name):
            raise ValueError(f"without {name}")
    if not fields["content-length"].isdecimal() or int(fields["content-length"]) != len(rest) - 4:
        raise ValueError(f"content length {fields['content-length'][:20]}, but {len(rest) - 4} bytes")
    if rest[-4:] != b"\r\n\r\n":
        raise ValueError("without its end")
    block = payload = rest[:-4]
    _same_digest(fields.get("warc-block-digest"), block, "block")
    kind = fields["warc-type"]
    if fields.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise ValueError("an HTTP head without its end")
        length = _fields(http.split(b"\r\n")[1:]).get("content-length")
        if kind == "response" and length is not None and length != str(len(payload)):
            raise ValueError(f"HTTP content length {length[:20]}, but {len(payload)} bytes")
    if kind == "revisit":
        if not fields.get("warc-payload-digest") or not fields.get("warc-refers-to"):
            raise ValueError("a revisit without digest or reference")
        payload = None
    elif kind == "response":
        _same_digest(fields.get("warc-payload-digest"), payload, "payload")
    digest = fields.get("warc-payload-digest")
    if digest is None and payload is not None:
        digest = "sha1:" + sha1_base32(payload)
    return {"record_type": kind, "record_id": fields["warc-record-id"], "target_uri": fields.get("warc-target-uri"),
            "page_id": fields.get("page-id"), "refers_to": fields.get("warc-refers-to"),
            "payload_bytes": None if payload is None else len(payload), "payload_digest": (digest or "").removeprefix("sha1:"),
            "payload": payload}


def _record_rows(payloads: bool):
    kind = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t])
                      for n, t in (x.split() for x in RECORD_SCHEMA.split(", "))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    for at, data in frames(memoryview(content.as_buffer())):
                        try:
                            row = parse_record(data) | {"file": file, "offset": at}
                        except ValueError as error:
                            raise ValueError(f"at byte {at}: {error}") from None
                        if not payloads:
                            row["payload"] = None
                        held.append(row)
                        size += 500 + (len(data) if payloads else 0)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=kind)
                            held, size = [], 0
                except ValueError as error:
                    raise ValueError(f"{file} {error}") from None
        yield pa.RecordBatch.from_pylist(held, schema=kind)

    return rows


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path`` (``RECORD_SCHEMA``; payload null
    where ``payloads`` is off, and for revisits, which have none).  An archive is
    decoded by one task, record by record."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(lean(_record_rows(payloads)), RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the
    responses and revisits: a revisit's length and page come from the response it
    refers to.  A reference to no response, or to one with another payload
    digest, raises an error."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'")
    target = responses.groupBy(F.col("record_id").alias("refers_to")).agg(
        F.min(F.struct("page_id", "payload_bytes", "payload_digest")).alias("r"))
    revisits = records.where("record_type = 'revisit'").drop("payload").join(target, "refers_to", "left")
    right = F.col("r.payload_digest") == F.col("payload_digest")
    broken = F.raise_error(F.concat(F.lit("revisit of no equal response: "), F.col("record_id")))
    revisits = revisits.select("page_id", F.when(right, F.col("r.payload_bytes")).otherwise(broken.cast("long")).alias("payload_bytes"),
                               "payload_digest", "record_type", F.col("r.page_id").alias("refers_to"))
    return responses.withColumn("refers_to", F.lit(None).cast("string")).select(*columns).unionByName(revisits.select(*columns))


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                       min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to) of every row.

    Null and empty payloads have 0 bytes and equal one another.  An empty table
    gives no rows.  Other columns are never read.
    """
    path = scratch_path(pages.sparkSession, "warc-archives")
    write_archives(pages, path, id_col, url_col, payload_col, min_bytes, archive_bytes)
    records = materialize(read_archives(pages.sparkSession, path, payloads=False), "warc-records")
    kind = pages.schema[id_col].dataType
    return resolved(records).select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                    F.col("refers_to").cast(kind).alias("refers_to"))


_DIGITS = "".join(
    f"|| substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS BIGINT) >> {s}) & 31)::INT, 1)\n       "
    for g in range(8) for s in (15, 10, 5, 0))

ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
f AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, n AS payload_bytes,
       '' {_DIGITS} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
