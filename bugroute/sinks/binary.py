"""Binary word2vec models and zip bundles, written by Spark (SNK1, SNK3).

Spark has no sink for bytes, but its text sink writes each row's bytes and a line
end.  So a file is given as the rows between its own line-end bytes: the sink puts
these back, and the file is what its format says, in any store that Spark knows.
A file's last byte has to be a line end, which both formats can have.
"""

from __future__ import annotations

import io
import math
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.functions.text import escape_word
from bugroute.session import ship_package

ROWS_PER_FILE = 1_000_000
LINE_BYTES = 4 << 20


def _write_bytes(rows: DataFrame, path: str) -> None:
    """``rows``: one binary column, a file's pieces in order for each partition."""
    rows.select(F.col(rows.columns[0]).cast("string").alias("value")).write.option("maxRecordsPerFile", 0).option(
        "compression", "none").text(path)


def _word2vec_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for word, vector in zip(batch.column("word").to_pylist(), batch.column("vector")):
            rows.append(word.encode() if not vector.is_valid else word.encode() + b" " + vector.values.to_numpy().astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])


def write_word2vec_binary(df: DataFrame, path: str, word: str = "word", vector: str = "vector",
                          rows_per_file: int = ROWS_PER_FILE) -> None:
    """A folder of word2vec binary files with a header and line breaks each, words
    dealt to them by hash; blanks in words are escaped, rows without a word or a
    vector skipped.  Vectors of different lengths raise an error."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(word).isNotNull() & F.col(vector).isNotNull()).select(
        escape_word(F.col(word)).alias("word"), F.col(vector).cast("array<float>").alias("vector"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers")
    files = max(1, math.ceil(n / rows_per_file))
    rows = rows.withColumn("file", F.pmod(F.xxhash64("word"), F.lit(files)).cast("int"))
    heads = rows.groupBy("file").agg(F.concat_ws(" ", F.count(F.lit(1)), F.lit(high or 1)).alias("word")).select(
        "file", F.lit(0).alias("at"), "word", F.lit(None).cast("array<float>").alias("vector"))
    body = rows.select("file", F.lit(1).alias("at"), "word", "vector")
    dealt = heads.unionByName(body).repartitionById(files, F.col("file")).sortWithinPartitions("file", "at", "word")
    _write_bytes(dealt.select("word", "vector").mapInArrow(_word2vec_rows, "value binary"), path)


class _Lines(io.RawIOBase):
    """Bytes written to it come back as the rows between line ends."""

    def __init__(self):
        self.parts, self.rows = [], []

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        *full, rest = bytes(data).split(b"\n")
        for row in full:
            self.rows.append(b"".join((*self.parts, row)))
            self.parts = []
        self.parts.append(rest)
        return len(data)

    def take(self) -> list[bytes]:
        rows, self.rows = self.rows, []
        return rows


def _zip_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, member, now = _Lines(), None, None

    def taken():
        return pa.RecordBatch.from_arrays([pa.array(out.take(), pa.binary())], names=["value"])

    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for batch in batches:
            for part, line in zip(batch.column("part").to_pylist(), batch.column("line").to_pylist()):
                if part != now:
                    if member:
                        member.close()
                    entry = zipfile.ZipInfo(part)
                    entry.compress_type = zipfile.ZIP_DEFLATED
                    now, member = part, z.open(entry, "w", force_zip64=True)
                member.write(line.encode() + b"\n")
            yield taken()
        if member:
            member.close()
        z.comment = b"\n"   # the file's last byte
    yield taken()


def write_zip_bundle(path: str, vectors: DataFrame, syn1: DataFrame | None = None, codes: DataFrame | None = None,
                     labels: DataFrame | None = None, config_json: str = "{}") -> None:
    """A zip bundle with the text parts that ``read_zip_bundle`` reads: syn0.txt
    (``word v1 ...``), syn1.txt (a line for each idx), codes.txt and huffman.txt
    (``word c1 ...``), labels.txt, config.json.

    ``vectors``: (word, idx, vector), idx from 0 without gaps; ``syn1``: (idx, syn1);
    ``codes``: (word, codes, points); ``labels``: one column.  An archive is one file
    and so one task, to which the lines come sorted and from which they go as a
    stream; nothing holds a part.
    """
    spark = vectors.sparkSession
    ship_package(spark)

    def numbers(column):
        return F.array_join(F.col(column).cast("array<string>"), " ")

    def part(name, at, order, line):
        return at.select(F.lit(name).alias("part"), order.cast("string").alias("name"), line.alias("line"))

    word = escape_word(F.col("word"))
    place = F.lpad(F.col("idx").cast("string"), 20, "0")
    parts = [part("syn0.txt", vectors.where("word is not null"), place, F.concat_ws(" ", word, numbers("vector"))),
             part("config.json", spark.range(1), F.lit(""), F.lit(config_json))]
    if syn1 is not None:
        parts.append(part("syn1.txt", syn1, place, numbers("syn1")))
    if codes is not None:
        parts += [part("codes.txt", codes, F.col("word"), F.concat_ws(" ", word, numbers("codes"))),
                  part("huffman.txt", codes, F.col("word"), F.concat_ws(" ", word, numbers("points")))]
    if labels is not None:
        name = F.col(labels.columns[0])
        parts.append(part("labels.txt", labels.where(name.isNotNull()), name, escape_word(name)))
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    one = lines.repartition(1).sortWithinPartitions("part", "name", "line").select("part", "line")
    _write_bytes(one.mapInArrow(_zip_rows, "value binary"), path)
