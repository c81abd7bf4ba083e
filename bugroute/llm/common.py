"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bugroute.session import delete, release_shuffles, scratch_path, ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text: ASCII letters and
#: digits and every non-ASCII byte stay, all other bytes become blanks.
ALNUM_TABLE = bytes(
    (c | 0x20) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))

#: The same words and white-space words as SQL.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col) -> Column:
    """Lower-case A-Z only (``lower`` would also change É)."""
    return F.translate(col, UPPER, LOWER)


def fold(col, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


_PASSING: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized within are deleted at its end, and Spark is told
    to let the shuffle files of the frames go that nothing names any more."""
    paths: list[str] = []
    token = _PASSING.set((*_PASSING.get(), paths))
    try:
        yield
    finally:
        _PASSING.reset(token)
        for path in paths:
            delete(spark, path)
        release_shuffles(spark)


def materialize(df: DataFrame, name: str, result: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so
    a lost executor costs a read of files instead of a recomputation.  A ``result``
    outlives the innermost ``passing`` (but not the one around that)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    scopes = _PASSING.get()[:-1] if result else _PASSING.get()
    if scopes:
        scopes[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a ``bit_table``: 4 MB whatever the data.
BITS_LOG2 = 25


def bit_table(hashes: DataFrame, name: str) -> Column:
    """A table of 2**BITS_LOG2 bits, one column ``h`` of hashes set in it, as a
    scalar array: its size does not depend on the data."""
    words = hashes.select(F.col("h").bitwiseAND((1 << BITS_LOG2) - 1).alias("p")).groupBy(
        F.shiftright("p", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    spark = hashes.sparkSession
    table = spark.range(1 << (BITS_LOG2 - 6)).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    table = materialize(table.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))),
                                              lambda x: x["bits"]).alias("bits")), name)
    return table.scalar()


def in_bit_table(h: Column, table: Column) -> Column:
    p = h.bitwiseAND((1 << BITS_LOG2) - 1)
    word = F.get(table, F.shiftright(p, 6).cast("int"))
    return F.getbit(word, p.bitwiseAND(63).cast("int")) == 1


def lean(rows):
    """A mapInArrow function that runs without the search for reference cycles:
    with large dictionaries it takes longer than the work itself."""

    def run(batches):
        gc.disable()
        try:
            yield from rows(batches)
        finally:
            gc.enable()

    return run


def prepare(spark: SparkSession) -> SparkSession:
    ship_package(spark)
    return spark


def slices(batch: pa.RecordBatch, text_field: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``limit`` text bytes (a longer text alone),
    so that memory does not follow the batch size."""
    n = batch.num_rows
    if not n:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(text_field)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lens.astype(np.int64))
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, field: str) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in batch.column(field).cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """word bytes -> 64-bit hash, computed once per distinct word; emptied when
    it holds ``limit`` words."""

    def __init__(self, limit: int = 300_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h


class Tokens(dict):
    """token -> number of its word (``clean(token)``), -1 where that is empty;
    new words are put on ``new`` until they have been looked at."""

    def __init__(self, clean):
        super().__init__()
        self.clean = clean
        self.new: list[str] = []
        self.count = 0

    def __missing__(self, token: str) -> int:
        word = self.clean(token)
        if not word:
            n = -1
        else:
            n, self.count = self.count, self.count + 1
            self.new.append(word)
        self[token] = n
        return n


def numbered(texts: list[str], tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of blank-separated tokens, their texts)."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((tokens[w] for words in split for w in words), np.int64, int(counts.sum()))
    owner = np.repeat(np.arange(len(texts)), counts)
    keep = ids >= 0
    return ids[keep], owner[keep]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every run of ``k`` consecutive word hashes."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = ids[:n].copy()
    for j in range(1, k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
        acc += ids[j:n + j]
    return mix64(acc)


def partitions_for(rows: int, per_task: int) -> int:
    return max(1, math.ceil(rows / per_task))
