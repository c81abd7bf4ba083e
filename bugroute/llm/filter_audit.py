"""Filter interaction audit: what each filter removes in every order of five.

One pass over the texts gives each document a mask of the filters A to D that it
fails and a digest of its text.  Filter E (an identical text under a smaller
id) is found by a counting-Bloom prepass: each batch counts its digests into
sparse pieces of a sketch, the pieces of one stretch of counters are added up,
and counters that reached 2 become a bit table.  A text with any counter below 2
is the only one of its kind, for certain; only the others are read again
and shuffled, grouped by the whole text, for the smallest id of each.

The masks, corrected for E, are counted by part, and all orders follow from these
counts alone: a document is removed by the first filter of the order that it
fails.  Nothing is expanded by document, only by the at most 32 masks of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import SPACE_WORD, lean, materialize, mix64, prepare, slices, texts_of

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
MARKS = b"#$%&*|"

PROBES = 4
COUNTERS_PER_ROW = 8
STRETCH = 1 << 16  # counters added up by one group
#: The sketch grows with the table up to 2**29 counters (a bit table of 64 MB).
#: Beyond some 64 million documents it clears fewer of the unique texts, so that
#: more texts are shuffled; the result stays exact.
LARGEST_LOG2 = 29

_CAPITALS = bytes(range(0x41, 0x5B))
_TAILS = bytes(range(0x80, 0xC0))  # of a code point's bytes all but the first


def failures(text: bytes) -> int:
    """Bits 0 to 3: the filters A to D that ``text`` (UTF-8) fails."""
    words = text.split()  # at [\x20\x09-\x0D]+
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _TAILS))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2 | (len(text) > len(text.translate(None, MARKS))) << 3)


def _mask_rows(kind: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                texts = texts_of(piece, "text")
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("part"), pa.array([failures(t) for t in texts], pa.int32()),
                     pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], schema=kind)

    return rows


def _heads(digests: list[bytes]) -> np.ndarray:
    """64-bit hashes: the first bytes of SHA-256 digests."""
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


def _probes(hashes: np.ndarray, log2: int) -> np.ndarray:
    """(PROBES, n): the counters of every hash."""
    seeds = np.arange(1, PROBES + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(hashes[None] + seeds) >> np.uint64(64 - log2)).astype(np.int64)


def _sketch_rows(log2: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, count = np.unique(_probes(_heads(batch.column("digest").to_pylist()), log2), return_counts=True)
            cut = np.flatnonzero(np.diff(at // STRETCH)) + 1
            offsets = np.split((at % STRETCH).astype("<u2"), cut)
            counts = np.split(np.minimum(count, 2).astype(np.uint8), cut)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(x) for x in at[np.concatenate([[0], cut])] // STRETCH], pa.int32()),
                     pa.array([x.tobytes() for x in offsets], pa.binary()),
                     pa.array([x.tobytes() for x in counts], pa.binary())], names=["stretch", "offsets", "counts"])

    return rows


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of their stretch -> one row of bits a stretch: counters of 2 or more."""
    now, total = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.int32()), pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary())],
            names=["stretch", "bits"])

    for batch in batches:
        for stretch, offsets, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if stretch != now:
                if now is not None:
                    yield row()
                now, total = stretch, np.zeros(STRETCH, np.uint8)
            at = np.frombuffer(offsets, "<u2")
            total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint8), 2)
    if now is not None:
        yield row()


def repeat_bits(rows: DataFrame, n_rows: int) -> tuple[int, np.ndarray]:
    """(log2 of the counters, bit table): the counters that reached 2."""
    log2 = min(max((COUNTERS_PER_ROW * n_rows - 1).bit_length(), 17), LARGEST_LOG2)
    pieces = rows.select("digest").mapInArrow(lean(_sketch_rows(log2)), "stretch int, offsets binary, counts binary")
    merged = pieces.repartition("stretch").sortWithinPartitions("stretch").mapInArrow(_merge, "stretch int, bits binary")
    bits = np.zeros(1 << (log2 - 3), np.uint8)
    for r in materialize(merged, "audit-sketch").toLocalIterator():  # 2**LARGEST_LOG2 bits at most
        bits[r.stretch * (STRETCH // 8):(r.stretch + 1) * (STRETCH // 8)] = np.frombuffer(r.bits, np.uint8)
    return log2, bits


def _possible(sketch, field: str):
    """Only the rows whose text may occur again, by their ``field``: text or digest."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log2, bits = sketch.value
        for batch in batches:
            for piece in slices(batch, field):
                found = piece.column(field).to_pylist() if field == "digest" else (
                    hashlib.sha256(t).digest() for t in texts_of(piece, field))
                at = _probes(_heads(list(found)), log2)
                maybe = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(0)
                if maybe.any():
                    yield piece.filter(pa.array(maybe))

    return rows


def _simple(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, mask, digest) of every row: the filters A to D that it fails."""
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
                       F.col(f"`{text_col}`").alias("text"))
    kind = to_arrow_schema(rows.drop("text").schema).append(pa.field("mask", pa.int32())).append(pa.field("digest", pa.binary()))
    return materialize(rows.mapInArrow(lean(_mask_rows(kind)), f"{_simple(rows.drop('text'))}, mask int, digest binary"), "audit-masks")


def later_copies(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, mask) of the rows whose whole text also stands under a smaller id."""
    sketch = docs.sparkSession.sparkContext.broadcast(repeat_bits(rows, rows.count()))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    texts = texts.mapInArrow(lean(_possible(sketch, "text")), _simple(texts))
    # a task sends each of its texts once, with its smallest id
    least = texts.groupBy("text").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = materialize(least.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "least"), "audit-copies")
    again = rows.mapInArrow(lean(_possible(sketch, "digest")), _simple(rows))
    return materialize(again.join(least, "digest").where("doc_id > least").select("doc_id", "part", "mask"), "audit-later")


def _steps() -> str:
    """Every order and step: (filter_order, step, bit, earlier), the bits of the
    step's filter and of those before it."""
    rows = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(x) for x in order]
        rows += [f"named_struct('filter_order', '{''.join(order)}', 'step', {k + 1}, 'bit', {bits[k]}, 'earlier', {sum(bits[:k])})"
                 for k in range(len(bits))]
    return f"inline(array({', '.join(rows)}))"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
          quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text counts as empty, a null part as the empty string.  A row with a
    null id has no smaller ids and no labels; rows that repeat an id are counted
    one by one and are no copies of each other.  If an id has several
    labels, one of 1 is enough.  An empty table gives no rows; other columns are
    never read.
    """
    prepare(docs.sparkSession)
    rows = masks(docs, id_col, text_col, part_col)
    later = later_copies(docs, rows, id_col, text_col)
    e = 1 << FILTERS.index("E")
    # every row counts once at its mask of A to D; one that also fails E moves on
    events = rows.select("doc_id", "part", "mask", F.lit(1).alias("n")).unionByName(
        later.withColumn("n", F.lit(-1))).unionByName(later.select("doc_id", "part", (F.col("mask") + e).alias("mask"), F.lit(1).alias("n")))
    marks = labels.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(
        F.max((F.col(f"`{quality_col}`") == 1).cast("int")).alias("good"), F.max((F.col(f"`{toxic_col}`") == 1).cast("int")).alias("toxic"))
    counts = events.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    at = counts.select("part", "mask", "n", "good", "toxic", F.expr(_steps()))
    passed, fails = F.expr("mask & earlier = 0"), F.expr("mask & bit != 0")

    def total(column, where):
        return F.sum(F.when(where, column).otherwise(0)).cast("long")

    return at.groupBy("part", "filter_order", "step").agg(
        total(F.col("n"), passed & ~fails).alias("kept"), total(F.col("n"), passed & fails).alias("removed"),
        total(F.col("n"), ~passed & fails).alias("redundant"), total(F.col("n"), F.expr("mask = bit")).alias("unique_fails"),
        total(F.col("good"), passed & fails).alias("good_lost"), total(F.col("toxic"), passed & fails).alias("toxic_lost"),
        # of all orders, the share in which this filter is the first that the document fails
        total(F.expr("n * (120 div bit_count(mask))"), fails).alias("shapley"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{SPACE_WORD}') AS w FROM t),
f AS (SELECT doc_id, part, [len(w) < {MIN_WORDS}, 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w),
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(text),
             regexp_matches(text, '[#$%&*|]'), coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(range(1, 6)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e
      WHERE a.i NOT IN (b.i, c.i, d.i, e.i) AND b.i NOT IN (c.i, d.i, e.i) AND c.i NOT IN (d.i, e.i) AND d.i <> e.i),
s AS (SELECT p, array_to_string(list_transform(p, lambda k: chr(64 + CAST(k AS INT))), '') AS filter_order, x.i AS step FROM o, x),
r AS (SELECT part, filter_order, CAST(step AS INT) AS step, p[step] AS own, n, good, toxic, fails[p[step]] AS bad,
             len(list_filter(p[1:step - 1], lambda k: fails[k])) > 0 AS gone,
             len(list_filter(fails, lambda k: k)) AS n_fails FROM d, s),
g AS (SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT bad) AS kept, sum(n) FILTER (NOT gone AND bad) AS removed,
             sum(n) FILTER (gone AND bad) AS redundant, sum(n) FILTER (bad AND n_fails = 1) AS unique_fails,
             sum(good) FILTER (NOT gone AND bad) AS good_lost, sum(toxic) FILTER (NOT gone AND bad) AS toxic_lost
      FROM r GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in (
    "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM g
"""
