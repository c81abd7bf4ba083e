"""Vector code compression with per-dimension value dictionaries.

Vectors become integers, ``floor(SCALE * x)``, and are written once as blocks of
at most ``BLOCK_ROWS`` vectors.  A block holds, for each dimension, a dictionary
of its distinct integers and each vector's place in it.  To compare a block with
the codebooks, the squared differences of every dictionary entry to all codebook
entries are tabulated for each dimension; the distances of a part are then
gathers of table rows by the dictionary places, added up over its dimensions.

The codebooks (``PARTS`` x ``ENTRIES`` integer vectors) are all that travels
between rounds: each task adds up its blocks' assignments and gives one row for
each codebook component, which Spark sums.  Dictionaries belong to a block, so
memory follows the block's size, not the number of distinct values in the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import lean, materialize, prepare

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK_ROWS = 4096
#: Integers from this on would let a squared distance pass a 64-bit integer.
LARGEST = 1 << 26
#: Sums of at most so many labels are broadcast; beyond that the join shuffles.
BROADCAST_LABELS = 100_000


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, ints) of the vectors without null or non-finite components."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    integer = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    kept = vectors.where(finite).select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"),
                                        integer.alias("ints"))
    small = F.forall("ints", lambda x: F.abs(x) < LARGEST)
    return kept.withColumn("ints", F.when(small, F.col("ints")).otherwise(
        F.raise_error(F.lit(f"a component is too large: {LARGEST // SCALE} or more"))))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(ends) and (ends != ends[0]).any():
        raise ValueError(f"vectors of {ends.min()} and of {ends.max()} components")
    return flat.reshape(len(column), -1)


def _block_rows(kind: pa.Schema):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                ints = _matrix(piece.column("ints"))
                values, places = [], []
                for column in ints.T:
                    distinct, place = np.unique(column, return_inverse=True)
                    values.append(distinct)
                    places.append(place.astype("<u2"))
                row = {"ids": [piece.column("vec_id").to_pylist()], "labels": [piece.column("label").to_pylist()],
                       "n_dims": [ints.shape[1]], "sizes": [[len(x) for x in values]],
                       "values": [b"".join(x.astype("<i8").tobytes() for x in values)],
                       "places": [b"".join(x.tobytes() for x in places)]}
                yield pa.RecordBatch.from_pydict(row, schema=kind)

    return blocks


def vector_blocks(kept: DataFrame) -> DataFrame:
    """The vectors of ``kept`` as dictionary-coded blocks (written once)."""
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: f.dataType for f in kept.schema}
    kind = pa.schema([("ids", pa.list_(to_arrow_type(types["vec_id"]))), ("labels", pa.list_(to_arrow_type(types["label"]))),
                      ("n_dims", pa.int32()), ("sizes", pa.list_(pa.int32())), ("values", pa.binary()), ("places", pa.binary())])
    schema = (f"ids array<{types['vec_id'].simpleString()}>, labels array<{types['label'].simpleString()}>, "
              "n_dims int, sizes array<int>, values binary, places binary")
    return materialize(kept.mapInArrow(lean(_block_rows(kind)), schema), "vector-blocks")


class Block:
    """One row of ``vector_blocks``."""

    def __init__(self, row: dict):
        self.ids, self.labels, n_dims = row["ids"], row["labels"], row["n_dims"]
        ends = np.cumsum(row["sizes"]).astype(np.int64)
        self.values = np.split(np.frombuffer(row["values"], "<i8"), ends[:-1]) if n_dims else []
        self.places = np.frombuffer(row["places"], "<u2").reshape(n_dims, len(self.ids))

    def nearest(self, part: int, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the nearest entry, its squared distance) of every vector's part."""
        n, (entries, width) = len(self.ids), book.shape
        dims = range(part * width, (part + 1) * width)
        most = max((int(np.abs(x).max(initial=0)) for x in (book, *(self.values[d] for d in dims))), default=0)
        kind = np.int32 if width * (2 * most) ** 2 < 1 << 31 else np.int64
        total, row = np.zeros((n, entries), kind), np.empty((n, entries), kind)
        for j, d in enumerate(dims):
            table = ((self.values[d][:, None] - book[None, :, j]) ** 2).astype(kind)
            np.take(table, self.places[d], axis=0, out=row)
            total += row
        best = total.argmin(1)  # the first of equal ones
        return best, total[np.arange(n), best].astype(np.int64)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Block(batch.slice(k, 1).to_pylist()[0])


def _part_sums(books: np.ndarray):
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for block in _blocks_of(batches):
            for p in range(parts):
                best, _ = block.nearest(p, books[p])
                count[p] += np.bincount(best, minlength=entries)
                for j in range(width):
                    own = block.values[p * width + j][block.places[p * width + j]]
                    # at most BLOCK_ROWS * LARGEST: exact as doubles
                    total[p, :, j] += np.bincount(best, own, minlength=entries).astype(np.int64)
        used = np.argwhere(np.repeat(count[:, :, None] > 0, width, 2))
        p, e, j = used.T
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(j, pa.int32()), pa.array(total[p, e, j]),
             pa.array(count[p, e])], names=["part", "entry", "pos", "total", "n"])

    return sums


def _code_rows(books: np.ndarray, kind: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks_of(batches):
            found = [block.nearest(p, book) for p, book in enumerate(books)]
            digits = np.stack([best for best, _ in found], 1).astype(np.uint8).tobytes().hex()
            width = 2 * len(books)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids, kind.field("vec_id").type), pa.array(block.labels, kind.field("label").type),
                 pa.array([digits[k:k + width] for k in range(0, len(digits), width)], pa.string()),
                 pa.array(sum(error for _, error in found))], schema=kind)

    return rows


def first_books(kept: DataFrame, n_dims: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the parts of the vectors with the smallest ids
    (nulls last; of one id, the smaller integers first).  ``entries`` rows at most."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").limit(entries).select("ints").collect()
    seeds = np.array([r.ints for r in rows], np.int64).reshape(len(rows), parts, n_dims // parts)
    return np.ascontiguousarray(seeds.transpose(1, 0, 2))


def next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floored mean of the parts nearest to it; unused ones
    stay.  The sums have one row for each number in the codebooks."""
    rows = blocks.mapInArrow(lean(_part_sums(books)), "part int, entry int, pos int, total long, n long")
    new = books.copy()
    for r in rows.groupBy("part", "entry", "pos").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r.part, r.entry, r.pos] = r.total // r.n
    return new


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of the vectors of ``vectors``.

    Rows whose vector is null or holds a null, NaN or infinite component go; a
    null id or label stays, null ids last in order.  Rows that repeat an id are
    coded one by one.  Vectors without components have distance 0.  An empty table
    gives no rows.  Other columns are never read.  Vectors of different lengths, of
    a length that ``parts`` doesn't divide, or with a component of 262,144 or more
    (whose squares could pass a 64-bit sum) raise an error.
    """
    prepare(vectors.sparkSession)
    kept = quantised(vectors, id_col, vector_col, label_col)
    blocks = vector_blocks(kept)
    dims = [n for n in blocks.agg(F.min("n_dims"), F.max("n_dims")).first() if n is not None] or [0]
    if dims[0] != dims[-1] or dims[0] % parts:
        raise ValueError(f"vectors of {dims[0]} to {dims[-1]} components can't be cut into {parts} equal parts")
    books = first_books(kept, dims[0], parts, min(entries, 256))
    for _ in range(rounds if dims[0] else 0):
        books = next_books(blocks, books)
    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: f.dataType for f in kept.schema}
    kind = pa.schema([("vec_id", to_arrow_type(types["vec_id"])), ("label", to_arrow_type(types["label"])),
                      ("code", pa.string()), ("error", pa.int64())])
    schema = f"vec_id {types['vec_id'].simpleString()}, label {types['label'].simpleString()}, code string, error long"
    return materialize(blocks.mapInArrow(lean(_code_rows(books, kind)), schema), "vector-codes"), books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_report(vectors: DataFrame, **kwargs) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): the codes with the
    error summed over equal labels (nulls together) and the codebooks' digest."""
    codes, books = compress(vectors, **kwargs)
    sums = materialize(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return codes.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""
d{k} AS (SELECT rid, part, entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{k} b USING (part, pos)
         GROUP BY rid, part, entry),
a{k} AS (SELECT rid, part, min(d * 256 + entry) % 256 AS entry, min(d) AS d FROM d{k} GROUP BY rid, part),"""


def _update_sql(k: int) -> str:
    return _round_sql(k) + f"""
m{k} AS (SELECT part, pos, entry, floor(sum(x) / count(*)) AS x FROM p JOIN a{k} USING (rid, part) GROUP BY part, pos, entry),
b{k + 1} AS (SELECT part, pos, entry, CAST(coalesce(m.x, b.x) AS BIGINT) AS x
             FROM b{k} b LEFT JOIN m{k} m USING (part, pos, entry)),"""


ORACLE_SQL = f"""
WITH k AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT rid, len(v) // {PARTS} AS w, unnest(v) AS e, unnest(range(len(v))) AS i FROM k),
p AS MATERIALIZED (SELECT rid, i // w AS part, i % w AS pos, CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT) AS x FROM u),
b0 AS (SELECT part, pos, rid - 1 AS entry, x FROM p WHERE rid <= {ENTRIES}),
{"".join(_update_sql(k) for k in range(ROUNDS))}
{_round_sql(ROUNDS)}
c AS (SELECT rid, string_agg(format('{{:02x}}', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
      FROM a{ROUNDS} GROUP BY rid),
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN c USING (rid), s
"""
