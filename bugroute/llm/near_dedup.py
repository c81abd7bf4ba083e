"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its 5-word shingles.  Its signature has
``REGISTERS`` buckets; bucket i keeps the smallest value that the i-th keyed
hash takes on the set, as the number of leading zeros (6 bits) and the next
``MANTISSA`` bits: 16 bits a bucket instead of 64.  Equal sets are one class
from here on.  Bands of ``ROWS`` registers make the candidate buckets.

Links are found without ever listing the pairs of a bucket: first each member
with the bucket's least member and with its neighbour in hash order; then, only
in buckets whose members still lie in several components, the collision-corrected
similarity of the registers tells block by block which members may be linked with
another component, and these go through an exact similarity join with prefix,
length and positional filters.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugroute.llm.common import SPACE_WORD, WordHash, gram_hashes, lean, materialize, mix64, prepare, slices
from bugroute.llm.components import components, relabel
from bugroute.llm.similarity import prefix_pairs

SHINGLE = 5
PERCENT = 75  # of the union that linked sets share at least
REGISTERS, ROWS, MANTISSA = 63, 3, 10
BANDS = REGISTERS // ROWS  # a pair at 0.75 misses all 21 bands once in 100,000
LOWEST_ESTIMATE = 0.5  # 4.6 standard errors below 0.75
BLOCK = 1024
BITS_LOG2 = 25

_KEYS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, words_of: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than SHINGLE words are one shingle."""
    words = text.lower().split()
    hashes = np.fromiter((words_of[w] for w in words), np.uint64, len(words))
    if not len(words):
        return hashes
    if len(words) < SHINGLE:
        return mix64(gram_hashes(hashes, len(words)) ^ np.uint64(len(words)))
    return np.unique(gram_hashes(hashes, SHINGLE))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set."""
    least = np.full(REGISTERS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[a:a + 2048, None] * _KEYS).min(0), out=least)
    fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    return (zeros << MANTISSA | mantissa).astype(np.uint16)


def chance_of_zeros(n: np.ndarray) -> np.ndarray:
    """(set, k): chance that a bucket of a set of n values has k leading zeros."""
    k = np.arange(0, 50)
    n = n[:, None].astype(np.float64)
    return np.exp(n * np.log1p(-2.0 ** -(k + 1))) - np.where(k > 0, np.exp(n * np.log1p(-np.minimum(2.0 ** -k, 0.999999999))), 0)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of all sets of ``a`` with all of ``b`` by the share of equal
    registers, less the share that different minima give by chance."""
    equal = np.zeros((len(a), len(b)), np.float32)
    for k in range(REGISTERS):
        equal += a[:, k, None] == b[None, :, k]
    chance = chance_of_zeros(n_a) @ chance_of_zeros(n_b).T / (1 << MANTISSA)
    return (equal / REGISTERS - chance) / (1 - chance)


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words_of = WordHash()
    for batch in batches:
        for part in slices(batch, "text"):
            sizes, digests, signs, raws = [], [], [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                s = shingle_set(text or b"", words_of)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
                raws.append(xxhash.xxh3_64_intdigest(text or b""))
            yield pa.RecordBatch.from_arrays(
                [part.column("rid"), part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signs, pa.binary()), pa.array(np.array(raws, np.uint64).view(np.int64))],
                names=["rid", "doc_id", "text_key", "n_shingles", "digest", "sign", "raw"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node) of every class: the hash of each band's registers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
        key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(regs), 1))
        for k in range(ROWS):
            key = key << np.uint64(16) | regs[:, :, k]
        nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(mix64(key).view(np.int64).ravel()), pa.array(nodes)],
                                         names=["bucket", "node"])


def _bit_table(raws: DataFrame) -> np.ndarray:
    """Marks the texts whose sets are wanted; its size doesn't depend on the data."""
    place = raws.select(F.col("raw").bitwiseAND((1 << BITS_LOG2) - 1).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (BITS_LOG2 - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table


def _set_rows(bits):
    """(digest, shingles) of the marked texts, once a task for each of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words_of, given = bits.value, WordHash(), set()
        for batch in batches:
            for part in slices(batch, "text"):
                digests, sets = [], []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    raw = xxhash.xxh3_64_intdigest(text or b"")
                    p = raw & ((1 << BITS_LOG2) - 1)
                    if raw in given or not int(table[p >> 6]) >> (p & 63) & 1:
                        continue
                    if len(given) < 1_000_000:
                        given.add(raw)
                    s = shingle_set(text or b"", words_of)
                    if len(s):
                        digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                        sets.append(pa.array(s.view(np.int64)))
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.concat_arrays(sets) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()),
                                                  pa.ListArray.from_arrays(pa.array(ends), flat)], names=["digest", "shingles"])

    return rows


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (bucket, cell), the nodes that may be linked with one of
    another component by estimate and size.  Cells have at most two blocks of rows."""

    def found(group: pa.Table) -> np.ndarray:
        query = group.column("query").to_numpy(zero_copy_only=False)
        q, d = np.flatnonzero(query), np.flatnonzero(~query)
        node, label, size = (group.column(c).to_numpy() for c in ("node", "label", "n_shingles"))
        if not len(q) or not len(d):
            return node[:0]
        sign = np.frombuffer(b"".join(group.column("sign").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        near = estimate(sign[q], sign[d], size[q], size[d])
        small = np.minimum(size[q][:, None], size[d][None]) * 100 >= PERCENT * np.maximum(size[q][:, None], size[d][None])
        near = small & (near >= LOWEST_ESTIMATE) & (label[q][:, None] != label[d][None])
        return np.concatenate([node[q][near.any(1)], node[d][near.any(0)]])

    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        keys = np.stack([rest.column("bucket").to_numpy(), rest.column("cell").to_numpy()])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        nodes = [found(rest.slice(a, b - a)) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        rest = rest.slice(int(cuts[-1])) if len(cuts) else rest
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.empty(0, np.int64), *nodes])))], names=["node"])
    if rest is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(found(rest)))], names=["node"])


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose estimate and sizes allow a link."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
        n_x, n_y = batch.column("n_x").to_numpy(), batch.column("n_y").to_numpy()
        chance = (chance_of_zeros(n_x) * chance_of_zeros(n_y)).sum(1) / (1 << MANTISSA)
        near = ((x == y).mean(1) - chance) / (1 - chance)
        ok = (near >= LOWEST_ESTIMATE) & (np.minimum(n_x, n_y) * 100 >= PERCENT * np.maximum(n_x, n_y))
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in "ab"], names=["a", "b"])




class _Links:
    """The candidate search and its confirmation for one run."""

    def __init__(self, texts: DataFrame, classes: DataFrame):
        self.classes = classes
        buckets = materialize(classes.select("node", "sign").mapInArrow(_band_rows, "bucket long, node long"), "near-bands")
        full = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        self.members = materialize(buckets.join(full, "bucket"), "near-buckets")
        # the sets of all classes that share a bucket: one more pass over the texts
        wanted = materialize(classes.join(self.members.select("node").distinct(), "node").select("node", "digest", "raw"),
                             "near-wanted")
        bits = texts.sparkSession.sparkContext.broadcast(_bit_table(wanted))
        sets = texts.select("text").mapInArrow(lean(_set_rows(bits)), "digest binary, shingles array<long>")
        # copies of a text come from several tasks; their sets are equal
        self.sets = materialize(
            sets.join(wanted, "digest").groupBy("node").agg(F.any_value("shingles").alias("s")), "near-sets")

    def first_pairs(self) -> DataFrame:
        """Each member with its bucket's least member, and with the one before it
        among the members of the same thousand in hash order."""
        least = self.members.groupBy("bucket").agg(F.min("node").alias("low"))
        star = self.members.join(least, "bucket").select(F.col("low").alias("a"), F.col("node").alias("b"))
        # the chain is cut into pieces of about BLOCK members, so no window gets a whole bucket
        piece = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)))
        chain = self.members.select("bucket", "node", piece.alias("piece")).select(
            "node", F.lag("node").over(W.partitionBy("bucket", "piece").orderBy(F.xxhash64("node", F.lit(1)))).alias("to"))
        chain = chain.where("to is not null").select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b"))
        return star.where("a != b").unionByName(chain).distinct()

    def likely(self, pairs: DataFrame) -> DataFrame:
        x = self.classes.select(F.col("node").alias("a"), F.col("sign").alias("x"), F.col("n_shingles").alias("n_x"))
        y = self.classes.select(F.col("node").alias("b"), F.col("sign").alias("y"), F.col("n_shingles").alias("n_y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(_likely_rows, "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are linked."""
        both = pairs.join(self.sets.toDF("a", "x"), "a").join(self.sets.toDF("b", "y"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        both = both.select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("total"))
        return materialize(both.where(f"100 * n >= {PERCENT} * (total - n)").select("a", "b"), "near-links")

    def open_pairs(self, labels: DataFrame) -> DataFrame:
        """The pairs over components that may still be linked: the estimates of
        all such pairs of a bucket are looked at block by block, and the nodes
        that they leave go through an exact similarity join of their sets."""
        of = self.members.join(labels.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
            "bucket", "node", F.coalesce("label", "node").alias("label"))
        per = of.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        per = per.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"),
                                        F.sum("n").alias("n_all")).where("n_main < n_all")
        of = of.join(per, "bucket").withColumn("asks", F.col("label") != F.col("main"))
        n_data = F.ceil(F.col("n_all") / BLOCK).cast("int")
        n_query = F.ceil((F.col("n_all") - F.col("n_main")) / BLOCK).cast("int")
        block = F.xxhash64("node")
        data = of.select("bucket", "node", "label", F.lit(False).alias("query"), F.explode(
            F.transform(F.sequence(F.lit(0), n_query - 1), lambda q: q * n_data + F.pmod(block, n_data).cast("int"))).alias("cell"))
        asks = of.where("asks").select("bucket", "node", "label", F.lit(True).alias("query"), F.explode(
            F.transform(F.sequence(F.lit(0), n_data - 1), lambda d: F.pmod(block, n_query).cast("int") * n_data + d)).alias("cell"))
        cells = data.unionByName(asks).join(self.classes.select("node", "sign", "n_shingles"), "node")
        cells = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "node")
        nodes = cells.mapInArrow(_open_rows, "node long").distinct().join(labels, "node", "left").select(
            "node", F.coalesce("label", "node").alias("label"))
        return prefix_pairs(materialize(nodes.join(self.sets, "node"), "near-open"), PERCENT)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, component_id,
    kept, class_id.

    Sets of 5-word shingles of the lower-cased text (A-Z) are linked if they
    share 75 per cent of their union; component_id is the least doc_id that can
    be reached.  Null texts and texts without words have an empty set and stand
    alone; rows with equal texts are linked; a null id is only reached from its
    own row or a component of null ids.  An empty table gives no rows; other
    columns are never read.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                        F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = materialize(texts.mapInArrow(
        lean(_document_rows), f"rid long, doc_id {kind}, text_key long, n_shingles long, digest binary, sign binary, raw long"), "near-documents")
    classes = materialize(
        rows.where("digest is not null").groupBy("digest").agg(
            F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.min("sign").alias("sign"),
            F.min("n_shingles").alias("n_shingles"), F.min("raw").alias("raw")), "near-classes")
    links = _Links(texts, classes)
    labels = materialize(components(links.confirmed(links.likely(links.first_pairs()))), "near-labels")
    found = links.confirmed(links.open_pairs(labels))
    tied = found.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left").select(
        F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    new = tied.select(F.explode(F.array("la", "lb")).alias("node")).distinct()
    every = labels.unionByName(new.select("node", F.col("node").alias("label"))).distinct()
    labels = materialize(relabel(every, tied), "near-labels")
    named = classes.join(labels, "node", "left").select("digest", "low", F.coalesce("label", "node").alias("class_id"))
    least = named.groupBy("class_id").agg(F.min("low").alias("component_id"))
    named = named.join(least, "class_id").select("digest", "class_id", "component_id")
    return rows.join(named, "digest", "left").select(
        "doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"),
        F.coalesce("class_id", "rid").alias("class_id"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '{SPACE_WORD}') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(list_slice(w, i, i + {SHINGLE - 1}), ' ')
                          FOR i IN range(1, len(w) - {SHINGLE - 2})]) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n, s[1:len(s)] AS s FROM g),
e AS (SELECT doc_id, n, unnest(s) AS x FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.c AS component_id, n.doc_id = m.c AS kept
FROM n JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
