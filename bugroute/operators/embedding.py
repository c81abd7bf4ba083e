"""Embedding training against a parameter table (VEC5), for paragraph and word vectors.

The model is a table (word, weights).  Documents are dealt to slots by a hash of
their key, of ``SLOT_TOKENS`` tokens at least and ``MOST_TOKENS`` at most.  In a round every slot joins the rows
of its own words and of its noise words, goes through its documents in key order on
that local copy, and gives its copy back; the copies of each word are averaged.  No
weight passes through the driver or a broadcast, whatever their number.

* Noise words come from a join: random places on the line of cumulative masses
  (count ** 0.75) meet the words' stretches in buckets.  A slot draws ``POOL`` of
  them a round and picks from these.
* Copies are averaged in the order of word and slot, as sorted rows that stream by:
  the same input gives the same vectors under any partitioning.
* Every round is written to the shared folder; the one before it is deleted, and so
  are its shuffle files.
* A word's weights travel once for each slot that meets it, so more tokens make
  larger slots before they make more of them (``SLOTS``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from bugroute.operators.lookup import SLOT, deal, slots_for, with_rows
from bugroute.session import delete, release_shuffles, scratch_path, ship_package

SLOT_TOKENS = 1 << 16
MOST_TOKENS = 1 << 22
SLOTS = 24               # as many, once there are tokens for them, until these fill ``MOST_TOKENS`` each
POOL = SLOT_TOKENS
MASS_UNIT = 1024         # masses are integers: count ** 0.75 in units of 1 / MASS_UNIT
BIN = 1 << 16            # words of one prefix sum
BROADCAST_WORDS = 1_000_000
LOOKUP_TOKENS = 1 << 20  # tokens of a slot that looks up its words in a larger vocabulary
STEP = 64                # tokens of a document whose gradients are taken together
PAIRS = 512              # (centre, context) pairs whose gradients are taken together
SHARED_NOISE = 32        # noise words of such a batch


# ---------------------------------------------------------------- tables

def token_ids(df: DataFrame, key: str, tokens: str, vocab: DataFrame, keep=(),
              broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(key, keep..., ids): each document's tokens as vocabulary places, in order.

    Words are mapped by one join, and a document is put together again by its key
    alone.  Of a vocabulary too large to broadcast, each slot of documents gets the
    rows of its distinct words, see ``lookup``.  Unknown words are left out; a document without known ones keeps an
    empty list; a null key is a key.  Rows that repeat a key (and ``keep``) are one
    document, their tokens in order of place.
    """
    words = vocab.select(F.col("word").alias("__word"), F.col("idx").cast("int").alias("__id"))
    place = F.when(F.col("__id").isNotNull(), F.struct("__pos", "__id"))
    ids = F.transform(F.sort_array(F.collect_list(place)), lambda x: x["__id"]).alias("ids")
    own = [key, *keep]
    if vocab.count() <= broadcast_words:   # measured
        flat = df.select(*own, F.posexplode_outer(tokens).alias("__pos", "__word"))
        return flat.join(F.broadcast(words), "__word", "left").groupBy(*own).agg(ids)
    slots = slots_for(df, df.agg(F.sum(F.size(tokens))).first()[0] or 0, LOOKUP_TOKENS)
    flat = deal(df.select(*own, tokens), own, slots).select(SLOT, *own, F.posexplode_outer(tokens).alias("__pos", "__word"))
    return with_rows(flat, own, "__word", words, slots, "left").groupBy(SLOT, *own).agg(ids).drop(SLOT)


def noise_lines(vocab: DataFrame) -> tuple[DataFrame, int, int]:
    """((bucket, idx, low, high), total, width): each word's stretch [low, high) of
    the line of cumulative masses, once for every bucket of ``width`` that it
    reaches into.  Prefix sums run within bins of words; only one row a bin meets
    in a single window."""
    mass = F.greatest(F.floor(F.pow(F.col("count").cast("double"), F.lit(0.75)) * MASS_UNIT), F.lit(1)).cast("long")
    rows = vocab.select(F.col("idx").cast("int").alias("idx"), mass.alias("mass"), F.floor(F.col("idx") / BIN).alias("bin"))
    sums = rows.groupBy("bin").agg(F.sum("mass").alias("all"))
    starts = sums.select("bin", (F.sum("all").over(W.orderBy("bin")) - F.col("all")).alias("start"))
    inside = F.sum("mass").over(W.partitionBy("bin").orderBy("idx"))
    lines = rows.withColumn("to", inside).join(starts, "bin").select(
        "idx", (F.col("start") + F.col("to") - F.col("mass")).alias("low"), (F.col("start") + F.col("to")).alias("high"))
    stats = rows.agg(F.sum("mass"), F.count(F.lit(1))).first()
    total, n = stats[0] or 0, stats[1]
    width = max(1, math.ceil(total / max(n, 1)))
    buckets = F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))
    return lines.select(F.explode(buckets).alias("bucket"), "idx", "low", "high"), total, width


def draw_noise(spark: SparkSession, lines: DataFrame, total: int, width: int, slots: int, seed: int, epochs: int = 1,
               shared: bool = False) -> DataFrame:
    """(epoch, slot, idx, n): ``POOL`` noise words for every epoch and slot, the same
    ones for all slots if ``shared``."""
    if not total:
        return spark.createDataFrame([], "epoch int, slot int, idx int, n long")
    number = F.pmod(F.col("id"), F.lit(POOL)) if shared else F.col("id")
    turn = F.floor(F.col("id") / POOL)
    draws = spark.range(epochs * slots * POOL).select(
        (F.floor(turn / slots) + 1).cast("int").alias("epoch"), F.pmod(turn, F.lit(slots)).cast("int").alias("slot"),
        F.pmod(F.xxhash64(number, F.lit(seed)), F.lit(total)).alias("at"))
    draws = draws.withColumn("bucket", F.floor(F.col("at") / width))
    return draws.join(lines, "bucket").where("low <= at and at < high").groupBy("epoch", "slot", "idx").agg(
        F.count(F.lit(1)).alias("n"))


def needed(docs: DataFrame, vocab: DataFrame, slots: int, seed: int, epochs: int, path: str, shared: bool = False) -> DataFrame:
    """(epoch, slot, idx, n): the words that a slot meets in an epoch, n times as
    noise; written once, by epoch."""
    lines, total, width = noise_lines(vocab)
    noise = draw_noise(docs.sparkSession, lines, total, width, slots, seed, epochs, shared)
    own = docs.select("slot", F.explode("ids").alias("idx")).distinct()
    every = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch")
    own = own.select(every, F.col("slot"), "idx", F.lit(0).cast("long").alias("n"))
    own.unionByName(noise).groupBy("epoch", "slot", "idx").agg(F.sum("n").alias("n")).write.partitionBy("epoch").parquet(path)
    return docs.sparkSession.read.parquet(path)


def dealt(ids: DataFrame, key: str) -> tuple[DataFrame, int, str]:
    """(documents with slot and hash, slots, folder): written once."""
    base = scratch_path(ids.sparkSession, "embedding")
    ids.withColumn("__hash", F.xxhash64(key)).write.parquet(f"{base}/ids")
    rows = ids.sparkSession.read.parquet(f"{base}/ids")
    total = rows.agg(F.sum(F.size("ids"))).first()[0] or 0
    slots = max(1, math.ceil(total / MOST_TOKENS), min(SLOTS, math.ceil(total / SLOT_TOKENS)))
    return rows.withColumn("slot", F.pmod("__hash", F.lit(slots)).cast("int")), slots, base


def _matrix(column, width: int) -> np.ndarray:
    """(n, width) weights of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, width)


def _binary(weights: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(weights, "<f4").tobytes()
    size = 4 * weights.shape[1]
    return pa.array([raw[k:k + size] for k in range(0, len(raw), size)], pa.binary())


def _averages(width: int):
    """Rows (idx, w) in order of idx and slot -> the mean of each idx."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None   # (idx, sum, copies) of the last one so far
        for batch in batches:
            if not batch.num_rows:
                continue
            idx, w = batch.column("idx").to_numpy(), _matrix(batch.column("w"), width).astype(np.float64)
            first = np.flatnonzero(np.concatenate([[True], idx[1:] != idx[:-1]]))
            words, sums = idx[first], np.add.reduceat(w, first)
            copies = np.diff(np.append(first, len(idx)))
            if held and held[0] == words[0]:
                sums[0] += held[1]
                copies[0] += held[2]
            elif held:
                words, sums, copies = np.append(held[0], words), np.concatenate([held[1][None], sums]), np.append(held[2], copies)
            held = words[-1], sums[-1], copies[-1]
            if len(words) > 1:
                yield _mean_rows(words[:-1], sums[:-1], copies[:-1])
        if held:
            yield _mean_rows(np.array([held[0]]), held[1][None], np.array([held[2]]))

    return rows


def _mean_rows(words: np.ndarray, sums: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), _binary(sums / copies[:, None])], names=["idx", "w"])


def as_arrays(weights: DataFrame, width: int, dims: int) -> DataFrame:
    """(idx, vector array<float>): the first ``dims`` of a word's ``width`` weights."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.ascontiguousarray(_matrix(batch.column("w"), width)[:, :dims])
            ends = pa.array(np.arange(0, values.size + 1, dims, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("idx"), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))],
                                             names=["idx", "vector"])

    return weights.mapInArrow(rows, "idx int, vector array<float>")


def _documents(batch: pa.RecordBatch, idx: np.ndarray) -> list:
    """(hash, places of the tokens among the slot's words, vector or None) of every document."""
    return [(h, np.searchsorted(idx, ids.values.to_numpy()), v.values.to_numpy().astype(np.float32) if v.is_valid else None)
            for h, ids, v in zip(batch.column("__hash").to_pylist(), batch.column("ids"), batch.column("vector"))]


def slot_rows(docs: DataFrame, need: DataFrame, slots: int) -> DataFrame:
    """One partition a slot: its words in order, then its documents in key order,
    so that a task holds the slot's weights and streams its documents."""
    rows = docs.withColumn("kind", F.lit(1)).unionByName(need.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    key = [c for c in docs.columns if c not in ("slot", "__hash", "ids", "vector")]
    return rows.repartitionById(slots, F.col("slot")).sortWithinPartitions("kind", "idx", "__hash", *key)


def slot_parts(batches: Iterator[pa.RecordBatch], width: int, start) -> Iterator[tuple]:
    """The words (idx, weights, pool of noise words as places among them), then
    batches of the documents."""
    idx, weights, drawn, words = [], [], [], None
    for batch in batches:
        n = int((batch.column("kind").to_numpy() == 0).sum())
        if n:
            part = batch.slice(0, n)
            idx.append(part.column("idx").to_numpy())
            drawn.append(part.column("n").to_numpy())
            weights.append(_matrix(part.column("w"), width) if "w" in part.schema.names else start(idx[-1]))
        if n < batch.num_rows:
            if words is None:
                words = np.concatenate([np.empty(0, np.int32), *idx])
                pool = np.repeat(np.arange(len(words)), np.concatenate([np.empty(0, np.int64), *drawn]))
                yield words, np.concatenate([np.empty((0, width), np.float32), *weights]), pool
                weights = []
            yield batch.slice(n)


def rounds(docs: DataFrame, key: str, slots: int, base: str, vocab: DataFrame, width: int, train, start, epochs: int, seed: int,
           after=None) -> tuple[DataFrame, DataFrame]:
    """Run ``epochs`` rounds; returns the tables (key, vector) and (idx, w).

    ``train(documents, weights, pool, epoch)`` goes through a batch of a slot's
    documents, changes ``weights`` in place and gives the documents' vectors (or
    Nones); ``start(idx)`` gives the first weights of words; ``after(epoch,
    vectors)`` is called once a round is written.
    """
    spark = docs.sparkSession
    ship_package(spark)
    need = needed(docs, vocab, slots, seed, epochs, f"{base}/need")
    docs = docs.select(key, "__hash", "slot", "ids", F.lit(None).cast("array<float>").alias("vector"))
    schema = StructType([StructField(f.name, f.dataType) for f in docs.schema]).add("idx", "integer").add("w", "binary")
    out = to_arrow_schema(schema)
    weights = None

    def task(epoch):
        def run(batches):
            parts = slot_parts(batches, width, start)
            words = next(parts, None)
            if words is None:   # no documents: no vote
                return
            idx, w, pool = words
            for batch in parts:
                vectors = train(_documents(batch, idx), w, pool, epoch)
                columns = {n: batch.column(n) for n in (key, "__hash", "slot", "ids")}
                columns["vector"] = pa.array(vectors, pa.list_(pa.float32()))
                yield _rows(columns, batch.num_rows, out)
                slot = batch.column("slot")[0].as_py()
            for a in range(0, len(idx), 4096):
                n = len(idx[a:a + 4096])
                yield _rows({"slot": pa.array(np.full(n, slot, np.int32)), "idx": pa.array(idx[a:a + n]), "w": _binary(w[a:a + n])}, n, out)

        return run

    for epoch in range(1, epochs + 1):
        now = need.where(F.col("epoch") == epoch).select("slot", "idx", "n")
        now = now if weights is None else now.join(weights, "idx")
        path = f"{base}/epoch-{epoch}"
        slot_rows(docs, now, slots).mapInArrow(task(epoch), schema).write.parquet(path)
        result = spark.read.schema(schema).parquet(path)
        docs = result.where("idx is null").select(key, "__hash", "slot", "ids", "vector")
        copies = result.where("idx is not null").select("idx", "slot", "w").repartition("idx").sortWithinPartitions("idx", "slot")
        weights = copies.select("idx", "w").mapInArrow(_averages(width), "idx int, w binary")
        if after:
            after(epoch, docs.select(key, "vector"))
        if epoch > 1:
            delete(spark, f"{base}/epoch-{epoch - 1}")
        del now, result, copies
        release_shuffles(spark)
    weights.write.parquet(f"{base}/weights")
    return docs.select(key, "vector"), spark.read.schema("idx int, w binary").parquet(f"{base}/weights")


def _rows(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """``columns`` with nulls for the others of ``schema``."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema],
                                      schema=schema)


# ---------------------------------------------------------------- gradients

def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def uniform(numbers: np.ndarray, seed: int, dims: int) -> np.ndarray:
    """(n, dims) start weights in +-0.5 / dims, from each number alone."""
    x = numbers.astype(np.uint64)[:, None] * np.uint64(dims) + np.arange(dims, dtype=np.uint64)
    x += np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (((x >> np.uint64(40)).astype(np.float32) / (1 << 24) - 0.5) / dims).astype(np.float32)


def rate_of(epoch: int, epochs: int, lr: float, min_lr: float) -> float:
    return lr - (lr - min_lr) * (epoch - 1) / max(1, epochs - 1)


def dbow_pass(ids, v, out, pool, lr, negative, rng, update_out=True):
    """One pass of PV-DBOW over a document's tokens: the document vector learns to
    tell them from noise words.  Changes ``out`` in place, returns the vector."""
    labels = np.zeros((1, negative + 1), np.float32)
    labels[0, 0] = 1.0
    for a in range(0, len(ids), STEP):
        own = ids[a:a + STEP]
        noise = pool[rng.integers(0, len(pool), (len(own), negative))]
        targets = np.concatenate([own[:, None], noise], 1)
        u = out[targets]
        g = ((labels - _sigmoid(u @ v)) * lr).astype(np.float32)
        if update_out:
            add_rows(out, targets.ravel(), g.reshape(-1, 1) * v)
        v = v + np.einsum("nk,nkd->d", g, u)
    return v


def add_rows(target: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """target[places] += rows, with repeated places added up."""
    order = np.argsort(places, kind="stable")
    sorted_places = places[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_places[1:] != sorted_places[:-1]]))
    target[sorted_places[first]] += np.add.reduceat(rows[order], first)


def skipgram_pairs(texts: list[np.ndarray], window: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(centres, contexts) of all texts: each token with those at most b places
    away, b drawn for each token from 1 to ``window``."""
    ids = np.concatenate(texts)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    reach = rng.integers(1, window + 1, len(ids))
    centres, contexts = [], []
    for d in range(1, window + 1):
        same = text[d:] == text[:-d]
        for centre, context in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            near = same & (reach[centre] >= d)
            centres.append(ids[centre][near])
            contexts.append(ids[context][near])
    return np.concatenate(centres), np.concatenate(contexts)


def skipgram_pass(texts: list[np.ndarray], weights: np.ndarray, pool: np.ndarray, lr: float, window: int, negative: int, rng) -> None:
    """One pass of skip-gram with negative sampling; ``weights`` holds a word's
    vector and its output weights side by side.  The noise words of a batch of
    pairs are shared, each with the weight of ``negative`` in ``SHARED_NOISE``."""
    dims = weights.shape[1] // 2
    syn0, syn1 = weights[:, :dims], weights[:, dims:]
    texts = [t for t in texts if len(t) > 1]
    if not texts or not len(pool):
        return
    centres, contexts = skipgram_pairs(texts, window, rng)
    order = rng.permutation(len(centres))
    for a in range(0, len(order), PAIRS):
        c, o = centres[order[a:a + PAIRS]], contexts[order[a:a + PAIRS]]
        noise = pool[rng.integers(0, len(pool), SHARED_NOISE)]
        v, u, n = syn0[c], syn1[o], syn1[noise]
        g = ((1.0 - _sigmoid(np.einsum("pd,pd->p", v, u))) * lr).astype(np.float32)[:, None]
        gn = (-_sigmoid(v @ n.T) * (lr * negative / SHARED_NOISE)).astype(np.float32)
        add_rows(syn0, c, g * u + gn @ n)
        add_rows(syn1, o, g * v)
        add_rows(syn1, noise, gn.T @ v)


# ---------------------------------------------------------------- word vectors

def train_word_vectors(df: DataFrame, key: str, tokens: str = "tokens", dims: int = 100, epochs: int = 20,
                       lr: float = 0.025, min_lr: float = 0.001, window: int = 5, negative: int = 5, min_count: int = 1,
                       seed: int = 12345) -> DataFrame:
    """(word, idx, vector array<float>): skip-gram vectors of all words of ``df``.

    A row is a text, named by ``key``; windows don't cross texts.  Rows without
    tokens teach nothing; without any words there are no rows.
    """
    from bugroute.operators.vectors import build_vocab

    vocab = build_vocab(df.select(tokens), tokens, min_count)
    docs, slots, base = dealt(token_ids(df, key, tokens, vocab), key)

    def train(documents, weights, pool, epoch):
        rng = np.random.default_rng([seed, epoch, *(h & 0xFFFFFFFF for h, _, _ in documents[:1])])
        skipgram_pass([ids for _, ids, _ in documents], weights, pool, rate_of(epoch, epochs, lr, min_lr), window, negative, rng)
        return [None] * len(documents)

    def start(idx):
        return np.concatenate([uniform(idx, seed, dims), np.zeros((len(idx), dims), np.float32)], 1)

    _, weights = rounds(docs, key, slots, base, vocab, 2 * dims, train, start, epochs, seed)
    return vocab.select("word", F.col("idx").cast("int").alias("idx")).join(
        as_arrays(weights, 2 * dims, dims), "idx").select("word", "idx", "vector")
