"""Language-model scores by online logistic context mixing.

The model predicts a text byte by byte, each byte as the binary decisions on its
way down a Huffman tree (one for each last byte, and one of its own for each of
the ``PAIRS`` most frequent pairs of last bytes, built from the training texts'
counts, an end-of-text symbol included).  Each predictor looks up the decision
under a hash of its context (the last two or four bytes, or the word so far) in a
table of counts summed over all training texts, and gives the logarithm of the
odds.  A mixer adds these with weights of its own for each gate (the class of the
last byte), and an adaptive map corrects the result by what has come of similar
predictions.  Weights and map learn online: after each byte they move along the
error of its decisions.  The score is the logarithm of the product of all
decisions' probabilities, so it is the probability of the text under one model;
divided by the bytes it gives bits a byte.

Texts are scored in lanes that go forward together, one byte at a time, as array
operations.  A lane is a segment of ``SEGMENT`` bytes of a text: contexts reach
back over the segment's start, weights and map begin anew there, so that a
text's score does not depend on the texts around it.

Tables have a fixed size (``SLOTS_LOG2``).  Tasks send their count tables in
blocks; blocks are added in rounds of ``FAN_IN`` tasks, so no sum ever gathers
more than that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import lean, materialize, prepare, slices

END = 256
SYMBOLS = 257
CONTEXTS = 3
SLOTS_LOG2 = (17, 20, 21)  # slots of each context's table
SEGMENT = 2048
WARM_UP = 24  # bytes before a segment that make up its first contexts
GATES = 4
FIRST_WEIGHT = 0.42
RATE = 0.008
BUCKETS = 32  # of the adaptive map, over probabilities
MAP_RATE = 0.02
MAP_SHARE = 0.25  # of the map in the result
PRIOR = 0.2
CHUNK = 12 << 20
TRAIN_CHUNK = 2 << 20
PAIRS = 128
BLOCK = 1 << 17  # counts that travel in one row
FAN_IN = 32

_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_WORD = np.uint32(0x2C1B3C6D)


def _mixed(recent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(context, place): 32-bit hashes of the contexts; recent: the last four bytes."""
    context = np.stack([recent & np.uint32(0xFFFF), recent, word])
    context ^= context >> np.uint32(15)
    context *= _MUL[:, None]
    context ^= context >> np.uint32(13)
    return context


def _slots(k: int, context: np.ndarray, node: np.ndarray) -> np.ndarray:
    return (context ^ node) * np.uint32(0x85EBCA6B) >> np.uint32(32 - SLOTS_LOG2[k])


def empty_counts() -> list[np.ndarray]:
    """A count for each slot and bit, context by context."""
    return [np.zeros(2 << b, np.int32) for b in SLOTS_LOG2]


class Code:
    """The decisions (tree node, bit) of every choice (tree, symbol), behind one
    another; a choice is ``tree * SYMBOLS + symbol``.  ``tree`` gives the tree of
    each pair of last bytes (``before last * 256 + last``)."""

    def __init__(self, counts: np.ndarray):
        """``counts``: how often each (pair of last bytes, symbol) comes."""
        counts = counts.reshape(256, 256, SYMBOLS)
        by_pair = counts.sum(2).ravel()
        own = np.sort(np.argsort(-by_pair, kind="stable")[:PAIRS])
        own = own[by_pair[own] > 0]
        self.tree = np.tile(np.arange(256), 256)
        self.tree[own] = 256 + np.arange(len(own))
        tables = np.concatenate([counts.sum(0), counts.reshape(-1, SYMBOLS)[own]])
        paths = [p for tree in tables.tolist() for p in self._paths(tree)]
        self.length = np.array([len(p) for p in paths], np.int64)
        self.first = np.cumsum(self.length) - self.length
        tree = np.repeat(np.arange(len(paths)) // SYMBOLS * SYMBOLS, self.length)
        node = tree + np.array([n for p in paths for n, _ in p])
        self.node = node.astype(np.uint32) * np.uint32(0x165667B1)
        self.bit = np.array([b for p in paths for _, b in p], np.float32)

    @staticmethod
    def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
        heap = [(64 * c + 1, s, s) for s, c in enumerate(counts)]  # every byte may come
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(SYMBOLS, 2 * SYMBOLS - 1):
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            parent[x], parent[y] = (node, 0), (node, 1)
            heapq.heappush(heap, (a + b, node, node))
        paths = []
        for s in range(SYMBOLS):
            path = []
            while s in parent:
                s, bit = parent[s]
                path.append((s - SYMBOLS, bit))
            paths.append(path[::-1])
        return paths


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(choice, times) of each (pair of last bytes, symbol) that comes in the texts;
    before a text stand two zero bytes."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    data = np.frombuffer(b"".join(b"\0\0" + t + b"\0" for t in texts), np.uint8).astype(np.int32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    ends = np.cumsum(size) - 1
    symbol = data[2:].copy()
    symbol[ends - 2] = END
    place = (data[:-2] * 256 + data[1:-1]) * SYMBOLS + symbol
    inside = np.ones(len(place), bool)
    inside[ends[:-1] - 1], inside[ends[:-1]] = False, False
    return np.unique(place[inside], return_counts=True)


def trigram_counts(texts: list[bytes]) -> np.ndarray:
    """The counts of all choices."""
    counts = np.zeros((1 << 16) * SYMBOLS, np.int64)
    at, times = trigrams(texts)
    counts[at] = times
    return counts


# The gate of each byte: blanks, letters of either case and UTF-8 parts, all else.
_GATE = np.full(256, 3, np.int64)
_GATE[[0, 9, 10, 32]] = 0
_GATE[np.r_[97:123]] = 1
_GATE[np.r_[65:91, 128:256]] = 2


class Lanes:
    """The segments of some texts; ``steps`` yields, byte by byte, the lanes
    that still have a byte, their choices, contexts and gates."""

    def __init__(self, texts: list[bytes], code: Code):
        self.tree = code.tree
        size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1  # with the end
        self.bytes = np.frombuffer(b"".join(bytes(WARM_UP) + t + b"\0" for t in texts), np.uint8)
        first = np.cumsum(size + WARM_UP) - size
        n = -(-size // SEGMENT)
        self.text = np.repeat(np.arange(len(texts)), n)
        nth = np.arange(len(self.text)) - np.repeat(np.cumsum(n) - n, n)
        start = first[self.text] + nth * SEGMENT
        stop = np.minimum(start + SEGMENT, (first + size)[self.text])
        order = np.argsort(start - stop, kind="stable")
        self.text, self.start, self.count = self.text[order], start[order], (stop - start)[order]
        last = (stop == (first + size)[np.repeat(np.arange(len(texts)), n)])[order]
        self.end_at = np.where(last, self.count - 1, -1)

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        n = len(self.start)
        recent = np.zeros(n, np.uint32)  # the last four bytes
        word = np.zeros(n, np.uint32)  # hash of the word so far
        n_steps = int(self.count[0]) if n else 0
        active = np.searchsorted(-self.count, -np.arange(n_steps), side="left")
        for t in range(-WARM_UP, n_steps):
            a = active[t] if t >= 0 else n
            recent, word = recent[:a], word[:a]
            now = self.bytes[self.start[:a] + t]
            if t >= 0:
                symbol = now.astype(np.int64)
                symbol[self.end_at[:a] == t] = END
                tree = self.tree[recent & np.uint32(0xFFFF)]
                yield a, tree * SYMBOLS + symbol, _mixed(recent, word), _GATE[recent & np.uint32(0xFF)]
            recent = recent << np.uint32(8) | now
            word = np.where(_GATE[now] == 0, np.uint32(0), (word + now + np.uint32(1)) * _WORD)


def _decisions(code: Code, choice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first decision of each choice, choice of each decision, its place in the code)."""
    length = code.length[choice]
    ends = np.cumsum(length)
    first = ends - length
    lane = np.repeat(np.arange(len(choice)), length)
    return first, lane, np.arange(len(lane)) + (code.first[choice] - first)[lane]


def _contexts(texts: list[bytes], code: Code) -> tuple[np.ndarray, np.ndarray]:
    """(choices, contexts) of all bytes and ends of the texts at once."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(bytes(4) + t + b"\0" for t in texts), np.uint8)
    end = np.cumsum(size + 5) - 1
    at = np.arange(len(data), dtype=np.int64)
    inside = np.ones(len(data), bool)
    for k in range(4):
        inside[end - size - 1 - k] = False  # the bytes put before a text
    wide = np.concatenate([np.zeros(4, np.uint8), data]).astype(np.uint32)
    recent = wide[3:-1] | wide[2:-2] << np.uint32(8) | wide[1:-3] << np.uint32(16) | wide[:-4] << np.uint32(24)
    # the rolling word hash as a difference of sums, over powers of its factor modulo 2**32
    power = np.full(len(data) + 1, _WORD, np.uint32)
    power[0] = 1
    back = np.full(len(data), np.uint32(pow(int(_WORD), -1, 1 << 32)))
    back[:1] = 1
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum((wide[4:] + np.uint32(1)) * np.cumprod(back, dtype=np.uint32),
                                                             dtype=np.uint32)])[:-1]
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], _GATE[data[:-1]] == 0]), at, 0))
    word = (sums - sums[begin]) * np.cumprod(power, dtype=np.uint32)[:-1]
    symbol = data.astype(np.int64)
    symbol[end] = END
    choice = code.tree[recent & np.uint32(0xFFFF)] * SYMBOLS + symbol
    return choice[inside], _mixed(recent[inside], word[inside])


def count_decisions(texts: list[bytes], code: Code, counts: list[np.ndarray]) -> None:
    """Add the decisions of the texts to ``counts`` (context, slot and bit): each
    distinct (context, choice) is taken down its tree once."""
    choice, context = _contexts(texts, code)
    for k in range(CONTEXTS):
        pairs, times = np.unique(context[k].astype(np.uint64) << np.uint64(18) | choice.astype(np.uint64), return_counts=True)
        _, lane, at = _decisions(code, (pairs & np.uint64((1 << 18) - 1)).astype(np.int64))
        slot = _slots(k, (pairs >> np.uint64(18)).astype(np.uint32)[lane], code.node[at]).astype(np.int64) * 2 + (code.bit[at] > 0)
        counts[k] += np.bincount(slot, times[lane], len(counts[k])).astype(np.int32)


def log_odds(counts: list[np.ndarray]) -> list[np.ndarray]:
    return [np.log((c[1::2] + PRIOR) / (c[0::2] + PRIOR)).astype(np.float32) for c in counts]


def log10_probability(texts: list[bytes], code: Code, tables: list[np.ndarray]) -> np.ndarray:
    """The score of every text."""
    lanes = Lanes(texts, code)
    n = len(lanes.start)
    weights = np.full((CONTEXTS, n * GATES), FIRST_WEIGHT, np.float32)
    refined = np.tile((np.arange(BUCKETS, dtype=np.float32) + np.float32(0.5)) / BUCKETS, n)
    total = np.zeros(n)
    for a, choice, context, gate in lanes.steps():
        first, lane, at = _decisions(code, choice)
        bit, node = code.bit[at], code.node[at]
        mixer = np.arange(a) * GATES + gate
        inputs = [np.take(tables[k], _slots(k, context[k][lane], node)) for k in range(CONTEXTS)]
        odds = 0
        for k in range(CONTEXTS):
            odds = odds + inputs[k] * weights[k][mixer][lane]
        p = np.clip(odds, -8, 8)
        np.exp(np.negative(p, out=p), out=p)
        p += 1
        np.reciprocal(p, out=p)
        bucket = (p * np.float32(BUCKETS - 0.01)).astype(np.int64)
        bucket += lane * BUCKETS
        q = refined[bucket]
        wrong = np.abs(bit - p - np.float32(MAP_SHARE) * (q - p))
        total[:a] += np.log10(np.multiply.reduceat(1 - wrong.astype(np.float64), first))
        refined[bucket] = q + np.float32(MAP_RATE) * (bit - q)
        error = (bit - p) * np.float32(RATE)
        for k in range(CONTEXTS):
            weights[k][mixer] += np.add.reduceat(inputs[k] * error, first)
    return np.bincount(lanes.text, total, len(texts))


# ---- the training texts' counts -------------------------------------------------


def _texts(part: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def _table_rows(code):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = empty_counts()
        for batch in batches:
            for part in slices(batch, "text", TRAIN_CHUNK):
                count_decisions(_texts(part), code.value, counts)
        blocks = np.concatenate(counts).reshape(-1, BLOCK)
        task = TaskContext.get().partitionId()
        used = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * len(used), pa.int64()), pa.array(used, pa.int64()),
             pa.array([blocks[b].tobytes() for b in used], pa.binary())], names=["task", "block", "counts"])

    return rows


def _counts(block: bytes) -> np.ndarray:
    """A task's counts have 32 bits, sums 64."""
    return np.frombuffer(block, np.int32 if len(block) == 4 * BLOCK else np.int64).astype(np.int64)


def _add_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(_counts(x) for x in rows["counts"])
    return pd.DataFrame({"task": rows["task"].iloc[:1], "block": rows["block"].iloc[:1], "counts": [total.tobytes()]})


def train_tables(texts: DataFrame, code: Code) -> list[np.ndarray]:
    """The predictors' log odds, from all rows of ``texts`` (text)."""
    kind = "task long, block long, counts binary"
    blocks = materialize(texts.mapInArrow(
        lean(_table_rows(texts.sparkSession.sparkContext.broadcast(code))), kind), "mixing-counts")
    tasks = (blocks.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        blocks = blocks.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("task", "block").applyInPandas(_add_blocks, kind)
        blocks = materialize(blocks, "mixing-counts")
        tasks = -(-tasks // FAN_IN)
    counts = np.concatenate(empty_counts()).astype(np.int64).reshape(-1, BLOCK)
    for r in blocks.collect():  # the tables' fixed size
        counts[r["block"]] = _counts(r["counts"])
    return log_odds(np.split(counts.ravel(), np.cumsum([2 << b for b in SLOTS_LOG2])[:-1]))


# ---- words and the base score ---------------------------------------------------


class _Places(dict):
    """word -> its place among the distinct words; the empty one is the end."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of texts one row with its documents (keys, tokens, and the
    places and times of their distinct tokens) and the training texts' byte
    triples, and one row for each distinct token: its hash, its place, and how
    often the training texts have it."""
    import xxhash

    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part in slices(batch, "text", CHUNK):
            place = _Places()
            found: list[list[np.ndarray]] = []
            for few in slices(part, "text", TRAIN_CHUNK):  # words and triples of some texts at a time
                texts = _texts(few)
                train = ~few.column("held_out").to_numpy(zero_copy_only=False)
                split = [t.lower().split() for t in texts]
                tokens = np.fromiter(map(len, split), np.int64, len(split)) + 1
                ids = np.fromiter((place[w] for words in split for w in (b"", *words)), np.int64, int(tokens.sum()))
                of = np.repeat(np.arange(len(texts)), tokens)
                own, times = np.unique(of << 32 | ids, return_counts=True)
                triples, often = trigrams([t for t, k in zip(texts, train) if k])
                found.append([tokens, np.bincount(own >> 32, minlength=len(texts)), own & 0xFFFFFFFF, times,
                              *np.unique(ids[train[of]], return_counts=True), triples, often])
            tokens, sizes, places, times, trained, n_trained, triples, often = map(np.concatenate, zip(*found))
            in_train = np.bincount(trained, n_trained, len(place)).astype(np.int64)
            choices, at = np.unique(triples, return_inverse=True)
            hist = np.stack([choices, np.bincount(at, often, len(choices)).astype(np.int64)])
            chunk, seq = task << 24 | seq, seq + 1
            n, none = len(place), pa.nulls(1, pa.binary())
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, place), np.uint64, n).view(np.int64)
            pack = lambda x, kind: pa.array([np.asarray(x, kind).tobytes()], pa.binary())
            names = ["chunk", "word", "place", "n", "keys", "tokens", "sizes", "places", "times", "hist"]
            keys = np.stack([part.column(c).to_numpy() for c in ("k1", "k2")], 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.int32()) for _ in range(2)), pack(keys, np.int64),
                 pack(tokens, np.int64), pack(sizes, np.int64), pack(places, np.uint32), pack(times, np.uint32), pack(hist, np.int32)], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, chunk)), pa.array(hashes), pa.array(np.arange(n, dtype=np.int32)), pa.array(in_train.astype(np.int32)),
                 *[pa.nulls(n, pa.binary())] * 6], names=names)


_TERMS = ("chunk long, word long, place int, n int, keys binary, tokens binary, sizes binary, places binary, "
          "times binary, hist binary")


def _base_rows(n_train: int, n_distinct: int):
    floor = np.log10(n_train + n_distinct + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), kind)
                counts = batch.column("counts")[i].values
                c = np.zeros(len(counts), np.int64)
                c[counts.field("place").to_numpy()] = counts.field("c").to_numpy()
                sizes, tokens = get("sizes", np.int64), get("tokens", np.int64)
                places, times = get("places", np.uint32), get("times", np.uint32)
                first = np.cumsum(sizes) - sizes
                logs = np.add.reduceat(np.log10(c + 1.0)[places] * times, first)
                known = np.add.reduceat((c > 0)[places] * times.astype(np.int64), first)
                keys = get("keys", np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(tokens), pa.array(known),
                     pa.array(logs - tokens * floor)], names=["k1", "k2", "n_tokens", "n_known", "base_score"])

    return rows


def base_scores(rows: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """((k1, k2, n_tokens, n_known, base_score), training tokens, counts of choices)
    of ``rows`` (k1, k2, held_out, text)."""
    terms = materialize(rows.mapInArrow(lean(_term_rows), _TERMS), "mixing-terms")
    words = terms.where("word is not null").select("word", "chunk", "place", "n")
    counts = materialize(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "mixing-words")
    n_train, n_distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    vectors = words.join(counts, "word", "left").groupBy("chunk").agg(
        F.collect_list(F.struct("place", F.coalesce("c", F.lit(0)).alias("c"))).alias("counts"))  # one slice's words
    slices_of = terms.where("word is null").select("chunk", "keys", "tokens", "sizes", "places", "times", "hist")
    base = slices_of.drop("hist").join(vectors, "chunk").mapInArrow(
        _base_rows(n_train, n_distinct), "k1 long, k2 long, n_tokens long, n_known long, base_score double")
    hist = slices_of.select("hist").mapInArrow(_hist_rows, "choice int, n long").groupBy("choice").agg(F.sum("n").alias("n"))
    choices = np.zeros((1 << 16) * SYMBOLS, np.int64)
    got = hist.toArrow()  # at most a row a choice
    choices[got.column("choice").to_numpy()] = got.column("n").to_numpy()
    return base, n_train, choices


def _hist_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column("hist"):
            at, n = np.frombuffer(x.as_py(), np.int32).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.astype(np.int64))], names=["choice", "n"])


# ---- scoring ---------------------------------------------------------------------


def _score_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables = model.value
        for batch in batches:
            for part in slices(batch, "text", CHUNK):
                texts = _texts(part)
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(log10_probability(texts, code, tables)),
                     pa.array(np.fromiter(map(len, texts), np.int64, len(texts)))], names=[*kept, "score", "n_bytes"])

    return rows


def score_texts(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score, n_bytes, bits_per_byte.

    The rows where the column ``held_out`` is false are learned from.  A null or
    empty text has its end alone: one token, and the end symbol's probability;
    its bits are given as bits a byte of one byte.  Rows that repeat id and text
    have equal scores; without training rows all counts are zero.  Other columns
    are never read.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"),
                       F.xxhash64(F.col(id_col), text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text"))
    base, n_train, choices = base_scores(rows.select("k1", "k2", "held_out", "text"))
    code = Code(choices)
    tables = train_tables(rows.where("not held_out").select("text"), code)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(
        lean(_score_rows(spark.sparkContext.broadcast((code, tables)))),
        f"doc_id {kind}, held_out boolean, k1 long, k2 long, score double, n_bytes long")
    return scored.join(base.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score",
        "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
