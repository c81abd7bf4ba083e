"""Huffman codes of a vocabulary (VEC4).

The usual tree takes the two lightest nodes again and again, an inner node before
a word of the same count, and words from the last index on.  Nodes are therefore
consumed in one order, by weight, and two neighbours at places 2j and 2j + 1 of
that order make inner node j.  So a node's branch and parent follow from its place
alone, and all nodes of one weight, being neighbours, are one run.

The tree is built over runs: the words of one count are a run, and so are the inner
nodes made from a run.  There are at most sqrt(2 * tokens) distinct counts, so the
driver sees runs, never words.  Words then get their place by a join on their
count, from their rank in its run, and climb from run to run to the root.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.session import ship_package

#: Runs shipped to the tasks; their number is bounded by the distinct counts.
MAX_RUNS = 50_000_000


def runs(counts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """From (count, number of words), ascending: ([(count, place of its first
    word)], [(first inner node, its place)]) of all runs, in order."""
    leaves, inner = deque(counts), deque()   # inner: [weight, first node, nodes]
    n_words = sum(n for _, n in counts)
    words, nodes, place, made, odd = [], [], 0, 0, None

    def make(weight: int, n: int) -> None:
        nonlocal made
        if inner and inner[-1][0] == weight:
            inner[-1][2] += n
        elif n:
            inner.append([weight, made, n])
        made += n

    while place < 2 * n_words - 2:
        if inner and (not leaves or inner[0][0] <= leaves[0][0]):
            weight, first, n = inner.popleft()
            nodes.append((first, place))
        else:
            weight, n = leaves.popleft()
            words.append((weight, place))
        place += n
        if odd is not None and n:
            make(odd + weight, 1)
            odd, n = None, n - 1
        make(2 * weight, n // 2)
        odd = weight if n % 2 else odd
    if n_words == 1:
        words.append((counts[0][0], 0))
    return words, nodes


def climb(places: np.ndarray, n_words: int, first: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code length, codes, points) of the words at ``places``: level by level, all
    words together; codes and points come as one row a level, from the leaf up."""
    n_nodes = n_words - 1
    length = np.zeros(len(places), np.int32)
    codes, points = [], []
    now, on = places.copy(), np.full(len(places), n_nodes > 0)
    while on.any():
        parent = now >> 1
        codes.append(np.where(on, now & 1, 0).astype(np.int32))
        points.append(np.where(on, parent, 0).astype(np.int32))
        length += on
        on &= parent != n_nodes - 1
        run = np.searchsorted(first, parent, side="right") - 1
        now = np.where(on, place[run] + parent - first[run], 0) if len(first) else now
    shape = (len(codes), len(places))
    return length, np.array(codes, np.int32).reshape(shape), np.array(points, np.int32).reshape(shape)


def _lists(levels: np.ndarray, length: np.ndarray) -> pa.ListArray:
    """The first ``length`` entries of every column, turned round."""
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    owner = np.repeat(np.arange(len(length)), length)
    level = length[owner] - 1 - (np.arange(ends[-1]) - ends[owner])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(levels[level, owner] if len(owner) else np.empty(0, np.int32)))


def huffman_codes(vocab: DataFrame) -> DataFrame:
    """``vocab`` (word, count, idx by descending count) with ``codes`` and ``points``,
    both array<int>, from the root down: the branch taken at each inner node, and
    that node's number (the root has the largest).  A single word has empty ones;
    without words there are no rows.
    """
    spark = vocab.sparkSession
    ship_package(spark)
    per = vocab.groupBy("count").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"))
    rows = sorted((r["count"], r["n"], r["last"]) for r in per.collect())   # distinct counts
    n_words = sum(n for _, n, _ in rows)
    words, nodes = runs([(c, n) for c, n, _ in rows])
    if len(nodes) > MAX_RUNS:
        raise ValueError(f"{len(nodes)} runs of inner nodes, above the bound of {MAX_RUNS}")
    kind = vocab.schema["count"].dataType.simpleString()
    table = spark.createDataFrame([(c, p, last) for (c, p), (_, _, last) in zip(words, rows)],
                                  f"__count {kind}, __place long, __last long")
    placed = vocab.join(F.broadcast(table), F.col("count") == F.col("__count")).select(
        "word", "count", "idx", (F.col("__place") + F.col("__last") - F.col("idx")).alias("place"))
    shipped = spark.sparkContext.broadcast(tuple(np.array([x[k] for x in nodes], np.int64) for k in (0, 1)))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, place = shipped.value
        for batch in batches:
            length, codes, points = climb(batch.column("place").to_numpy(), n_words, first, place)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("word", "count", "idx")), _lists(codes, length),
                                              _lists(points, length)], names=["word", "count", "idx", "codes", "points"])

    idx = vocab.schema["idx"].dataType.simpleString()
    return placed.mapInArrow(paths, f"word string, count {kind}, idx {idx}, codes array<int>, points array<int>")
