"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words; the hash of every run of
``GRAM`` words is taken, and in every window of ``WINDOW - GRAM + 1``
consecutive hashes the smallest is kept as a fingerprint.  Two texts that share
``WINDOW`` or more words therefore keep a common fingerprint inside the shared
span.  Fingerprints of both sides are joined and each hit is extended word by
word to both sides; a hit counts from ``WINDOW`` shared words.  Items shorter
than a window are one window as a whole, found by hashing all runs of their
length (1 to 9 words) instead.

Before the join, document fingerprints pass a bit table of fixed size that
marks all benchmark fingerprints.  Its size does not depend on the data: with a
huge benchmark it only lets more through, and the join decides in any case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import ALNUM_TABLE, ALNUM_WORD, WordHash, gram_hashes, lean, materialize, mix64, prepare, slices

WINDOW = 10
GRAM = 5
BITS_LOG2 = 25  # the bit table: 4 MB whatever the size of the benchmark

_SCHEMA = ("rid long, id string, text_key long, n_words long, fp long, n_gram int, pos long, "
           "left string, gram string, right string")


def winnowed(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed grams of the concatenated texts
    ``ids`` (``owner``: the text of each word).  Ties keep every smallest gram,
    and windows over a text's end only add grams, so the guarantee holds."""
    grams = gram_hashes(ids, GRAM)
    if not len(grams):
        return np.empty(0, np.int64), grams
    inside = owner[:len(grams)] == owner[GRAM - 1:]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    grams = np.where(inside, grams, top)
    span = WINDOW - GRAM + 1
    padded = np.concatenate([np.full(span - 1, top), grams, np.full(span - 1, top)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, span)
    least = windows[:, 0].copy()
    for j in range(1, span):
        np.minimum(least, windows[:, j], out=least)
    # of the windows that lie wholly in the padded row, the best one of each gram
    best = least[:len(grams)].copy()
    for j in range(1, span):
        np.maximum(best, least[j:j + len(grams)], out=best)
    chosen = np.flatnonzero((best == grams) & inside)
    return chosen, grams[chosen]


def _passes(bits: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    mask = np.uint64((1 << BITS_LOG2) - 1)
    ok = np.ones(len(hashes), bool)
    for h in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        ok &= (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _fingerprint_rows(lengths: list[int], bits, own_short: bool):
    """mapInArrow function: a row (n_words) for each text, and a row for each of
    its fingerprints that passes ``bits``.  ``lengths``: the word counts of
    short items to look for; ``own_short``: the texts are the items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordHash()
        table = None if bits is None else bits.value
        for batch in batches:
            for part in slices(batch, "text"):
                yield _one(part, words_of, table)

    def _one(part: pa.RecordBatch, words_of: WordHash, table) -> pa.RecordBatch:
        ids, rids, keys = (part.column(c).to_pylist() for c in ("id", "rid", "text_key"))
        texts = [(x or b"").translate(ALNUM_TABLE).split() for x in part.column("text").cast(pa.binary()).to_pylist()]
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        words = [w for t in texts for w in t]
        hashes = np.fromiter((words_of[w] for w in words), np.uint64, len(words))
        first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(texts)), counts)
        found = []  # (n_gram, position in words, hash)
        at, fp = winnowed(hashes, owner)
        if own_short:
            keep = counts[owner[at]] >= WINDOW
            at, fp = at[keep], fp[keep]
        keep = _passes(table, fp)
        found += [(GRAM, p, h) for p, h in zip(at[keep].tolist(), fp[keep].tolist())]
        for n in lengths:
            grams = mix64(gram_hashes(hashes, n) ^ np.uint64(n))
            inside = owner[:len(grams)] == owner[n - 1:] if len(grams) else np.empty(0, bool)
            if own_short:
                inside &= counts[owner[:len(grams)]] == n
            p = np.flatnonzero(inside)
            keep = _passes(table, grams[p])
            found += [(-n, int(x), h) for x, h in zip(p[keep], grams[p[keep]].tolist())]
        out: list[list] = [[] for _ in range(10)]
        for i, row in enumerate(zip(rids, ids, keys)):
            for c, v in zip(out, (*row, int(counts[i]), None, 0, None, None, None, None)):
                c.append(v)
        for n, p, h in found:
            i = int(owner[p])
            a, b, k = int(first[i]), int(first[i + 1]), abs(n)
            reach = WINDOW - GRAM if n > 0 else 0
            row = (rids[i], ids[i], keys[i], int(counts[i]), h - (1 << 64) if h >= 1 << 63 else h, n, p - a,
                   b" ".join(reversed(words[max(a, p - reach):p])).decode(), b" ".join(words[p:p + k]).decode(),
                   b" ".join(words[p + k:min(b, p + k + reach)]).decode())
            for c, v in zip(out, row):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.string()] * 3)
        names = ("rid", "id", "text_key", "n_words", "fp", "n_gram", "pos", "left", "gram", "right")
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return rows


def fingerprints(texts: DataFrame, lengths: list[int], bits=None, own_short: bool = False) -> DataFrame:
    """``texts``: (rid, id, text)."""
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    return texts.mapInArrow(lean(_fingerprint_rows(lengths, bits, own_short)), _SCHEMA)


def _bit_table(grams: DataFrame) -> np.ndarray:
    """The bits of all fingerprints: at most 2**(BITS_LOG2 - 6) words reach the driver."""
    mask = F.lit((1 << BITS_LOG2) - 1)
    places = grams.select(F.explode(F.array(F.col("fp").bitwiseAND(mask),
                                            F.shiftrightunsigned("fp", 32).bitwiseAND(mask))).alias("p"))
    words = (places.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    table = np.zeros(1 << (BITS_LOG2 - 6), np.uint64)
    got = words.toArrow()
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return table


def _reach(a: str, b: str):
    """How many leading words of the blank-separated lists ``a`` and ``b`` agree."""
    x, y = f"split({a}, ' ')", f"split({b}, ' ')"
    return F.expr(f"aggregate(sequence(0, {WINDOW - GRAM - 1}), 0, (n, i) -> "
                  f"if(n = i and get({x}, i) != '' and get({x}, i) = get({y}, i), n + 1, n))")


def shared_spans(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                 item_text_col="text") -> tuple[DataFrame, DataFrame]:
    """(documents as (rid, doc_id, text_key, n_words), hits as (rid, start, stop, item_id)):
    every run of words that a document shares with an item, found from each
    common fingerprint and reaching up to ``WINDOW - GRAM`` words around it."""
    spark = prepare(docs.sparkSession)
    test = items.select(
        F.lit(0).cast("long").alias("rid"), F.col(item_col).cast("string").alias("id"),
        F.col(item_text_col).cast("string").alias("text"))
    test = materialize(fingerprints(test, list(range(1, WINDOW)), own_short=True).where("n_gram != 0"), "benchmark-grams")
    lengths = sorted(-r[0] for r in test.where("n_gram < 0").select("n_gram").distinct().collect())
    bits = spark.sparkContext.broadcast(_bit_table(test))
    train = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("string").alias("id"),
                        F.col(text_col).cast("string").alias("text"))
    train = materialize(fingerprints(train, lengths, bits), "document-grams")
    # copies of an item or of a passage meet as one row a text; ids that are null aren't listed
    test = test.groupBy("fp", "n_gram", "left", "gram", "right").agg(F.collect_set("id").alias("items"))
    pairs = train.where("n_gram != 0").join(
        test.select("fp", "n_gram", "gram", F.col("left").alias("item_left"), F.col("right").alias("item_right"), "items"),
        ["fp", "n_gram", "gram"])
    before, after = _reach("left", "item_left"), _reach("right", "item_right")
    spans = pairs.select("rid", "n_gram", "pos", "items", before.alias("before"), after.alias("after")).where(
        f"n_gram < 0 or before + after + {GRAM} >= {WINDOW}")
    spans = spans.select("rid", (F.col("pos") - F.col("before")).alias("start"),
                         (F.col("pos") + F.abs("n_gram") + F.col("after")).alias("stop"), "items").distinct()
    texts = train.where("n_gram = 0").select("rid", F.col("id").alias("doc_id"), "text_key", "n_words")
    return texts, spans


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_key, n_words, n_hit,
    n_items, items_sha256, contaminated.

    A window is ``WINDOW`` consecutive words of an item (all words of a shorter
    one); a document word inside an occurrence of a window is hit.  Null and
    empty texts have no words and no hits; items without words have no window, those
    without id mark words but are not listed or counted; repeated document rows are judged one by one (``rid`` tells them
    apart), equal items each count.  Other columns are never read.
    """
    texts, spans = shared_spans(docs, items, id_col, text_col, item_col, item_text_col)
    spans = materialize(spans, "shared-spans")
    hit = (spans.select("rid", F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos"))
           .distinct().groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit")))
    found = (spans.select("rid", F.explode("items").alias("item")).distinct()
             .groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items")))
    return texts.join(hit.join(found, "rid", "left"), "rid", "left").select(
        "rid", F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "text_key", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.greatest(F.size(F.coalesce("items", F.array())), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '{ALNUM_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n,
              list_slice(w, i, i + least(len(w), {WINDOW}) - 1) AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
       FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
