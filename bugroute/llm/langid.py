"""Language identification of mixed-language text.

Per word: its script (a code-point range) narrows the candidate languages to
those seen with that script in training; each candidate gets the word's
log-probability under character n-grams.  Per text: a Viterbi pass over the
words with a penalty for switching labels every word, so that a text becomes a
few spans of one language each.  The prediction is the language with most
letters in its spans, the score its share of the letters.

The model is a table of ``BUCKETS`` hashed n-gram counts a language and of
letters a script, summed by Spark over all training rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import Tokens, lean, numbered, prepare, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
SWITCH_PENALTY = 6.0  # nats, against word scores in nats a letter order
SCRIPT_SHARE = 0.005  # of a language's letters that makes a script one of its own
UNKNOWN = "und"

# First and last code point of script ranges, in order.  Letters
# outside of all ranges count as script 0.
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"),
    (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(s[2] for s in SCRIPTS)]
_FIRST = np.array([s[0] for s in SCRIPTS])
_LAST = np.array([s[1] for s in SCRIPTS])
_SCRIPT = np.array([SCRIPT_NAMES.index(s[2]) for s in SCRIPTS])


def script_of(points: np.ndarray) -> np.ndarray:
    """Index in ``SCRIPT_NAMES`` of each code point."""
    at = np.maximum(np.searchsorted(_FIRST, points, side="right") - 1, 0)
    return np.where((points >= _FIRST[at]) & (points <= _LAST[at]), _SCRIPT[at], 0)


def letters(token: str) -> str:
    """The token's letters in lower case; other characters go."""
    return token.lower() if token.isalpha() else "".join(filter(str.isalpha, token)).lower()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and word of every n-gram, letters and script of every word) of
    non-empty words; a blank stands before and after each word."""
    points = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lens + 1) - lens  # the first letter of each word
    blank = points == 32
    owner = np.cumsum(blank) - 1
    buckets, owners = [], []
    acc = np.zeros(len(points), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        end = len(points) - n + 1
        acc = acc[:end] * np.uint64(0x100000001B3) + points[n - 1:].astype(np.uint64) + np.uint64(n)
        if n not in ORDERS:
            continue
        # inside one word and its two blanks, with a letter in it
        inner = np.zeros(end, np.int64)
        for j in range(1, n - 1):
            inner |= blank[j:end + j]
        ok = np.flatnonzero((inner == 0) & ~(blank[:end] & blank[n - 1:]))
        h = acc[ok] * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((h >> np.uint64(64 - 15)).astype(np.int64))
        owners.append(owner[ok])
    return np.concatenate(buckets), np.concatenate(owners), lens, script_of(points[first])


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) sums of this task; buckets from BUCKETS on are scripts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part.column("lang").to_pylist()
            texts = part.column("text").to_pylist()
            for lang in set(langs):
                tokens = Tokens(letters)
                ids, _ = numbered([t for t, x in zip(texts, langs) if x == lang], tokens)
                if not len(ids):
                    continue
                times = np.bincount(ids, minlength=tokens.count)
                bucket, owner, lens, script = features(tokens.new)
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
                total += np.bincount(bucket, times[owner], len(total))
                total += np.bincount(BUCKETS + script, times * lens, len(total))
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at].astype(np.int64))],
            names=["lang", "bucket", "n"])


class Model:
    """Languages in name order, n-gram log-probabilities (bucket, language) and
    the languages that each script leaves (script, language)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
        self.logp = (np.log(grams + SMOOTH) - np.log(grams.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share >= SCRIPT_SHARE
        self.allowed[~self.allowed.any(1)] = True  # a script nobody has seen rules nothing out

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word and language, letters of each word)."""
        bucket, owner, lens, script = features(words)
        scores = np.stack([np.bincount(owner, self.logp[bucket, k], len(words)) for k in range(len(self.langs))], 1)
        scores = scores.astype(np.float32) / len(ORDERS)
        scores[~self.allowed[script]] = -1e6
        return scores, lens


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from every row of ``docs`` with text and language.  At most
    BUCKETS sums a language reach the driver."""
    prepare(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = (rows.mapInArrow(lean(_count_rows), "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    which = np.array([langs.index(x) for x in sums.column("lang").to_pylist()], np.int64)
    counts[sums.column("bucket").to_numpy(), which] = sums.column("n").to_numpy()
    return Model(langs, counts)


def viterbi(scores: np.ndarray, owner: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """Best label of every word (rows of ``scores``, grouped by text).  All
    texts go forward together, word by word, the longest first, so that a step
    is one array operation over the texts that still have words."""
    counts = np.bincount(owner, minlength=n_texts)
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    counts = counts[order]
    n_steps = int(counts[0]) if n_texts else 0
    active = np.searchsorted(-counts, -np.arange(n_steps), side="left")  # texts with more than t words
    came = np.full(scores.shape, -1, np.int16)  # -1: no switch before this word
    best = np.zeros((n_texts, scores.shape[1]), np.float32)
    for t in range(n_steps):
        a = active[t]
        at = first[:a] + t
        if t:
            v = best[:a]
            top = v.argmax(1)
            switched = np.take_along_axis(v, top[:, None], 1) - penalty
            move = switched > v
            came[at] = np.where(move, top[:, None], -1)
            best[:a] = np.maximum(v, switched)
        best[:a] += scores[at]
    label = np.zeros(len(scores), np.int16)
    now = best.argmax(1).astype(np.int16)
    for t in range(n_steps - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        label[at] = now[:a]
        back = came[at, now[:a]]
        now[:a] = np.where(back >= 0, back, now[:a])
    return label


SPANS = "array<struct<lang:string,first_word:long,n_words:long>>"


def _label_rows(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        tokens, scores, lens = Tokens(letters), np.empty((0, len(m.langs)), np.float32), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                if tokens.count > 300_000:
                    tokens, scores, lens = Tokens(letters), scores[:0], lens[:0]
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids, owner = numbered(texts, tokens)
                if tokens.new and m.langs:
                    more, more_lens = m.word_scores(tokens.new)
                    scores, lens = np.concatenate([scores, more]), np.concatenate([lens, more_lens])
                    tokens.new = []
                yield _labelled(part, m, scores[ids] if m.langs else None, lens[ids] if m.langs else None, owner)

    return rows


def _labelled(part: pa.RecordBatch, m: Model, scores, lens, owner: np.ndarray) -> pa.RecordBatch:
    n, n_langs = part.num_rows, len(m.langs)
    pred, score = [UNKNOWN] * n, np.zeros(n)
    span_of, span_lang, span_first, span_words = (np.empty(0, np.int64),) * 4
    if n_langs and len(owner):
        label = viterbi(scores, owner, n, SWITCH_PENALTY).astype(np.int64)
        share = np.bincount(owner * n_langs + label, lens, n * n_langs).reshape(n, n_langs)
        has = share.sum(1) > 0
        top = share.argmax(1)
        score[has] = share.max(1)[has] / share.sum(1)[has]
        pred = [m.langs[k] if h else UNKNOWN for k, h in zip(top.tolist(), has.tolist())]
        cut = np.flatnonzero(np.diff(owner * n_langs + label, prepend=-1))
        text_first = np.searchsorted(owner, owner[cut])
        span_of, span_lang, span_first = owner[cut], label[cut], cut - text_first
        span_words = np.diff(np.append(cut, len(owner)))
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(span_of, np.arange(n + 1)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array([m.langs[k] for k in span_lang.tolist()], pa.string()), pa.array(span_first, pa.int64()),
             pa.array(span_words, pa.int64())], names=["lang", "first_word", "n_words"]))
    kept = [c for c in part.schema.names if c != "text"]
    return pa.RecordBatch.from_arrays(
        [*(part.column(c) for c in kept), pa.array(pred, pa.string()), pa.array(score, pa.float64()), spans],
        names=[*kept, "lang_pred", "score", "spans"])


def identify(docs: DataFrame, model: Model, keep: list[Column] = (), text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1) and spans (language, first
    word, words; words are those with a letter) of every row of ``docs``.

    Null texts and texts without a letter get ``und``, score 0 and no span;
    equal word scores and equal shares go to the first language in name order;
    a model without languages says ``und`` to all.  No other column is read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    schema = f"{fields + ', ' if fields else ''}lang_pred string, score double, spans {SPANS}"
    return rows.mapInArrow(lean(_label_rows(spark.sparkContext.broadcast(model))), schema)
