"""Token ids in word-aligned Simple-8b blocks.

Format (little-endian 64-bit words).  A block holds whole documents in order::

    MAGIC, n_docs, n_ids, n_runs, n_words, n_escapes
    document id of each document   (NULL_ID for a null id)
    ids of each document           (counts)
    first word of each run         (a run is RUN ids; packing starts anew with each)
    escape positions, then escaped values
    packed words

A packed word has a 4-bit selector on top and 60 payload bits that hold
``COUNTS[selector]`` ids of ``BITS[selector]`` bits each, lowest first.  Ids of
2**60 and more do not fit; they are packed as 0 and listed as escapes.  The
selector alone tells how many ids a word has, so all words of a block are
decoded at once, selector by selector, and the run offsets let a reader start
in the middle of a long document.

A shard is one Parquet file of blocks (part, seq, n_docs, n_ids, block); shards
and blocks follow ascending document ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bugroute.llm.common import lean, prepare, slices
from bugroute.session import scratch_path

MAGIC = 0x53384249_44530001
NULL_ID = -(1 << 63)
RUN = 4096
# The sixteen Simple-8b selectors (ids in a word, bits of an id).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK_SCHEMA = "part long, seq long, n_docs long, n_ids long, block binary"


def selectors(ids: np.ndarray) -> np.ndarray:
    """The selector that packs most ids from each position of one padded run
    row; candidates shrink as the required run of small ids gets longer."""
    best = np.full(len(ids), 15, np.int8)
    n = len(ids) - 240
    if not n:
        return best
    # up to four ids a word: the largest of the next two, three, four, for all positions
    small = ids.astype(np.uint32) if ids.max() < 1 << 32 else ids
    most = small[:n]
    for s, j in ((14, 1), (13, 2), (12, 3)):
        most = np.maximum(most, small[j:n + j])
        best[:n][most < (1 << int(BITS[s]))] = s
    at, have = np.flatnonzero(most < (1 << int(BITS[12]))), 4
    ids, most = small, most[at]
    for s in range(11, -1, -1):
        for j in range(have, int(COUNTS[s])):
            if j & 7 == 0:  # drop what is already too large
                ok = most < (1 << int(BITS[s]))
                at, most = at[ok], most[ok]
            most = np.maximum(most, ids[at + j])
        ok = most < (1 << int(BITS[s]))
        at, most, have = at[ok], most[ok], int(COUNTS[s])
        if not len(at):
            break
        best[at] = s
    return best


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each run, escape positions) of uint64 ids."""
    escapes = np.flatnonzero(ids >= (1 << 60))
    plain = ids.copy()
    plain[escapes] = 0
    n_runs = -(-len(plain) // RUN)
    rows = np.zeros((n_runs, RUN + 240), np.uint64)  # a word may reach past its run's end: zeros
    flat = np.zeros(n_runs * RUN, np.uint64)
    flat[:len(plain)] = plain
    rows[:, :RUN] = flat.reshape(n_runs, RUN)
    row = rows.ravel()
    best = selectors(np.concatenate([row, np.zeros(240, np.uint64)]))[:len(row)]
    step = COUNTS[best]
    # the words' first ids: all runs go forward together, a word at a time
    first = np.arange(n_runs) * (RUN + 240)
    at, end, starts = first, first + np.minimum(RUN, len(plain) - np.arange(n_runs) * RUN), [first]
    while len(at):
        at = at + step[at]
        if (at >= end).any():
            at, end = at[at < end], end[at < end]
        starts.append(at)
    at = np.sort(np.concatenate(starts))
    run_first = np.searchsorted(at, first)
    sel = best[at].astype(np.int64)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        pick = np.flatnonzero(sel == s)
        value = words[pick]
        if BITS[s]:
            for j in range(COUNTS[s]):
                value |= row[at[pick] + j] << np.uint64(j * BITS[s])
        words[pick] = value
    return words, run_first.astype(np.uint64), escapes


def unpack(words: np.ndarray, run_first: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of a block; no step depends on the one before."""
    n_runs = len(run_first)
    rows = np.zeros((n_runs, RUN + 240), np.uint64)
    if n_runs:
        sel = (words >> np.uint64(60)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(COUNTS[sel])])[:-1]
        first = run_first.astype(np.int64)
        run = np.searchsorted(first, np.arange(len(words)), side="right") - 1
        place = before - before[first][run] + run * (RUN + 240)
        flat = rows.ravel()
        for s in np.unique(sel):
            if BITS[s]:
                pick = np.flatnonzero(sel == s)
                mask = np.uint64((1 << int(BITS[s])) - 1)
                for j in range(COUNTS[s]):
                    flat[place[pick] + j] = (words[pick] >> np.uint64(j * BITS[s])) & mask
    return rows[:, :RUN].ravel()[:n_ids].copy()


def write_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    ids = ids.astype(np.uint64)
    words, run_first, escapes = pack(ids)
    head = np.array([MAGIC, len(counts), len(ids), len(run_first), len(words), len(escapes)], np.uint64)
    names = np.array([NULL_ID if x is None else x for x in doc_ids], np.int64)
    parts = (head, names, counts.astype(np.uint64), run_first, escapes.astype(np.uint64), ids[escapes], words)
    return b"".join(p.astype("<i8" if p.dtype == np.int64 else "<u8").tobytes() for p in parts)


def read_block(block: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, counts, ids) of a block."""
    head = np.frombuffer(block, "<u8", 6)
    if head[0] != MAGIC:
        raise ValueError("not a token block")
    n_docs, n_ids, n_runs, n_words, n_escapes = (int(x) for x in head[1:])
    body, parts = 48, []
    for n in (n_docs, n_docs, n_runs, n_escapes, n_escapes, n_words):
        parts.append(np.frombuffer(block, "<u8", n, body))
        body += 8 * n
    names, counts, run_first, at, value, words = parts
    ids = unpack(words, run_first, n_ids)
    ids[at.astype(np.int64)] = value
    return [None if x == NULL_ID else x for x in names.astype(np.int64).tolist()], counts.astype(np.int64), ids


class _Numbers(dict):
    """piece -> number; a new piece gets the next number and is put on ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, piece) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


def byte_letters() -> list[str]:
    """The character that a byte-level BPE writes for each byte: printable
    Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in plain)
    return [c for _, c in sorted([(b, chr(b)) for b in plain] + [(b, chr(0x100 + k)) for k, b in enumerate(others)])]


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class PieceEncoder:
    """The tokenizer's ids of texts, asking the library once for each distinct
    word.

    A blank between two other characters always starts a token of a byte-level
    BPE with this split rule, so the blank-separated pieces of a text are encoded
    on their own (all but the first with the blank in front).  A piece that is
    letters with ``TAIL`` signs behind is split there, as the rule does; its
    letters go straight to the library's BPE model.  All other pieces are encoded
    by the whole tokenizer, and texts with further white space at a piece's edge
    are encoded whole.  At most ``limit`` pieces and words are kept.
    """

    TAIL = ".,;:!?()[]{}<>#%&*$|/\\-_=+~^\""

    def __init__(self, path: str, end_id: int, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use all cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.end_id, self.limit = end_id, limit
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words: dict[str, list[int]] = {}
        self.tails: dict[str, list[int]] = {}
        self.line_end = self._whole("\n")
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.known = 0
        self.ids = np.empty(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.bounds = np.zeros(1 << 18, np.int64)
        self.alone = np.zeros(1 << 18, bool)  # may be encoded on its own

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, text: str) -> list[int]:
        """Ids of a piece, with its blank."""
        if "\n" in text:  # a line end between other characters is a token
            lines = text.split("\n")
            if not all(x.strip() == x and x for x in (lines[0][1:] if text[0] == " " else lines[0], *lines[1:])):
                return self._whole(text)
            ids = self._piece(lines[0])
            for line in lines[1:]:
                ids = ids + self.line_end + self._piece(line)
            return ids
        word = text.rstrip(self.TAIL)
        tail = text[len(word):]
        if not (word[1:].isalpha() if word[:1] == " " else word.isalpha()):
            return self._whole(text)
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.limit:
                self.words.clear()
            # of ASCII letters with a blank in front, only the blank is spelt otherwise
            spelt = (word.replace(" ", self.letters[32]) if word.isascii()
                     else word.encode().decode("latin-1").translate(self.letters))
            ids = self.words[word] = [t.id for t in self.tokenize(spelt)]
        if not tail:
            return ids
        more = self.tails.get(tail)
        if more is None:
            if len(self.tails) >= self.limit:
                self.tails.clear()
            more = self.tails[tail] = self._whole(tail)
        return ids + more

    def _learn(self) -> None:
        """Find the ids of the new pieces."""
        new, self.number.new = self.number.new, []
        if not new:
            return
        got = [self._piece(p[0] if type(p) is tuple else " " + p) for p in new]
        lens, n = list(map(len, got)), self.known
        used, total, self.known = int(self.bounds[n]), sum(lens), n + len(new)
        while used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + 1 > len(self.alone):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.alone = np.concatenate([self.alone, np.zeros_like(self.alone)])
        self.ids[used:used + total] = np.fromiter(chain.from_iterable(got), self.ids.dtype, total)
        self.bounds[n + 1:self.known + 1] = used + np.cumsum(lens, dtype=np.int64)
        bare = [p[0] if type(p) is tuple else p for p in new]
        self.alone[n:self.known] = [t.strip() == t and p != "" for p, t in zip(new, bare)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, ids) of the texts, with the end id after each."""
        if len(self.number) > self.limit:
            self.forget()
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = pieces.offsets.to_numpy()
        n_pieces, begin = np.diff(begin), begin[:-1]
        flat = pieces.values
        different = flat.dictionary_encode()  # each piece is looked up once, with its blank
        numbers = np.fromiter(map(self.number.__getitem__, _strings(different.dictionary)), np.int64, len(different.dictionary))
        at = numbers[different.indices.to_numpy()]
        at[begin] = np.fromiter((self.number[p,] for p in _strings(flat.take(pa.array(begin)))), np.int64, len(begin))
        self._learn()
        owner = np.repeat(np.arange(len(texts)), n_pieces)
        whole = np.unique(owner[~self.alone[at]])
        if len(whole):
            use = ~np.isin(owner, whole)
            at, owner = at[use], owner[use]
        lens = self.bounds[at + 1] - self.bounds[at]
        counts = np.bincount(owner, lens, len(texts)).astype(np.int64)
        first = np.cumsum(counts) - counts  # of each text among the gathered ids
        rest = {i: np.array(self._whole(texts[i]), np.uint32) for i in whole.tolist()}
        for i, ids in rest.items():
            counts[i] = len(ids)
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.end_id, np.uint32)
        # a piece's ids go where its text begins, behind those of the pieces before it
        before = np.cumsum(lens) - lens
        source = np.arange(int(lens.sum()))
        target = source + np.repeat((ends - counts - 1)[owner] - first[owner], lens)
        out[target] = self.ids[source + np.repeat(self.bounds[at] - before, lens)]
        for i, ids in rest.items():
            out[ends[i] - 1 - len(ids):ends[i] - 1] = ids
        return counts + 1, out


_ENCODERS: dict = {}  # one for each path and worker process: kept over tasks


def _blocks(path: str, end_id: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((path, end_id)) or _ENCODERS.setdefault((path, end_id), PieceEncoder(path, end_id))
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", 2 << 20):
                counts, ids = encoder.encode([x or "" for x in piece.column("text").to_pylist()])
                block = write_block(piece.column("doc_id").to_pylist(), counts, ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((part, pa.int64()), (seq, pa.int64()), (len(counts), pa.int64()),
                                                   (len(ids), pa.int64()), (block, pa.binary()))],
                    names=["part", "seq", "n_docs", "n_ids", "block"])
                seq += 1

    return blocks


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every text and write the shards below ``path``."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("rid"))
    rows = rows.repartitionByRange(F.col("doc_id").asc(), F.col("rid").asc()).sortWithinPartitions("doc_id", "rid")
    rows.select("doc_id", "text").mapInArrow(lean(_blocks(vocabulary, end_id)), BLOCK_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, block in zip(batch.column("start").to_pylist(), batch.column("block")):
            names, counts, ids = read_block(block.as_py())
            ends = np.cumsum(counts)
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * (e - c):4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def blocks_with_start(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all shards with the number of ids before each.  Only one
    small row a shard meets in the window over shards."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    shards = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("shard_start"))
    heads = blocks.select("part", "seq", "n_ids").withColumn(
        "before", F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids"))
    starts = heads.join(shards, "part").select("part", "seq", (F.col("shard_start") + F.col("before")).alias("start"))
    return blocks.join(starts, ["part", "seq"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards."""
    prepare(spark)
    return blocks_with_start(spark, path).select("start", "block").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_blocks(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write the shards of ``docs`` to the shared folder and read them back.

    One row per row of ``docs``.  A null or empty text has the end id alone;
    rows with a null id come first; rows that repeat an id follow one another in
    input order; an empty table gives no rows.  Other columns are never read.
    """
    path = scratch_path(docs.sparkSession, "token-shards")
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path)
