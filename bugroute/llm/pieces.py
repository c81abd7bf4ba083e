"""Piece encoding with seeded merge-dropout, and its lossless decoding.

A text is cut into units (a run of blanks with the characters after it, up to
the next blank or line end; no piece of such a vocabulary crosses these cuts).
The merges of a unit are taken from an agenda, best score first.  Each candidate
merge is skipped once with probability ``dropout``, decided by a hash of the
seed, the unit, its occurrence (the row's key and the unit's place in the text)
and the three ends of the merge, so the same seed always gives the same pieces on
any cluster and every occurrence is drawn anew.  The pieces without dropout are
kept for each unit, with the merges that make them: they are the pieces of each
occurrence that skips none of those merges.  All others are worked out one by one.

Characters without a piece are written as byte pieces; so is the character that
the vocabulary uses for blanks, which keeps decoding exact.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import lean, mix64, prepare, slices

DROPOUT = 0.1
SEED = 17
BLANK = "▁"
UNIT = re.compile(r"\n| +[^ \n]*|[^ \n]+")
EVEN = 32  # units of up to so many characters are segmented together
NEVER = np.iinfo(np.int32).max
_M = (1 << 64) - 1
_K = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9)


def unit_keys(units: list[str], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(u.encode("utf-8", "surrogatepass"), seed) for u in units), np.uint64, len(units))


def _ends_hash(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return a * np.uint64(_K[0]) + b * np.uint64(_K[1]) + c * np.uint64(_K[2])


def _skipped(h: np.ndarray, edge: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_K[3])
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(32)) < edge


class Vocabulary:
    """Pieces with their merge scores, read from a model file by its library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ids: dict[str, int] = {}  # with blanks as blanks
        self.cost: dict[str, float] = {}
        self.bytes: list[bytes] = [b""] * n
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        for i in range(n):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace(BLANK, " ")
                self.ids[piece], self.cost[piece], self.bytes[i] = i, -model.get_score(i), piece.encode()
        self.longest = max(map(len, self.ids))
        self.kind = np.uint16 if n <= 1 << 16 else np.uint32
        self._pair_table()

    def _pair_table(self) -> None:
        """All merges as sorted keys (left id, right id) with the piece's place
        in merge order, and the piece of every single character."""
        order = sorted(self.ids, key=lambda p: (self.cost[p], self.ids[p]))
        self.in_order = np.array([self.ids[p] for p in order], np.int32)
        n, keys, place = len(self.bytes), [], []
        self.char_ids = np.full(0x110000, -1, np.int32)
        for k, p in enumerate(order):
            if len(p) == 1:
                self.char_ids[ord(p)] = self.ids[p]
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    place.append(k)
        self.char_ids[ord(BLANK)] = -1
        at = np.argsort(keys)
        self.pair_keys = np.append(np.array(keys, np.int64)[at], np.iinfo(np.int64).max)
        self.pair_place = np.append(np.array(place, np.int32)[at], NEVER)

    def _places(self, left, right, a, b, c, key, edge: int) -> np.ndarray:
        """The place in merge order of each candidate; NEVER: no piece, or skipped."""
        k = left.astype(np.int64) * len(self.bytes) + right
        at = np.searchsorted(self.pair_keys, k)
        place = np.where(self.pair_keys[at] == k, self.pair_place[at], NEVER)
        if edge:
            place[_skipped(key ^ _ends_hash(a, b, c), edge)] = NEVER
        return place

    def _segment_even(self, symbols: np.ndarray, key: np.ndarray, edge: int,
                      made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Units of one length together: in each step every unit makes its best
        merge.  (ids behind one another, ids of each unit); ``made`` takes the
        merges as arrays (unit, its three ends)."""
        n, m = symbols.shape
        result, sizes, unit = np.empty((n, m), np.int32), np.empty(n, np.int64), np.arange(n)
        start = np.tile(np.arange(m + 1, dtype=np.uint64), (n, 1))
        place = self._places(symbols[:, :-1], symbols[:, 1:], start[:, :-2], start[:, 1:-1], start[:, 2:],
                             key[:, None], edge)
        while len(unit):
            rows = np.arange(len(unit))
            j = place.argmin(1) if m > 1 else np.zeros(len(unit), np.int64)
            best = place[rows, j] if m > 1 else np.full(len(unit), NEVER)
            done = best == NEVER
            if done.any():
                result[unit[done], :m], sizes[unit[done]] = symbols[done], m
                go = ~done
                unit, symbols, start, place, key, j, best = (
                    x[go] for x in (unit, symbols, start, place, key, j, best))
                rows = rows[:len(unit)]
                if not len(unit):
                    break
            if made is not None:
                made.append((unit, start[rows, j], start[rows, j + 1], start[rows, j + 2]))
            m -= 1
            left = np.ones((len(unit), m + 2), bool)
            left[rows, j + 1] = False  # the right one of the two goes, with its start
            symbols, start = symbols[left[:, :m + 1]].reshape(-1, m), start[left].reshape(-1, m + 1)
            symbols[rows, j] = self.in_order[best]
            left[rows, j + 1] = True
            left[rows, j] = False
            place = place[left[:, :m]].reshape(len(unit), m - 1)
            for side in (j - 1, j):  # the new symbol with its left and its right neighbour
                ok = np.flatnonzero((side >= 0) & (side < m - 1))
                p = side[ok]
                place[ok, p] = self._places(symbols[ok, p], symbols[ok, p + 1], start[ok, p], start[ok, p + 1],
                                            start[ok, p + 2], key[ok], edge)
        return result[np.arange(result.shape[1]) < sizes[:, None]], sizes

    def segment_all(self, units: list[str], variants: np.ndarray, dropout: float, seed: int, made: list | None = None,
                    keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``segment`` of every (unit, variant): short units of known characters
        by length, all others one by one; ``keys``: the units' keys, if known."""
        lens = np.fromiter(map(len, units), np.int64, len(units))
        chars = self.char_ids[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(lens) - lens
        unknown = np.concatenate([[0], np.cumsum(chars < 0)])
        odd = (unknown[first + lens] > unknown[first]) | (lens > EVEN) | np.fromiter(
            (u[:2] == "  " for u in units), bool, len(units))
        edge = int(dropout * (1 << 32))
        sizes = np.zeros(len(units), np.int64)
        parts = []  # units and their ids behind one another
        keys = (unit_keys(units, seed) if keys is None else keys) + variants.astype(np.uint64)
        for n in np.unique(lens[~odd]).tolist():
            pick = np.flatnonzero(~odd & (lens == n))
            own = None if made is None else []
            flat, sizes[pick] = self._segment_even(chars[first[pick][:, None] + np.arange(n)], keys[pick], edge, own)
            for unit, *ends in own or ():
                made.append((pick[unit], *ends))
            parts.append((pick, flat))
        pick = np.flatnonzero(odd)
        alone = []
        for k in pick.tolist():
            own = None if made is None else []
            alone.append(self.segment(units[k], int(variants[k]), dropout, seed, own))
            sizes[k] = len(alone[-1])
            if own:
                made.append((np.full(len(own), k), *np.array(own, np.uint64).T))
        parts.append((pick, np.array(list(chain.from_iterable(alone)), np.int32)))
        out, begin = np.empty(int(sizes.sum()), self.kind), np.cumsum(sizes) - sizes
        for pick, flat in parts:
            size = sizes[pick]
            out[np.arange(len(flat)) + np.repeat(begin[pick] - (np.cumsum(size) - size), size)] = flat
        return out, sizes

    def segment(self, unit: str, variant: int, dropout: float, seed: int, made: list | None = None) -> list[int]:
        """The unit's piece ids: agenda merges, some of them skipped."""
        cost, n = self.cost, len(unit)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0: none does
        before = list(range(-1, n - 1))  # start of the symbol to the left
        agenda = []
        for a in range(n - 1):
            c = cost.get(unit[a:a + 2])
            if c is not None:
                agenda.append((c, a, a + 1, a + 2))
        heapq.heapify(agenda)
        key = (xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"), seed) + variant) & _M
        edge = int(dropout * (1 << 32))
        while agenda:
            _, a, b, c = heapq.heappop(agenda)
            if end[a] != b or end[b] != c:
                continue  # one of the two has been merged since
            if edge:
                h = (key ^ (a * _K[0] + b * _K[1] + c * _K[2])) & _M
                h = ((h ^ (h >> 31)) * _K[3]) & _M
                if (h ^ (h >> 29)) >> 32 < edge:
                    continue
            if made is not None:
                made.append((a, b, c))
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                d = end[c]
                if d - a <= self.longest:
                    x = cost.get(unit[a:d])
                    if x is not None:
                        heapq.heappush(agenda, (x, a, c, d))
            p = before[a]
            if p >= 0 and c - p <= self.longest:
                x = cost.get(unit[p:c])
                if x is not None:
                    heapq.heappush(agenda, (x, p, a, c))
        out, a = [], 0
        while a < n:
            i = self.ids.get(unit[a:end[a]])
            if i is None or unit[a] == BLANK:
                out += [self.byte_ids[b] for b in unit[a:end[a]].encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
            a = end[a]
        return out

    def decode(self, ids) -> bytes:
        """The text of ids; the blank that encoding put in front goes."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


class _Units(dict):
    """unit -> its place in ``known``; a new one is put behind."""

    def __init__(self):
        super().__init__()
        self.known: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self.known)
        self.known.append(unit)
        return n


class UnitEncoder:
    """Ids of whole texts.  The ids and merges of a unit without dropout are kept
    as long as the kept units have at most ``limit`` characters in all; units of
    more than EVEN characters, which hardly ever skip nothing, are not."""

    def __init__(self, vocabulary: Vocabulary, dropout: float, seed: int, limit: int = 3_000_000):
        self.vocabulary, self.dropout, self.seed, self.limit = vocabulary, dropout, seed, limit
        self.edge = int(dropout * (1 << 32))
        self._forget()

    def _forget(self) -> None:
        self.place = _Units()
        self.chars = 0
        self.ids = np.empty(0, self.vocabulary.kind)
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)  # of each unit in ids
        self.long, self.key = np.empty(0, bool), np.empty(0, np.uint64)
        self.merges = np.empty(0, np.uint64)  # hashes of the merges' ends
        self.merge_first, self.merge_size = np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        """Keep the ids and merges of new units."""
        long = np.fromiter((bool(self.edge) and len(u) > EVEN for u in units), bool, len(units))
        made: list = []
        plain = ["" if x else u for u, x in zip(units, long.tolist())]
        flat, size = self.vocabulary.segment_all(plain, np.zeros(len(units), np.int64), 0.0, self.seed,
                                                 made if self.edge else None)
        owner = np.concatenate([np.empty(0, np.int64), *(m[0] for m in made)]).astype(np.int64)
        hashes = np.concatenate([np.empty(0, np.uint64), *(_ends_hash(*m[1:]) for m in made)])
        merges = np.bincount(owner, minlength=len(units))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.merge_first = np.concatenate([self.merge_first, len(self.merges) + np.cumsum(merges) - merges])
        self.size, self.merge_size = np.concatenate([self.size, size]), np.concatenate([self.merge_size, merges])
        self.ids = np.concatenate([self.ids, flat])
        self.merges = np.concatenate([self.merges, hashes[np.argsort(owner, kind="stable")]])
        self.long = np.concatenate([self.long, long])
        self.key = np.concatenate([self.key, unit_keys(units, self.seed)])

    def encode(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each text)."""
        if self.chars > self.limit:
            self._forget()
        units = [UNIT.findall(" " + t) if t else [] for t in texts]
        counts = np.fromiter(map(len, units), np.int64, len(units))
        known = self.place.known
        old = len(known)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        if len(known) > old:
            new = known[old:]
            self.chars += sum(map(len, new)) + 16 * len(new)
            self._learn(new)
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        first, lens, pool = self.first[at], self.size[at], self.ids
        if self.edge:
            draw = mix64(keys[owner] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            n = self.merge_size[at]
            merge = np.arange(int(n.sum())) + np.repeat(self.merge_first[at] - (np.cumsum(n) - n), n)
            skip = _skipped(np.repeat(self.key[at] + draw, n) ^ self.merges[merge], self.edge)
            anew = self.long[at]
            anew[np.repeat(np.arange(len(at)), n)[skip]] = True
            anew = np.flatnonzero(anew)
            again = at[anew]
            flat, size = self.vocabulary.segment_all([known[k] for k in again.tolist()], draw[anew], self.dropout, self.seed,
                                                     keys=self.key[again])
            first[anew], lens[anew] = len(pool) + np.cumsum(size) - size, size
            pool = np.concatenate([pool, flat])
        source = np.arange(int(lens.sum())) + np.repeat(first - (np.cumsum(lens) - lens), lens)
        return pool[source].astype(np.int32), np.bincount(owner, lens, len(texts)).astype(np.int64)


_ENCODERS: dict = {}  # one a worker process, kept over tasks


def _encode_rows(vocabulary, path: str, dropout: float, seed: int, check: bool = False):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        setting = (path, dropout, seed)
        encoder = _ENCODERS.get(setting)
        if encoder is None:
            encoder = _ENCODERS[setting] = UnitEncoder(vocabulary.value, dropout, seed)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [x or "" for x in part.column("text").to_pylist()]
                keys = part.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
                ids, counts = encoder.encode(texts, mix64(keys ^ np.uint64(seed)))
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns = {"doc_id": part.column("doc_id"),
                           "text_crc32": pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                           "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))}
                if check:
                    flat, at = ids.tolist(), ends.tolist()
                    columns["lossless"] = pa.array([
                        encoder.vocabulary.decode(flat[a:b]) == t.encode() for a, b, t in zip(at, at[1:], texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows


def encode(docs: DataFrame, vocabulary_path: str, dropout: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id",
           text_col: str = "text", check: bool = False) -> DataFrame:
    """(doc_id, text_crc32, ids) of every row; with ``check`` also whether the
    ids decode to the text (lossless).

    Null and empty texts have no ids; rows with the same id and text get the
    same ids; an empty table gives no rows; other columns are never read.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"))
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))  # a fixed vocabulary file
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(_encode_rows(vocabulary, vocabulary_path, dropout, seed, check)),
                           f"doc_id {kind}, text_crc32 long, ids array<int>" + ", lossless boolean" * check)


def _decode_rows(vocabulary):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            ids = batch.column("ids")
            flat, ends = ids.flatten().tolist(), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in ids)]).tolist()
            texts = [v.decode(flat[a:b]).decode() for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, "decoded"])

    return rows


def decode(rows: DataFrame, vocabulary_path: str) -> DataFrame:
    """``rows`` (with ``ids``) and the column ``decoded``; no ids: the empty text."""
    spark = prepare(rows.sparkSession)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(vocabulary_path))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(_decode_rows(vocabulary)), fields + ", decoded string")


def encode_and_check(docs: DataFrame, vocabulary_path: str, dropout: float = DROPOUT, seed: int = SEED,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, lossless) of every row: encoded and decoded in the
    same task, so that an executor needs one Python worker a core."""
    rows = encode(docs, vocabulary_path, dropout, seed, id_col, text_col, check=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "lossless")
