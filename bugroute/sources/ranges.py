"""Binary word2vec models and zip bundles as planned Spark data sources (SRC6, SRC8).

Neither format has record marks that Spark's own sources could split at, so the
partitions are planned from the files themselves: a model is cut where two
neighbouring records are recognised by the fixed length of their vectors, an
archive by its central directory.  The driver reads a few kilobytes for each cut;
every task then reads its own range as a stream and gives bounded batches, so no
row, task or driver ever holds a file or an archive member.

A range of a model has to end exactly where the next one begins; a cut at bytes
that only look like a record would break that, and is an error, not other rows.

Files are opened by ``pyarrow.fs`` (local disks, HDFS, S3, GCS).  Compressed models
(``.gz``) can't be cut and stay with ``read_word2vec_binary``'s other way.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES = 64 << 20
READ_BYTES = 4 << 20
BATCH_ROWS = 4096
MAX_WORD = 2000     # bytes; a longer word only makes a cut less likely to be found
CHECKED = 12        # records that have to follow one another at a cut


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def data_files(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of all data files of the folder, in order."""
    store, at = open_store(path)
    prefix = path[:len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
    names = ((x.path, x.size) for x in found if x.is_file)
    return sorted((prefix + p, n) for p, n in names if n and p.endswith(suffix) and not p.rsplit("/", 1)[-1].startswith(("_", ".")))


# ---------------------------------------------------------------- word2vec

@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    dims: int


class Records:
    """The records from ``start`` on, read in blocks: word, blank, vector and, with
    ``linebreaks``, one more byte; line ends in front of a word don't count."""

    def __init__(self, file, start: int, dims: int, linebreaks: bool):
        self.file, self.at, self.size, self.linebreaks = file, start, 4 * dims, linebreaks
        self.data, self.pos = b"", 0
        file.seek(start)

    def _more(self) -> bool:
        block = self.file.read(READ_BYTES)
        if block:
            self.data, self.at, self.pos = self.data[self.pos:] + block, self.at + self.pos, 0
        return bool(block)

    def next(self) -> tuple[bytes, bytes] | None:
        """(word, vector bytes), None at the end of the file."""
        while True:
            stop = self.data.find(b" ", self.pos)
            end = stop + 1 + self.size
            if stop >= 0 and end + self.linebreaks <= len(self.data):
                break
            if not self._more():
                if stop >= 0 and end == len(self.data):
                    break   # the last line end may be missing
                if self.data[self.pos:].strip(b"\n"):
                    raise ValueError(f"the file ends inside a record, at byte {self.at + self.pos}")
                self.pos = len(self.data)
                return None
        word = self.data[self.pos:stop].replace(b"\n", b"")
        vector = self.data[stop + 1:end]
        self.pos = min(end + self.linebreaks, len(self.data))
        return word, vector

    def tell(self) -> int:
        return self.at + self.pos


def read_header(file, path: str) -> tuple[int, int, int]:
    """(words, dims, bytes of the header)."""
    line = file.read(200).split(b"\n")[0]
    try:
        words, dims = (int(x) for x in line.split()[:2])
    except ValueError:
        raise ValueError(f"{path}: no header `words dims`") from None
    if words < 0 or dims < 1:
        raise ValueError(f"{path}: no header `words dims`")
    return words, dims, len(line) + 1


def _plausible(word: bytes, vector: bytes) -> bool:
    if not 0 < len(word) <= MAX_WORD or any(c < 0x20 or c == 0x7F for c in word):
        return False
    try:
        word.decode("utf-8")
    except UnicodeDecodeError:
        return False
    v = np.frombuffer(vector, "<f4")
    return bool(np.isfinite(v).all() and (np.abs(v[v != 0]) > 1e-30).all() and (np.abs(v) < 1e15).all())


def first_record(file, at: int, size: int, dims: int, linebreaks: bool) -> int | None:
    """A place soon after ``at`` where a record begins; None if none is certain.

    Behind every blank byte a vector may lie, and then a record begins.  From each
    such place records are followed to the window's end, ``CHECKED`` of them at
    least; a place that all surviving chains pass is a record's, since the true
    chain is among them.
    """
    length = 4 * dims + MAX_WORD + 2
    file.seek(at)
    window = file.read(length * (CHECKED + 2))
    last = at + len(window) >= size
    following: dict[int, int | None] = {}   # None: no record; -1: the window ends

    def after(pos: int) -> int | None:
        if last and not window[pos:pos + 2].strip(b"\n"):
            return -1
        stop = window.find(b" ", pos, pos + MAX_WORD + 2)
        end = stop + 1 + 4 * dims
        if stop < 0 or end > len(window):
            return None if last or (stop < 0 and len(window) - pos >= MAX_WORD + 2) else -1
        if not _plausible(window[pos:stop].lstrip(b"\n"), window[stop + 1:end]):
            return None
        return min(end + linebreaks, len(window))

    common, blank = None, -1
    while 0 <= (blank := window.find(b" ", blank + 1)) < length:
        pos = blank + 1 + 4 * dims + linebreaks
        chain = []
        while pos is not None and 0 <= pos < len(window):
            chain.append(pos)
            if pos not in following:
                following[pos] = after(pos)
            pos = following[pos]
        if pos is None or len(chain) < (1 if last else CHECKED):
            continue
        common = set(chain) if common is None else common & set(chain)
        if not common:
            return None
    return at + min(common) if common else None


class Word2VecReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.linebreaks = options.get("linebreaks", "false").lower() == "true"
        self.normalize = options.get("normalize", "true").lower() == "true"
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path, size in data_files(self.path):
            if path.endswith(".gz"):
                continue
            store, at = open_store(path)
            with store.open_input_file(at) as file:
                words, dims, head = read_header(file, path)
                if not words:
                    continue
                cuts = [head]
                for near in range(head + self.partition_bytes, size, self.partition_bytes):
                    found = first_record(file, near, size, dims, self.linebreaks)
                    if found is not None and cuts[-1] < found < size:
                        cuts.append(found)
            out += [Range(path, a, b, dims) for a, b in zip(cuts, [*cuts[1:], size])]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.dims:
            return
        store, at = open_store(partition.path)
        with store.open_input_file(at) as file:
            records = Records(file, partition.start, partition.dims, self.linebreaks)
            words, vectors = [], []
            while records.tell() < partition.end and (found := records.next()):
                words.append(found[0].decode("utf-8", "replace"))
                vectors.append(found[1])
                if len(words) >= BATCH_ROWS:
                    yield self._batch(words, vectors, partition.dims)
                    words, vectors = [], []
            if records.tell() != partition.end:
                raise ValueError(f"{partition.path}: a record goes on after byte {partition.end}, where another should begin")
            if words:
                yield self._batch(words, vectors, partition.dims)

    def _batch(self, words: list[str], vectors: list[bytes], dims: int) -> pa.RecordBatch:
        values = np.frombuffer(b"".join(vectors), "<f4").reshape(-1, dims)
        if self.normalize:
            norm = np.sqrt((values.astype(np.float64) ** 2).sum(1, keepdims=True))
            values = (values / np.where(norm > 0, norm, 1)).astype(np.float32)
        offsets = pa.array(np.arange(0, dims * len(words) + 1, dims, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                                          names=["word", "vector"])


class Word2VecBinary(DataSource):
    """``format("word2vec-binary")``: (word, vector); options path, linebreaks,
    normalize, partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "word2vec-binary"

    def schema(self) -> str:
        return "word string, vector array<float>"

    def reader(self, schema) -> Word2VecReader:
        return Word2VecReader(self.options)


# ---------------------------------------------------------------- zip bundles

@dataclass
class Member(InputPartition):
    path: str
    part: str


class ZipLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[Member]:
        out = []
        for path, _ in data_files(self.path):
            store, at = open_store(path)
            with store.open_input_file(at) as file, zipfile.ZipFile(file) as z:
                out += [Member(path, x.filename) for x in z.infolist() if not x.is_dir()]
        return out or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, at = open_store(partition.path)
        with store.open_input_file(at) as file, zipfile.ZipFile(file) as z, z.open(partition.part) as raw:
            lines, first = [], 0
            for line in io.TextIOWrapper(raw, encoding="utf-8", newline="\n"):
                lines.append(line.rstrip("\n").rstrip("\r"))
                if len(lines) >= BATCH_ROWS:
                    yield self._batch(partition, first, lines)
                    lines, first = [], first + len(lines)
            if lines:
                yield self._batch(partition, first, lines)

    @staticmethod
    def _batch(partition: Member, first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays(
            [pa.array([partition.path] * n), pa.array([partition.part] * n), pa.array(np.arange(first, first + n)), pa.array(lines, pa.string())],
            names=["file", "part", "line_no", "line"])


class ZipLines(DataSource):
    """``format("zip-lines")``: (file, part, line_no, line) of every text member of
    the zip files at the option path."""

    @classmethod
    def name(cls) -> str:
        return "zip-lines"

    def schema(self) -> str:
        return "file string, part string, line_no long, line string"

    def reader(self, schema) -> ZipLinesReader:
        return ZipLinesReader(self.options)
