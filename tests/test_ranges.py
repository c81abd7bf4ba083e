"""Binary models cut into ranges, zip bundles by members, and Huffman codes."""

import gzip
import heapq
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugroute.operators import huffman
from bugroute.sinks import binary
from bugroute.sources import ranges
from bugroute.sources import vectors as src


def _local(p):
    return p[5:] if p.startswith("file:") else p


def _model(path, rows, dims, linebreaks, last=True):
    with open(path, "wb") as f:
        f.write(f"{len(rows)} {dims}\n".encode())
        for k, (w, v) in enumerate(rows):
            f.write(w.encode() + b" " + np.asarray(v, "<f4").tobytes())
            if linebreaks and (last or k < len(rows) - 1):
                f.write(b"\n")


def _words(n, rng):
    return [f"{'é日w'[i % 3] * rng.randrange(1, 9)}{i}" for i in range(n)]


@pytest.mark.parametrize("linebreaks, dims, last", [(False, 3, True), (True, 3, True), (True, 50, False), (False, 50, True)])
def test_every_range_gives_the_same_rows(spark, tmp_out, linebreaks, dims, last):
    rng = random.Random(dims)
    # vectors full of blanks, line ends and letters: bytes that look like records
    odd = np.frombuffer(b"  a \n b ", "<f4")
    rows = [(w, [float(odd[rng.randrange(2)]) if rng.random() < 0.5 else rng.gauss(0, 1) for _ in range(dims)]) for w in _words(3000, rng)]
    path = _local(tmp_out("w2v-ranges"))
    os.makedirs(path)
    _model(path + "/m.bin", rows, dims, linebreaks, last)
    want = sorted((w, [float(np.float32(x)) for x in v]) for w, v in rows)
    for size in (1000, 7777, 1 << 30):
        df = src.read_word2vec_binary(spark, path + "/m.bin", linebreaks, normalize=False, partition_bytes=size)
        assert sorted((r.word, r.vector) for r in df.collect()) == want
        if size == 7777:
            assert df.rdd.getNumPartitions() > 3


def test_files_of_a_folder_and_gzip(spark, tmp_out):
    path = _local(tmp_out("w2v-folder"))
    os.makedirs(path)
    _model(path + "/a.bin", [("a", [1, 2]), ("b", [3, 4])], 2, False)
    _model(path + "/none.bin", [], 2, False)
    _model(path + "/c.bin", [("c", [3, 4])], 2, True)
    with open(path + "/c.bin", "rb") as f, gzip.open(path + "/d.bin.gz", "wb") as g:
        g.write(f.read().replace(b"c ", b"d "))
    rows = {r.word: r.vector for r in src.read_word2vec_binary(spark, path).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["d"] == pytest.approx([0.6, 0.8])
    assert rows == {r.word: r.vector for r in src.read_word2vec_binary(spark, "file://" + path).collect()}


@pytest.mark.parametrize("data, says", [(b"2 3\na " + b"0" * 12 + b"b " + b"0" * 5, "ends inside"), (b"a b\n", "no header"), (b"", "")])
def test_broken_models(spark, tmp_out, data, says):
    path = _local(tmp_out("w2v-bad"))
    os.makedirs(path)
    with open(path + "/m.bin", "wb") as f:
        f.write(data)
    if not data:
        assert src.read_word2vec_binary(spark, path).collect() == []
        return
    with pytest.raises(Exception, match=says):
        src.read_word2vec_binary(spark, path).collect()


def test_a_false_cut_is_an_error(tmp_path):
    _model(tmp_path / "m.bin", [(f"w{k}", [k, 1]) for k in range(100)], 2, False)
    size = os.path.getsize(tmp_path / "m.bin")
    reader = ranges.Word2VecReader({"path": str(tmp_path / "m.bin")})
    with pytest.raises(ValueError, match="goes on after"):
        list(reader.read(ranges.Range(str(tmp_path / "m.bin"), 6, size // 2 + 1, 2)))


def test_members_are_streamed(spark, tmp_out):
    path = _local(tmp_out("zip-members"))
    os.makedirs(path)
    lines = [f"w{i} {'x' * (i % 50)} é" for i in range(20_000)]
    with zipfile.ZipFile(path + "/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("big.txt", "\n".join(lines))
        z.writestr("crlf.txt", "a\r\nb\r\n")
        z.writestr("empty.txt", "")
    rows = src.read_bundle_zip(spark, path).collect()
    got = {p: [r.line for r in sorted(rows, key=lambda r: r.line_no) if r.part == p] for p in ("big.txt", "crlf.txt", "empty.txt")}
    assert got == {"big.txt": lines, "crlf.txt": ["a", "b"], "empty.txt": []}


def test_zip_bundle_is_a_zip(spark, tmp_out):
    path = _local(tmp_out("zip-written"))
    v = spark.createDataFrame([("new york", 0, [1.0, 2.0, 0.5]), ("b", 1, [3.0, 4.0, 0.5]), (None, 2, [0.0, 0.0, 0.0])], "word string, idx int, vector array<float>")
    codes = spark.createDataFrame([("b", [0, 1], [7, 8])], "word string, codes array<int>, points array<int>")
    labels = spark.createDataFrame([("new york",), (None,)], "label string")
    binary.write_zip_bundle(path, v, codes=codes, labels=labels)
    (name,) = [n for n in os.listdir(path) if n.startswith("part")]
    with zipfile.ZipFile(f"{path}/{name}") as z:
        assert z.testzip() is None
        assert z.read("syn0.txt") == b"new_Az92_york 1.0 2.0 0.5\nb 3.0 4.0 0.5\n" and z.read("labels.txt") == b"new_Az92_york\n"
    rows = {r.word: r for r in src.read_zip_bundle(spark, path).collect()}
    assert rows["new york"].is_label and rows["b"].codes == [0, 1] and rows["b"].points == [7, 8] and rows["b"].idx == 1


def test_word2vec_files_have_headers(spark, tmp_out):
    path = _local(tmp_out("w2v-written"))
    df = spark.range(50).select(F.concat(F.lit("w "), "id").alias("word"), F.array(F.col("id").cast("float"), F.lit(10.0)).alias("vector"))
    binary.write_word2vec_binary(df.union(df.limit(1).select(F.lit(None).cast("string"), "vector")), path, rows_per_file=20)
    files = [f"{path}/{n}" for n in os.listdir(path) if n.startswith("part")]
    heads = [open(f, "rb").readline() for f in files]
    assert sum(int(h.split()[0]) for h in heads) == 50 and all(h.split()[1] == b"2" for h in heads)
    for breaks in (False, True):
        rows = {r.word: r.vector for r in src.read_word2vec_binary(spark, path, breaks, normalize=False).collect()}
        assert rows == {f"w_Az92_{i}": [float(i), 10.0] for i in range(50)}


def heap_codes(counts):
    """Codes and points by a heap; counts in order of idx (descending).  An inner
    node goes before a word of the same count, words from the last on."""
    n = len(counts)
    heap = [(c, 1, n - 1 - i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, bit, made = {}, {}, 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for side, x in enumerate((a, b)):
            parent[x[3]], bit[x[3]] = n + made, side
        heapq.heappush(heap, (a[0] + b[0], 0, made, n + made))
        made += 1
    out = []
    for i in range(n):
        codes, points, at = [], [], i
        while at in parent:
            codes.append(bit[at])
            at = parent[at]
            points.append(at - n)
        out.append((codes[::-1], points[::-1]))
    return out


@pytest.mark.parametrize("counts", [[], [5], [2, 1], [1, 1, 1], [3] * 64, [9, 9, 4, 4, 4, 2, 2, 2, 2, 1], [2 ** k for k in range(30, -1, -1)],
                                    sorted((int(1e6 / (k + 1) ** 1.1) + 1 for k in range(20_000)), reverse=True)])
def test_huffman_against_a_heap(spark, counts):
    vocab = spark.createDataFrame([(f"w{i}", c, i) for i, c in enumerate(counts)], "word string, count long, idx long").repartition(4)
    got = {r.idx: (r.codes, r.points) for r in huffman.huffman_codes(vocab).collect()}
    assert got == dict(enumerate(heap_codes(counts)))


def test_huffman_of_the_documents(spark):
    from bugroute.operators import text as txt
    from bugroute.operators.vectors import build_vocab
    from bugroute.sources.tables import load_table

    docs = txt.tokens(load_table(spark, "/root/testdata/sf0.1", "documents").select("text"), "text")
    vocab = build_vocab(docs).checkpoint()
    counts = [r["count"] for r in vocab.orderBy("idx").collect()]
    got = {r.idx: (r.codes, r.points) for r in huffman.huffman_codes(vocab).collect()}
    assert len(got) > 50_000 and got == dict(enumerate(heap_codes(counts)))
