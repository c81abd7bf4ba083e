"""Sink -> source round trips and reader edge cases."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugroute.sources import vectors as src
from bugroute.sinks import vectors as snk


def _write_lines(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def _local(p):
    return p[5:] if p.startswith("file:") else p


@pytest.mark.parametrize("first,header", [
    ("100 3", True), ("w 0.1 0.2", True), ("w 0.1 0.2 0.3", False), ("w a b c", True), ("word", True)])
def test_auto_header_rule(spark, first, header):
    row = spark.createDataFrame([(first,)], "value string").select(src.is_header(F.col("value"))).first()
    assert row[0] is header


def test_header_is_one_line_per_file(spark, tmp_out):
    path = _local(tmp_out("wv-many"))
    _write_lines(path + "/a.txt", ["a 1 2 3", "b 1 2 3", "a 1 2 3", "c 1 2 3"])
    _write_lines(path + "/b.txt", ["1 3", "d 1 2 3"])
    words = lambda **kw: sorted(r.word for r in src.read_word_vectors(spark, path, **kw).collect())
    assert words() == ["a", "a", "b", "c", "d"]
    assert words(header=True) == ["a", "b", "c", "d"]
    assert words(header=False) == ["1", "a", "a", "b", "c", "d"]


@pytest.mark.parametrize("line", ['{"word": "x", "count": 1}', '{"word": "x", "syn0": [1.0', "no json"])
def test_broken_model_line_raises(spark, tmp_out, line):
    path = _local(tmp_out("model-bad")) + "/m.json"
    good = '{"word":"a","count":1.0,"huffmanNode":{"idx":0},"syn0":[1.0]}'
    _write_lines(path, ['{"layersSize": 1}', "0.1 0.2", "", good])
    words, config = src.read_full_model(spark, path)
    assert [r.word for r in words.collect()] == ["a"] and config.count() == 1
    _write_lines(path, ['{"layersSize": 1}', "", "", good, line])
    with pytest.raises(Exception):
        src.read_full_model(spark, path)[0].collect()


def test_broken_sequence_line_raises(spark, tmp_out):
    import base64

    path = _local(tmp_out("seq-bad")) + "/s.txt"
    enc = lambda x: base64.b64encode(x.encode()).decode()
    _write_lines(path, [enc('{"layersSize": 1}'), enc('{"object": "a", "vector": [1.0]}')])
    elements, config = src.read_sequence_vectors(spark, path)
    assert [r.object for r in elements.collect()] == ["a"] and config.count() == 1
    for bad in (enc('{"object": "b"}'), enc('{"vector": [1.0'), "***"):
        _write_lines(path, [enc('{"layersSize": 1}'), bad])
        with pytest.raises(Exception):
            src.read_sequence_vectors(spark, path)[0].collect()


def test_zip_bundle_tables(spark, tmp_out):
    import zipfile

    path = _local(tmp_out("zip-all"))
    os.makedirs(path)
    with zipfile.ZipFile(path + "/b.zip", "w") as z:
        z.writestr("syn0.txt", "new_Az92_york 1 2 3 \nb 3 4 5 \n")
        z.writestr("syn1.txt", "0.5 0.25 \n1.5 2.5 \n")
        z.writestr("codes.txt", "b 0 1 \nnobody 1 \n")
        z.writestr("huffman.txt", "b 7 8 \nnew_Az92_york 9 \n")
        z.writestr("labels.txt", " b \nunknown\n")
        z.writestr("config.json", "{}\n")
    rows = {r.word: r for r in src.read_zip_bundle(spark, path + "/b.zip").collect()}
    assert set(rows) == {"new york", "b"} and rows["b"].is_label and not rows["new york"].is_label
    assert (rows["b"].idx, rows["b"].vector, rows["b"].syn1, rows["b"].codes, rows["b"].points) == (
        1, [3.0, 4.0, 5.0], [1.5, 2.5], [0, 1], [7, 8])
    assert rows["new york"].codes is None and rows["new york"].points == [9] and rows["new york"].idx == 0


def test_read_word_vectors_auto_header(spark, tmp_out):
    path = _local(tmp_out("wv")) + "/v.txt"
    _write_lines(path, ["2 3", "new_Az92_york 0.5 NaN 1.5 ", "b 1 2 3"])
    rows = {r.word: list(r.vector) for r in src.read_word_vectors(spark, path).collect()}
    assert rows == {"new york": [0.5, 0.0, 1.5], "b": [1.0, 2.0, 3.0]}
    strict = {r.word for r in src.read_word_vectors(spark, path, strict_dims=True).collect()}
    assert strict == {"new york", "b"}


def test_strict_dims_rejects_bad_row(spark, tmp_out):
    path = _local(tmp_out("wv-bad")) + "/v.txt"
    _write_lines(path, ["2 3", "a 1 2 3", "b 1 2"])
    with pytest.raises(Exception):
        src.read_word_vectors(spark, path, strict_dims=True).collect()


def test_tagged_bad_tag_raises(spark, tmp_out):
    path = _local(tmp_out("tag-bad")) + "/t.txt"
    _write_lines(path, ["L a 1 2", "X b 1 2"])
    with pytest.raises(Exception):
        src.read_tagged_vectors(spark, path).collect()


def _embeddings(spark):
    from tests.conftest import SF_SMALL
    from bugroute.sources.tables import load_table

    return load_table(spark, SF_SMALL, "embeddings").select(
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector"))


def _write_word2vec_binary(path, rows, linebreaks=False):
    dims = len(rows[0][1])
    with open(path, "wb") as f:
        f.write(f"{len(rows)} {dims}\n".encode())
        for w, v in rows:
            f.write(w.encode() + b" " + np.asarray(v, dtype="<f4").tobytes())
            if linebreaks:
                f.write(b"\n")


@pytest.mark.parametrize("linebreaks", [False, True])
def test_word2vec_binary(spark, tmp_out, linebreaks):
    rows = [(r.word, list(r.vector)) for r in _embeddings(spark).collect()]
    path = _local(tmp_out("w2v"))
    os.makedirs(path)
    _write_word2vec_binary(path + "/m.bin", rows, linebreaks)
    got = {r.word: np.asarray(r.vector) for r in
           src.read_word2vec_binary(spark, path + "/m.bin", linebreaks=linebreaks, normalize=True).collect()}
    assert set(got) == {w for w, _ in rows}
    for w, v in rows:
        v = np.asarray(v, dtype=np.float64)
        np.testing.assert_allclose(got[w], v / np.linalg.norm(v), rtol=1e-5, atol=1e-6)


def test_zip_bundle_lines(spark, tmp_out):
    import zipfile

    path = _local(tmp_out("zip"))
    os.makedirs(path)
    with zipfile.ZipFile(path + "/b.zip", "w") as z:
        z.writestr("syn0.txt", "a 1 2\nb 3 4\n")
        z.writestr("labels.txt", "a\n")
    rows = sorted(tuple(r) for r in src.read_bundle_zip(spark, path + "/b.zip").drop("file").collect())
    assert rows == [("labels.txt", 0, "a"), ("syn0.txt", 0, "a 1 2"), ("syn0.txt", 1, "b 3 4")]


def test_vectors_text_round_trip_gzip(spark, tmp_out):
    df = _embeddings(spark)
    path = tmp_out("wv-gz")
    snk.write_word_vectors(df, path, compression="gzip")
    back = src.read_word_vectors(spark, path, header=False)
    a = {r.word: list(r.vector) for r in df.collect()}
    b = {r.word: list(r.vector) for r in back.collect()}
    assert a == b


def test_bugs_csv_round_trip(spark, tmp_out):
    from tests.conftest import SF_SMALL
    from bugroute.sinks.bugs_csv import flatten_text, write_bugs_csv
    from bugroute.sources.bugs_csv import read_bugs, rejected
    from bugroute.sources.tables import bugs_table
    from bugroute.schema import BUG_SCHEMA

    bugs = bugs_table(spark, SF_SMALL)
    path = tmp_out("bugs-csv")
    write_bugs_csv(bugs, path)
    back = read_bugs(spark, path, keep_corrupt=True)
    assert rejected(back).collect() == []  # whole rows: Spark refuses a corrupt-column-only scan
    cols = [f.name for f in BUG_SCHEMA.fields]
    want = flatten_text(bugs).select(*cols)
    # empty text cells come back as null (CSV default); compare with that rule
    norm = [F.when(F.col(c) == "", None).otherwise(F.col(c)).alias(c) if dict(want.dtypes)[c] == "string"
            else F.col(c) for c in cols]
    assert sorted(map(tuple, want.select(*norm).collect())) == \
        sorted(map(tuple, back.select(*norm).collect()))
    restricted = read_bugs(spark, path, columns=[5, 13])
    assert restricted.columns == ["component_id", "class"]


def test_embedding_bundle_labels_optional(spark, tmp_out):
    df = _embeddings(spark).withColumn("idx", F.substring("word", 2, 12).cast("int"))
    path = tmp_out("bundle")
    snk.write_embedding_bundle(path, df)
    b = src.read_embedding_bundle(spark, path)
    assert b.where("is_label").count() == 0 and b.count() == df.count()
