import pytest
from pyspark.sql import functions as F

from bugroute.functions.arrays import pad_array
from bugroute.operators import categories as cat
from bugroute.operators import ordering as order
from bugroute.operators import vectors as vec


def test_with_progress_counts_rows(spark):
    df, obs = order.with_progress(spark.range(123))
    df.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 123


def test_split_hash_is_stable(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in order.split_hash(df, "k", 80).where("is_train").collect()}
    b = {r.k for r in order.split_hash(df.repartition(7), "k", 80).where("is_train").collect()}
    assert a == b and 700 < len(a) < 900


def test_save_embeddings_keeps_each_epoch(spark, tmp_out):
    from bugroute.sinks.vectors import save_embeddings

    base = tmp_out("emb")
    df = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")
    for e in (3, 12):
        save_embeddings(df, base, e)
    epochs = sorted(r.epoch for r in spark.read.parquet(base).select("epoch").distinct().collect())
    assert epochs == [3, 12]


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([("b",), ("z",), ("a",)], "c string")
    got = {r.c_orig: r.c.toArray().tolist() for r in
           cat.one_hot(df.withColumn("c_orig", F.col("c")), "c", ["a", "b"], out="vector").collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "z": [0.0, 0.0]}


def test_one_hot_columns_and_strict(spark):
    import pytest

    df = spark.createDataFrame([("b",)], "c string")
    row = cat.one_hot(df, "c", ["a", "b"], out="columns").first()
    assert row["c[a]"] == 0.0 and row["c[b]"] == 1.0
    with pytest.raises(Exception):
        cat.one_hot(spark.createDataFrame([("x",)], "c string"), "c", ["a"], strict=True).collect()


def test_pad_array(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "a array<int>")
    assert df.select(pad_array("a", 5).alias("p")).first().p == [1, 2, 3, 0, 0]
    assert df.select(pad_array("a", 2).alias("p")).first().p == [1, 2]


def test_hot_class_and_hot_token(spark):
    """A class holding over a third of the rows and a token in every document:
    results equal a plain-Python computation."""
    from collections import Counter

    from bugroute.operators import evaluate as ev
    from bugroute.operators import vectors as vec

    pairs = [(0, 0)] * 400 + [(1, 0)] * 50 + [(1, 1)] * 300 + [(2, 2)] * 250
    df = spark.createDataFrame(pairs, "label int, prediction int").repartition(7)
    pc = {r["class"]: (r.tp, r.fp, r.fn) for r in ev.per_class(df).collect()}
    cnt = Counter(pairs)
    for c in (0, 1, 2):
        tp = cnt[(c, c)]
        fp = sum(v for (l, p), v in cnt.items() if p == c and l != c)
        fn = sum(v for (l, p), v in cnt.items() if l == c and p != c)
        assert pc[c] == (tp, fp, fn)

    docs = spark.createDataFrame([(i, "the " * 50 + f"w{i % 3}") for i in range(60)], "k long, text string")
    wv = spark.createDataFrame([("the", [1.0, 0.0]), ("w", [0.0, 1.0])], "word string, vector array<double>")
    got = {r.k: r.vector for r in vec.doc_vectors(docs, wv, "k", 1, 2).collect()}
    # digits are stripped from tokens, so w0/w1/w2 all look up "w"
    assert all(v == [50 / 51, 1 / 51] for v in got.values()) and len(got) == 60


def test_divide_rows(spark, tmp_out):
    """Every row in one part, under the first rule that rejects it; undecided ones go."""
    from bugroute.operators.columns import divide_rows

    df = spark.createDataFrame([(1, 5, "a"), (2, 30, "b"), (3, None, "c"), (4, 7, ""), (5, 40, ""), (6, 7, None)], "id long, c int, t string")
    rules = {"large": F.col("c") > 25, "no text": F.length("t") == 0}
    kept, gone, counts = divide_rows(df, rules, tmp_out("verdicts"))
    assert sorted(map(tuple, kept.collect())) == [(1, 5, "a")] and kept.columns == df.columns
    assert {r.id: r.verdict for r in gone.collect()} == {2: "large", 3: "large", 4: "no text", 5: "large", 6: "no text"}
    assert counts == {"kept": 1, "large": 3, "no text": 2}
    kept, gone, counts = divide_rows(df.limit(0), rules, tmp_out("verdicts-none"))
    assert kept.count() == gone.count() == 0 and set(counts.values()) == {0}


@pytest.mark.parametrize("height", [1, 25])
def test_group_means_shuffle_texts_and_not_vectors(spark, height):
    """One exchange, of the texts by key; the same means by a shuffle join; rows of one key count together."""
    texts = [("a", "red green red blue one two three"), ("b", "green"), ("a", "blue"), (None, "red"), ("c", "")]
    docs = spark.createDataFrame(texts, "k string, text string")
    wv = spark.createDataFrame([("red", [1.0, 2.0]), ("green", [3.0, 5.0]), ("blue", [-4.0, 0.5])], "word string, vector array<double>")
    near = vec.group_vector_arrays(docs, wv, "k", height, 2)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == 1
    far = vec.group_vector_arrays(docs, wv, "k", height, 2, broadcast_cell_limit=0)
    got = {r.k: r.vectors for r in near.collect()}
    assert got == {r.k: r.vectors for r in far.collect()} and set(got) == {"a", "b", None}
    if height == 1:
        assert got["b"] == [[3.0, 5.0]]


@pytest.mark.parametrize("vector", [[1.0, 2.0, 3.0], [1.0, None]])
def test_word_vector_of_another_size_or_with_nulls_is_an_error(spark, vector):
    docs = spark.createDataFrame([("a", "red blue")], "k string, text string")
    wv = spark.createDataFrame([("red", [1.0, 2.0]), ("blue", None)], "word string, vector array<double>")
    assert [r.vectors for r in vec.group_vector_arrays(docs, wv, "k", 1, 2).collect()] == [[[1.0, 2.0]]]
    wv = spark.createDataFrame([("red", vector)], "word string, vector array<double>")
    with pytest.raises(Exception, match="nulls or not 2 components"):
        vec.group_vector_arrays(docs, wv, "k", 1, 2).collect()
