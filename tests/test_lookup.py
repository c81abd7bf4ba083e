"""Rows of large tables come to the texts, and not the texts' tokens to the table."""

import random

import pytest
from pyspark.sql import functions as F

from bugroute.operators import vectors as vec
from bugroute.operators.embedding import token_ids


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("height", [1, 25])
def test_large_word_table_comes_to_the_texts(spark, height):
    """No vector is shuffled for a (key, task), and means are those of the broadcast table,
    with keys and words that repeat and null keys."""
    rng = random.Random(4)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    rows = [(None if i % 17 == 0 else i % 40, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "k int, text string").repartition(5)
    vectors = [(w, [float(i), -i / 4]) for i, w in enumerate(words[:50])] + [(words[3], [8.0, 8.0]), (words[4], None), (None, [1.0, 1.0])]
    wv = spark.createDataFrame(vectors, "word string, vector array<float>")
    near = vec.group_vector_arrays(docs, wv, "k", height, 2)
    far = vec.group_vector_arrays(docs, wv, "k", height, 2, broadcast_cell_limit=0)
    assert "hashpartitioning(k" not in plan_of(far) and "SortMergeJoin [__slot" not in plan_of(far)

    def rows_of(df):
        return sorted((r.k or -1, [[round(x, 9) for x in v] for v in r.vectors]) for r in df.collect())

    assert rows_of(far) == rows_of(near) and len(rows_of(far)) > 30

    def whole(limit):
        out = vec.doc_vectors(docs, wv, "k", height, 2, broadcast_cell_limit=limit)
        return sorted((r.k or -1, r.group, [round(x, 9) for x in r.vector]) for r in out.collect())

    assert whole(0) == whole(10_000) and len(whole(0)) == 90 * height


def test_large_vocabulary_comes_to_the_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(None if i == 7 else i % 70, i % 2, [rng.choice([*words, "other", None]) for _ in range(rng.randint(0, 40))]) for i in range(80)]
    docs = spark.createDataFrame([*rows, (99, 0, None)], "id int, side int, tokens array<string>").repartition(6)
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, idx long")
    far = token_ids(docs.where("side = 0"), "id", "tokens", vocab, keep=("side",), broadcast_words=0)
    assert "hashpartitioning(id" not in plan_of(far)
    near = token_ids(docs.where("side = 0"), "id", "tokens", vocab, keep=("side",))
    assert far.columns == near.columns

    def found(df):
        return sorted((r.id or -1, r.side, sorted(r.ids)) for r in df.collect())

    assert found(far) == found(near) and len(found(far)) > 30
    # a document of its own keeps its order
    want = {r[0]: [words.index(t) for t in r[2] if t in words] for r in rows[20:70] if r[1] == 1 and r[0] is not None}
    own = docs.where(F.col("id").between(20, 69) & (F.col("side") == 1))
    assert {r.id: r.ids for r in token_ids(own, "id", "tokens", vocab, broadcast_words=0).collect()} == want
