"""Sparse feature rows from wide one-hots, end to end."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from bugroute.operators import categories as cat
from bugroute.operators import train as tr
from bugroute.operators import vectors as vec
from bugroute.plans import routing
from bugroute.sources.tables import bugs_table
from tests.conftest import SF_SMALL


def test_places_and_one_hots(spark):
    rows = [(1, "7", 0), (2, "3", 1), (3, None, 0), (4, "x", 1), (5, "7", 0), (6, "-2", 1)]
    df = spark.createDataFrame(rows, "row_id long, c string, label int").repartition(3)
    placed, widths = cat.category_places(df, ["c"])
    assert widths == {"c": 3} and {r.row_id: r.c for r in placed.collect()} == {1: 2, 2: 1, 3: None, 4: None, 5: 2, 6: 0}
    hot = cat.one_hot_vectors(placed, widths).collect()
    assert {r.row_id: r.c.toArray().tolist() for r in hot}[1] == [0, 0, 1] and all(r.c.size == 3 for r in hot)
    assert all(r.c.numNonzeros() == 0 for r in hot if r.row_id in (3, 4))
    none, widths = cat.category_places(df.where("row_id = 3"), ["c"])
    assert widths == {"c": 0} and none.first().c is None


@pytest.mark.parametrize("architecture", ["rnn", "cnn"])
def test_sparse_rows_equal_dense_ones(spark, architecture):
    bugs = bugs_table(spark, SF_SMALL)
    wv, dims = routing.derived_word_vectors(spark, SF_SMALL)
    dense = routing.text_features(bugs, wv, dims, architecture)
    sparse = routing.text_features(bugs, wv, dims, architecture, sparse=True)
    assert sparse.width == dense.width and sparse.classes == dense.classes
    want = {r.row_id: (r.label, r.features) for r in dense.features.collect()}
    got = {r.row_id: (r.label, r.f) for r in sparse.features.select("row_id", "label", vector_to_array("features").alias("f")).collect()}
    assert got.keys() == want.keys()
    for k, (label, x) in want.items():
        assert got[k][0] == label and np.allclose(got[k][1], x, atol=1e-12)


def test_light_job_sparse_scores_like_dense(spark):
    bugs = routing.light_bugs(spark, SF_SMALL)
    dense, sparse = (routing.light_features(bugs, sparse=s) for s in (False, True))
    both = [tr.score(tr.train_softmax(p.features, max_iter=20), p.features, keep=("row_id",)) for p in (dense, sparse)]
    a, b = ({r.row_id: r.probability for r in x.collect()} for x in both)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-6) for k in a)


def test_two_hundred_thousand_components(spark):
    """Both jobs' one-hots at 200,000 components: rows stay sparse, training ends."""
    n = 200_000
    bugs = spark.range(n + 50_000).select(
        F.col("id").alias("row_id"), F.lit("normal").alias("bug_severity"), (F.col("id") % n).cast("string").alias("component_id"),
        (F.col("id") % 3).cast("string").alias("product_id"), (F.col("id") % 2 * 10).cast("string").alias("class"),
        F.lit("some words").alias("text"))
    plan = routing.light_features(bugs, drop_class_from=25, sparse=True)
    assert len(plan.components) == n and plan.width == n + 3 + 7
    first = plan.features.first().features
    assert first.size == plan.width and first.numNonzeros() == 3
    model = tr.train_softmax(plan.features, max_iter=3)
    scored = tr.score(model, plan.features)
    assert scored.count() == n + 50_000
    assert scored.where("label = prediction").count() > 0.9 * (n + 50_000)
    groups = spark.createDataFrame([(0, [[0.5, 0.0], [0.0, 2.0]])], "row_id long, vectors array<array<double>>")
    encoded, comps, prods, _ = routing.encode_columns(bugs.where("row_id < 4 or row_id = 199999").unionByName(bugs.limit(0)), key="row_id", sparse=True)
    rows = vec.assemble_sparse(encoded, "row_id", groups, ["bug_severity", "component_id", "product_id"], 2, 2)
    x = rows.where("row_id = 0").first().features
    assert x.size == 2 * (2 + 7 + len(comps) + len(prods)) and x[0] == 0.5 and x[x.size // 2 + 1] == 2.0
