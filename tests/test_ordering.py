from pyspark.sql import functions as F
from pyspark.sql import Window

from bugroute.operators import ordering as order


def ids(spark, n, parts=3):
    return spark.range(n).select(F.col("id").cast("int").alias("row_id")).repartition(parts)


def test_split_sizes_fixture(spark):
    df = ids(spark, 19)
    train, test = order.train_test(df, "row_id", 9, 10)
    tr = sorted(r.row_id for r in train.collect())
    te = sorted(r.row_id for r in test.collect())
    assert tr == list(range(17)) and te == [17, 18]


def test_split_independent_of_partitioning(spark):
    for parts in (1, 4, 9):
        df = ids(spark, 1000, parts)
        flagged = order.split_positional(df, "row_id", 7, 10)
        assert flagged.where("is_train").count() == 700
        assert flagged.where("is_train").agg(F.max("row_id")).first()[0] == 699


def test_position_multi_bucket(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.col("id"))
    got = order.with_position(df, ["k", "id"], "idx")
    w = Window.orderBy("k", "id")
    want = df.withColumn("idx", F.row_number().over(w) - 1)
    assert sorted(map(tuple, got.select("k", "id", "idx").collect())) == \
        sorted(map(tuple, want.select("k", "id", "idx").collect()))


def test_positions_with_nulls_text_and_a_hot_first_key(spark):
    rows = [(None if k % 50 == 0 else f"s{k % 5}", k) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, id int").repartition(6)
    want = {i: p for p, (_, i) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    got = {r.id: r.idx for r in order.with_position(df, ["k", "id"]).collect()}
    assert got == want
    flagged = {r.id: r.is_train for r in order.split_positional(df, ["k", "id"], 7, 10).collect()}
    assert flagged == {i: p < 280 for i, p in want.items()}
    few = {r.id: r.is_train for r in order.split_positional(df, ["k", "id"], 1, 100).collect()}
    assert few == {i: p < 4 for i, p in want.items()}
    assert order.split_positional(df.where("false"), ["k", "id"]).count() == 0


def test_batches(spark):
    df = ids(spark, 103)
    sizes = sorted(tuple(r) for r in order.batch_sizes(order.batches(df, "row_id", 25)).collect())
    assert sizes == [(0, 25), (1, 25), (2, 25), (3, 25), (4, 3)]


def test_rank_by(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "word string, count long")
    got = {r.word: r.idx for r in order.rank_by(df, [F.col("count").desc(), F.col("word")]).collect()}
    assert got == {"c": 0, "a": 1, "b": 2, "d": 3}


def test_fit_categories_many_matches_single(spark):
    from tests.conftest import SF_SMALL
    from bugroute.operators import categories as cat
    from bugroute.sources.tables import bugs_table

    b = bugs_table(spark, SF_SMALL)
    many = cat.fit_categories_many(b, ["component_id", "product_id", "class", "class_raw"])
    for c in many:
        assert many[c] == cat.fit_categories(b, c)


def test_many_components(spark):
    """5,000 components through categories, index and one-hot features."""
    from bugroute.operators import categories as cat
    from bugroute.plans import routing

    rows = [(k, f"word{k % 3} text", "normal", k % 5000, k % 3, 10 * (k % 4)) for k in range(6000)]
    bugs = spark.createDataFrame(rows, "row_id int, text string, bug_severity string, component_id int, product_id int, class int")
    table = cat.category_table(bugs, "component_id")
    assert table.agg(F.count("*"), F.max("state_idx")).first()[:] == (5000, 4999)
    assert "SinglePartition" not in table._jdf.queryExecution().toString()
    wv = spark.createDataFrame([("word", [1.0, 2.0])], "word string, vector array<double>")
    plan = routing.text_features(bugs, wv, 2, checkpoint=False)
    assert plan.width == 2 + 5000 + 3 + 7
    row = plan.features.where("row_id = 4321").first()
    assert sum(row.features[2:]) == 3.0 and row.features[2 + 7 + 4321] == 1.0 and row.label == 1


def test_to_category_with_table(spark):
    from bugroute.operators import columns as colops

    df = spark.createDataFrame([(1,), (2,), (3,)], "c int")
    m = spark.createDataFrame([(1, "one"), (2, "two")], "k int, name string")
    got = sorted((r.c, r.name) for r in colops.to_category(df, "c", m, out="name").collect())
    assert got == [(1, "one"), (2, "two"), (3, None)]
