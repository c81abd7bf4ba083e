import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bugroute.operators import evaluate as ev
from bugroute.operators import ordering as order
from bugroute.operators import param_avg as pavg
from bugroute.operators import train as tr
from bugroute.plans import routing
from bugroute.sources.tables import bugs_table
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def plan(spark):
    wv, dims = routing.derived_word_vectors(spark, SF_CHECK)
    return routing.text_features(bugs_table(spark, SF_CHECK), wv, dims, "rnn")


def majority_accuracy(df):
    counts = [r["count"] for r in df.groupBy("label").count().collect()]
    return max(counts) / sum(counts)


def test_feature_width(plan):
    row = plan.features.first()
    assert len(row.features) == plan.width == 64 + 20 + 5 + 7


def test_softmax_beats_majority(spark, plan):
    train, test = order.train_test(plan.features, "row_id", 9, 10)
    model = tr.train_softmax(train, max_iter=50)
    m = ev.metrics(tr.score(model, test)).first()
    assert m.accuracy > majority_accuracy(test) + 0.1
    hist = tr.objective_history(model)
    assert hist[-1] < hist[0]


def test_param_avg_loss_falls_and_resumes(spark, plan, tmp_out):
    train, _ = order.train_test(plan.features, "row_id", 9, 10)
    spec = pavg.NetSpec(n_in=plan.width, n_out=len(plan.classes), lr=0.5)
    path = tmp_out("pavg")
    m = pavg.train_param_avg(train, spec, epochs=4, save_path=path, avg_every=2)
    scores = [h[2] for h in m.history]
    assert scores[-1] < scores[0]
    loaded, epoch = pavg.load_model(spark, path)
    assert epoch == 4 and loaded.spec == spec and np.allclose(loaded.params, m.params)
    again = pavg.train_param_avg(train, spec, epochs=1, start=loaded, start_epoch=5, avg_every=2)
    assert len(again.history) >= 1


def test_param_avg_deterministic(spark, plan):
    train, _ = order.train_test(plan.features, "row_id", 9, 10)
    spec = pavg.NetSpec(n_in=plan.width, n_out=len(plan.classes), lr=0.01, updater="rmsprop", clip=1.0)
    a = pavg.train_param_avg(train, spec, epochs=1)
    b = pavg.train_param_avg(train.repartition(3), spec, epochs=1)
    assert np.allclose(a.params, b.params)


@pytest.mark.parametrize("workers,rows", [(4, 882), (8, 1001), (200, 999)])
def test_param_avg_trains_on_every_row(spark, workers, rows):
    df = spark.range(rows).select(
        F.col("id").alias("row_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("features"),
        (F.col("id") % 3).cast("int").alias("label")).repartition(5)
    spec = pavg.NetSpec(n_in=2, n_out=3, updater="nesterov")
    trained = pavg.train_param_avg(df, spec, epochs=2, workers=workers, max_rounds=3)
    assert [tuple(r) for r in pavg.rows_trained(spark, trained).orderBy("epoch").collect()] == [(1, rows), (2, rows)]


def test_averaging_interval_is_constant(spark):
    """More rows give more rounds, not longer ones."""
    spec = pavg.NetSpec(n_in=2, n_out=3)
    for rows, rounds in ((100, 1), (1_000, 10), (4_000, 40)):
        df = spark.range(rows).select(F.col("id").alias("row_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("features"),
                                      (F.col("id") % 3).cast("int").alias("label"))
        trained = pavg.train_param_avg(df, spec, workers=2, batch=10, avg_every=5)
        assert len(trained.history) == rounds and max(h[3] for h in trained.history) < 2 * 2 * 10 * 5


def test_model_in_many_chunks(spark, monkeypatch):
    """A model of several chunks trains and predicts like one of a single chunk."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    rows = [(i, v.tolist(), int(v[:3].argmax())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int").repartition(3)
    spec = pavg.NetSpec(n_in=6, n_out=3, lr=0.3, updater="nesterov", momentum=0.5)
    start = pavg.train_param_avg(df, spec, epochs=2, workers=2)
    flat = np.concatenate([start.params, start.state])
    assert len(flat) == 2 * spec.n_params
    pieces = spark.createDataFrame([(k, bytearray(flat[5 * k:5 * k + 5].tobytes())) for k in range(math.ceil(len(flat) / 5))],
                                   "chunk int, values binary")
    chunked = pavg.TrainedNet(spec, pieces)
    assert np.array_equal(chunked.params, start.params)
    ways = [sorted(map(tuple, pavg.predict(m, df, keep=("row_id",), broadcast_mb=mb).collect())) for m, mb in
            ((start, 64), (chunked, 64), (chunked, 0))]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == 300
    one, other = (pavg.train_param_avg(df, spec, workers=2, start=m, start_epoch=3) for m in (start, chunked))
    assert np.array_equal(one.params, other.params)


def test_softmax_gradient_numerically():
    rng = np.random.default_rng(0)
    spec = pavg.NetSpec(n_in=5, n_out=3)
    x, y, flat = rng.normal(size=(6, 5)), rng.integers(0, 3, size=6), pavg.initial(spec)
    _, g = pavg.loss_and_gradient(spec, flat, x, y)
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        up, down = (pavg.loss_and_gradient(spec, flat + k * e, x, y)[0] for k in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_paragraph_vectors(spark):
    """Vectors of one language are nearer to each other than to the others, and
    the same under any partitioning."""
    from bugroute.operators import paragraph as pv
    from bugroute.operators import text as txt
    from bugroute.sources.tables import load_table
    from tests.conftest import SF_SMALL

    docs = txt.tokens(load_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang"), "text")
    vecs, model = pv.train_paragraph_vectors(docs.select("doc_id", "tokens"), "doc_id", "tokens", dims=16, epochs=3)
    assert model.weights.count() == model.vocab.count()
    rows = vecs.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    unit = np.stack([np.asarray(r.vector) / (np.linalg.norm(r.vector) + 1e-12) for r in rows])
    lang = np.array([r.lang for r in rows])
    near, same = unit @ unit.T, lang[:, None] == lang[None]
    np.fill_diagonal(same, False)
    other = lang[:, None] != lang[None]
    assert near[same].mean() > near[other].mean() + 0.05
    as_dict = lambda t: {r.doc_id: list(r.vector) for r in t.collect()}
    one = as_dict(pv.infer_vectors(model, docs, "doc_id", "tokens", epochs=2))
    assert len(one) == len(rows)
    for other in (docs.repartition(5), docs.repartition(7, "doc_id")):
        again, _ = pv.train_paragraph_vectors(other.select("doc_id", "tokens"), "doc_id", "tokens", dims=16, epochs=3)
        assert as_dict(vecs) == as_dict(again)
        assert one == as_dict(pv.infer_vectors(model, other, "doc_id", "tokens", epochs=2))


def test_inference_needs_only_the_document(spark):
    """A document's inferred vector does not depend on the others."""
    from bugroute.operators import paragraph as pv
    from tests.conftest import SF_SMALL

    docs = token_rows(spark, SF_SMALL)
    _, model = pv.train_paragraph_vectors(docs, "doc_id", "tokens", dims=8, epochs=2)
    every = {r.doc_id: list(r.vector) for r in pv.infer_vectors(model, docs, "doc_id", "tokens", epochs=2).collect()}
    few = pv.infer_vectors(model, docs.where("doc_id % 10 = 3"), "doc_id", "tokens", epochs=2).collect()
    assert few and all(list(r.vector) == every[r.doc_id] for r in few)


def token_rows(spark, sf):
    from bugroute.operators import text as txt
    from bugroute.sources.tables import load_table

    return txt.tokens(load_table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")


def test_token_ids_stay_with_their_document(spark):
    from bugroute.operators.embedding import token_ids
    from bugroute.operators.vectors import build_vocab

    rows = [(i, [f"w{(i * k) % 17}" for k in range(i % 9)]) for i in range(60)] + [(None, ["w1", None, "odd"]), (77, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").repartition(6)
    vocab = build_vocab(df, min_count=2)
    place = {r.word: r.idx for r in vocab.collect()}
    want = {i: [place[w] for w in t or [] if w in place] for i, t in rows}
    for other in (df, df.repartition(5), df.repartition(9, "id"), df.coalesce(1)):
        assert {r.id: r.ids for r in token_ids(other, "id", "tokens", vocab).collect()} == want


def test_noise_follows_counts(spark):
    """The stretches cover the line without gap or overlap, and draws follow them."""
    import math

    from bugroute.operators import embedding as emb

    counts = [40_000, 900, 900, 81, 16, 16, 1, 1, 1]
    vocab = spark.createDataFrame([(f"w{i}", c, i) for i, c in enumerate(counts)], "word string, count long, idx long")
    lines, total, width = emb.noise_lines(vocab)
    got = sorted((r.idx, r.low, r.high) for r in lines.select("idx", "low", "high").distinct().collect())
    mass = [max(1, math.floor(c ** 0.75 * emb.MASS_UNIT)) for c in counts]
    assert got == [(i, sum(mass[:i]), sum(mass[:i + 1])) for i in range(len(counts))] and total == sum(mass)
    draws = {(r.slot, r.idx): r.n for r in emb.draw_noise(spark, lines, total, width, 3, 1).collect()}
    for slot in range(3):
        assert sum(n for (s, _), n in draws.items() if s == slot) == emb.POOL
    assert abs(sum(n for (_, i), n in draws.items() if i == 0) / (3 * emb.POOL) - mass[0] / total) < 0.02


def test_word_vectors_by_company(spark):
    """Words that occur together are nearer; the same under any partitioning."""
    from bugroute.operators.embedding import train_word_vectors

    rng = np.random.default_rng(4)
    rows = [(i, [f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 40, 60)]) for i in range(600)] + [(-1, []), (-2, ["alone"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = {r.word: r.vector for r in train_word_vectors(df.repartition(3), "id", dims=16, epochs=6).collect()}
    assert got == {r.word: r.vector for r in train_word_vectors(df.repartition(8, "id"), "id", dims=16, epochs=6).collect()}
    assert len(got) == 81
    names = sorted(w for w in got if w != "alone")
    unit = np.stack([np.asarray(got[w]) / np.linalg.norm(got[w]) for w in names])
    same = np.array([[x[0] == y[0] for y in names] for x in names])
    near = unit @ unit.T
    assert near[same & ~np.eye(len(names), dtype=bool)].mean() > near[~same].mean() + 0.3


def test_light_router_beats_majority(spark):
    plan = routing.light_features(routing.light_bugs(spark, SF_CHECK))
    _, test = order.train_test(plan.features, "row_id", 7, 10)
    assert routing.route_light(spark, SF_CHECK).first().accuracy > majority_accuracy(test) + 0.05


def test_two_class_model_after_an_observation(spark):
    """Scoring a two-class model must not ship the session (an observed session
    cannot be serialised)."""
    rows, seen = order.with_progress(spark.range(200))
    assert rows.count() == 200 and seen.get["rows"] == 200
    df = spark.range(200).select((F.col("id") % 2).cast("int").alias("label"),
                                 F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("features"))
    model = tr.train_softmax(df, max_iter=10)
    assert tr.score(model, df).where("label = prediction").count() == 200
    assert tr.objective_history(model)[-1] < tr.objective_history(model)[0]


def test_rounds_of_an_epoch_in_one_shuffle(spark, monkeypatch):
    """A round is one job, and the model, losses and rows are those of rounds that
    write tables; slots without rows don't vote."""
    sc = spark.sparkContext
    spec = pavg.NetSpec(n_in=2, n_out=3, updater="nesterov", momentum=0.5, l2=1e-3)

    def trained(rows, mb, **kwargs):
        df = spark.range(rows).select(F.col("id").alias("row_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("features"),
                                      (F.col("id") % 3).cast("int").alias("label")).repartition(3)
        monkeypatch.setattr(pavg, "GATHER_MB", mb)
        group = f"rounds-{rows}-{mb}-{len(kwargs)}"
        sc.setJobGroup(group, group)
        net = pavg.train_param_avg(df, spec, **{"workers": 3, "batch": 4, "avg_every": 2} | kwargs)
        params = net.params
        jobs = len(sc.statusTracker().getJobIdsForGroup(group))
        sc.setLocalProperty("spark.jobGroup.id", None)
        return net, params, jobs

    few, many = trained(100, 4), trained(400, 4)
    assert len(few[0].history) == 5 and len(many[0].history) == 17
    assert many[2] - few[2] == 12   # one job for each round more
    for rows, kwargs in ((50, {}), (5, {"workers": 20, "epochs": 2})):
        one, other = trained(rows, 4, **kwargs), trained(rows, -1, **kwargs)
        assert np.array_equal(one[1], other[1])
        assert [(e, r, n) for e, r, _, n in one[0].history] == [(e, r, n) for e, r, _, n in other[0].history]
        assert np.allclose([h[2] for h in one[0].history], [h[2] for h in other[0].history])


def test_slots_grow_before_their_number(spark):
    """A word's weights travel once a slot: slots are larger where tokens are many."""
    from bugroute.operators import embedding as emb

    def slots(texts, length):
        ids = spark.range(texts).select("id", F.array_repeat(F.lit(1), length).alias("ids"))
        return emb.dealt(ids, "id")[1]

    assert [slots(10, 10), slots(3, emb.SLOT_TOKENS), slots(72, emb.SLOT_TOKENS)] == [1, 3, emb.SLOTS]


def test_paragraph_tokens_are_dealt_to_all_tasks(spark):
    from bugroute.plans.catalog import CATALOG
    from tests.conftest import SF_SMALL

    plan = CATALOG["paragraph_tokens"][0](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {spark.conf.get('spark.sql.shuffle.partitions')}, true" in plan


def test_texts_are_dealt_by_their_length(spark, monkeypatch):
    """More text makes more tasks that count tokens, and not larger ones."""
    from bugroute.operators import vectors as vec

    words = spark.createDataFrame([("a", [1.0, 2.0])], "word string, vector array<double>")
    df = spark.range(300).select("id", F.repeat(F.lit("a b "), 100).alias("text"))
    monkeypatch.setattr(vec, "TEXT_BYTES", 4000)
    out = vec.group_vector_arrays(df, words, "id", 1, 2)
    assert "hashpartitioning(id" in out._jdf.queryExecution().executedPlan().toString()
    assert ", 30), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r.vectors[0]) for r in out.collect()} == {(1.0, 2.0)} and out.count() == 300
