from pyspark.sql import functions as F

from bugroute.operators import ordering as order
from bugroute.operators import train as tr
from bugroute.plans import routing
from bugroute.sinks.bugs_csv import write_bugs_csv
from bugroute.sources.tables import bugs_table
from bugroute.streaming import score_stream
from tests.conftest import SF_SMALL


def test_score_stream_matches_batch(spark, tmp_out):
    wv, dims = routing.derived_word_vectors(spark, SF_SMALL)
    bugs = bugs_table(spark, SF_SMALL)
    plan = routing.text_features(bugs, wv, dims, "rnn")
    train, _ = order.train_test(plan.features, "row_id", 9, 10)
    model = tr.train_softmax(train, max_iter=10)
    src_dir, sink, ckpt = tmp_out("stream-src"), tmp_out("stream-sink"), tmp_out("stream-ckpt")
    write_bugs_csv(bugs, src_dir)
    q = score_stream(spark, src_dir, sink, ckpt, model, wv, dims,
                     (plan.components, plan.products, plan.classes))
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink).select("row_id", "prediction")
    batch = tr.score(model, plan.features, keep=["row_id"]).select("row_id", "prediction")
    assert streamed.count() == batch.count() > 0
    diff = streamed.join(batch.withColumnRenamed("prediction", "p2"), "row_id").where(
        F.col("prediction") != F.col("p2")).count()
    assert diff == 0


def test_curve_stream_sees_each_epoch_once(spark, tmp_out):
    from bugroute.operators import param_avg as pavg
    from bugroute.streaming.curve import curve_stream

    df = spark.range(400).select(F.col("id").alias("row_id"), F.array((F.col("id") % 2).cast("double"), F.lit(1.0)).alias("features"),
                                 (F.col("id") % 2).cast("int").alias("label"))
    spec = pavg.NetSpec(n_in=2, n_out=2, lr=0.5)
    models, sink, ckpt = tmp_out("curve-models"), tmp_out("curve-sink"), tmp_out("curve-ckpt")
    last = pavg.train_param_avg(df, spec, epochs=2, save_path=models)

    def run():
        q = curve_stream(spark, models, sink, ckpt, {"all": df, "odd": df.where("label = 1")})
        q.awaitTermination(300)
        return {(r.epoch, r.split, r.metric): r.value for r in spark.read.parquet(sink).collect()}, [
            p.numInputRows for p in q.recentProgress if p.numInputRows]

    first, seen = run()
    assert {e for e, *_ in first} == {1, 2} and sum(seen) > 0
    assert first[1, "all", "n"] == 400 and first[2, "odd", "n[1]"] == 200 and (2, "odd", "n[0]") not in first
    again, seen = run()
    assert again == first and not seen
    pavg.train_param_avg(df, spec, epochs=1, start=last, start_epoch=3, save_path=models)
    more, _ = run()
    assert {e for e, *_ in more} == {1, 2, 3} and {k: v for k, v in more.items() if k[0] < 3} == first
    assert more[3, "all", "accuracy"] == 1.0
