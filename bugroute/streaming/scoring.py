"""Score bug reports as their CSV files arrive (file source -> foreachBatch).

Each micro-batch goes through the batch feature plan with the fitted states
(no re-fitting, so feature widths match the model) and the model's
``transform``; predictions are written partitioned by ``batch_id`` with
dynamic partition overwrite, so a replayed batch (after a failure) replaces
its own output instead of duplicating it.  Progress and exactly-once source
offsets live in the query checkpoint, which must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugroute.schema import BUG_SCHEMA


def score_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 model, word_vectors: DataFrame, dims: int, fitted: tuple,
                 architecture: str = "rnn", available_now: bool = True, max_files: int = 1000):
    """Start the scoring stream; returns the ``StreamingQuery``."""
    from bugroute.operators import train as tr
    from bugroute.plans.routing import text_features

    stream = (spark.readStream.schema(BUG_SCHEMA).option("header", False)
              .option("maxFilesPerTrigger", max_files).csv(source_dir))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        plan = text_features(batch, word_vectors, dims, architecture, checkpoint=False, fitted=fitted)
        scored = tr.score(model, plan.features, keep=["row_id"])
        (scored.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(sink_dir))

    writer = stream.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
