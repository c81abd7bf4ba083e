"""Driver parquet tables and the stand-in bug table built from them.

The reference's bug CSV is not public, so the bug table is derived from
``documents`` by one projection (no join, no shuffle): every column is a pure
function of one document row, so the scan stays a single stage and
``text``/``lang``/``source`` are the only parquet columns read when the others
are pruned by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugroute.schema import SEVERITY_STATES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give a scan at least ``defaultParallelism`` partitions.

    A file written as one row group is read by one task, which would run all
    per-row work (regex splits, tokenising) single-threaded.  Only then is the
    scan hash-repartitioned on its key column (deterministic, no pre-sort).  A
    plan for small files only: it runs where the session asks for it
    (``spark.bugroute.spreadScans``, set by ``local_session``).
    """
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, F.col(key or df.columns[0]))


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if spark.conf.get("spark.bugroute.spreadScans", "false") == "true" else df


# The stand-in status rotation, class per language, offsets.
_STATUS_ROTATION = ["CLOSED", "RESOLVED", "VERIFIED"]
_CLASS_BY_LANG = {"en": 10, "fr": 20, "de": 30}
_OTHER_CLASS = 40


def _case(key, values):
    expr = None
    for i, v in enumerate(values[:-1]):
        expr = (F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v)))
    return expr.otherwise(F.lit(values[-1]))


def bugs_from_documents(documents: DataFrame) -> DataFrame:
    """The 14 bug columns (+ ``class_raw`` with bad cells) from ``documents``."""
    d = F.col("doc_id")
    cls = F.lit(_OTHER_CLASS)
    for lang, value in reversed(list(_CLASS_BY_LANG.items())):
        cls = F.when(F.col("lang") == lang, F.lit(value)).otherwise(cls)
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), d)
    return documents.select(
        d.cast("int").alias("row_id"),
        (d % 37).cast("int").alias("assigned_to"),
        (F.lit(100000) + d).cast("int").alias("bug_id"),
        _case(d % 7, SEVERITY_STATES).alias("bug_severity"),
        _case(d % 3, _STATUS_ROTATION).alias("bug_status"),
        F.substring("source", 4, 1 << 20).cast("int").alias("component_id"),
        (F.lit("2016-01-01 00:00:00").cast("timestamp_ntz") + minutes).alias("creation_ts"),
        (F.lit("2016-01-02 00:00:00").cast("timestamp_ntz") + minutes).alias("delta_ts"),
        (d % 5).cast("int").alias("product_id"),
        F.lit("FIXED").alias("resolution"),
        F.substring("text", 1, 60).alias("short_desc"),
        F.col("text").alias("original_text"),
        F.when(d % 50 == 7, F.lit("")).otherwise(F.col("text")).alias("text"),
        cls.alias("class"),
        F.when(d % 97 == 0, F.lit("trivial")).otherwise((d % 41).cast("string")).alias("class_raw"),
    )


def bugs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bugs_from_documents(load_table(spark, sf_dir, "documents"))


def preds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, prediction) where class 40 is never predicted (EV fixtures)."""
    b = bugs_table(spark, sf_dir)
    pred = F.when((F.col("class") == 40) | (F.col("row_id") % 5 == 0), F.lit(10)).otherwise(F.col("class"))
    return b.select(F.col("row_id"), F.col("class").alias("label"), pred.alias("prediction"))


def label_preds_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` read as (label = quality, prediction = toxic)."""
    return load_table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
