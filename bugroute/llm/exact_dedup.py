"""Exact dedup by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition gives one run: its digests in order, each with the
identifier to keep and its number of rows.  In round k the runs of ``fan_in``
neighbours meet and are merged; as a run gets wider it is also cut into more
digest shards, so that a merge task reads about one original run at every
level.  A text repeated n times is one row per run after the first level, so no
group of copies, however large, meets in one task.  The survivors then travel
back down the same tree: a node hands its answer to at most ``fan_in`` runs.

Digests are verified at every level: rows merge only if the SHA-256, the length
in bytes and an independent 64-bit hash of the normalised text all agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import ascii_lower, materialize

KEY = ["text_sha256", "n_bytes", "check"]


def _merge(level: DataFrame, fan_in: int, shards: int) -> DataFrame:
    """One round: runs of ``fan_in`` neighbours, shard by shard, become one."""
    return (
        level.select(F.floor(F.col("run") / fan_in).alias("run"),
                     F.pmod(F.col("check"), F.lit(shards)).alias("shard"), *KEY, "keep_id", "group_size")
        .repartition("run", "shard")
        .groupBy("run", "shard", *KEY)
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        .select("run", *KEY, "keep_id", "group_size")
        .sortWithinPartitions("run", "text_sha256"))


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest key, run) of every row: the only pass over the texts."""
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
        F.spark_partition_id().cast("long").alias("run"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest id stays.  A null text counts as empty.  A null id stays only in a
    group whose ids are all null; rows repeating the kept id are all marked
    kept.  An empty table gives no rows; other columns are never read.
    """
    rows = materialize(digest_runs(docs, id_col, text_col), "digest-runs")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = materialize(
        rows.groupBy("run", *KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .sortWithinPartitions("run", "text_sha256"), "digest-level")
    levels, width = [level], 1
    while width < runs:
        width *= fan_in
        level = materialize(_merge(level, fan_in, min(width, runs)), "digest-level")
        levels.append(level)
    answer = levels.pop()
    while levels:
        child = levels.pop().select("run", *KEY, F.floor(F.col("run") / fan_in).alias("parent"))
        answer = child.join(answer.withColumnRenamed("run", "parent"), ["parent", *KEY]).drop("parent")
    return rows.join(answer, ["run", *KEY]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
