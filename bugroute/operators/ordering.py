"""Positions, positional split and batches (AGG4-6).

A global row position needs a total order (add a tie-breaker column to a key
that repeats).  One method serves all sizes and key types: a range-partitioned
sort on the *full* key, tagged with ``monotonically_increasing_id`` and written
once to the shared checkpoint folder, which fixes partitions and ids; the
per-partition counts give the offsets.  Nulls sort first.

The positional split needs no position for every row of the table: only the
key columns are sorted, the key at rank ``(num * n) div den`` is looked up
there, and the split becomes a plain filter ``key < cutoff``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ID_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def rank_by(df: DataFrame, order, name: str = "idx") -> DataFrame:
    """0-based position (long) of each row under a total ``order`` (list of
    Columns), computed without a single-partition window.

    The range-partitioned sort is distributed; the sorted rows are tagged with
    ``monotonically_increasing_id`` and checkpointed to the shared checkpoint
    folder, which fixes partitions and ids (safe against task retries and
    executor loss).  Per-partition counts (one row per partition) give the
    offsets, joined back by broadcast (bounded by the partition count).
    """
    from bugroute.session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tagged = df.orderBy(*order).withColumn("__mid", F.monotonically_increasing_id())
    tagged = tagged.checkpoint(eager=True)
    pid = F.shiftright(F.col("__mid"), _ID_BITS)
    counts = sorted((r["__pid"], r["n"]) for r in
                    tagged.groupBy(pid.alias("__pid")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, c in counts:
        offsets.append((int(p), total))
        total += c
    table = spark.createDataFrame(offsets or [(0, 0)], "__pid long, __offset long")
    local = F.col("__mid").bitwiseAND(F.lit((1 << _ID_BITS) - 1))
    return (tagged.withColumn("__pid", pid)
            .join(F.broadcast(table), "__pid")
            .withColumn(name, F.col("__offset") + local)
            .drop("__pid", "__offset", "__mid"))


def with_position(df: DataFrame, key: str | Sequence[str], name: str = "idx") -> DataFrame:
    """Add the 0-based global position of each row in ascending key order."""
    return rank_by(df, [F.col(k).asc_nulls_first() for k in _keys(key)], name)


def positional_cutoff(df: DataFrame, key: str | Sequence[str], num: int, den: int):
    """(n, t, cutoff key tuple or None) where t = (num * n) div den.

    ``cutoff`` is the key of the row at position t (the first test row).
    """
    keys = _keys(key)
    ranked = with_position(df.select(*keys), keys, "__pos")
    n = (ranked.agg(F.max("__pos")).first()[0] or 0) + 1 if not ranked.isEmpty() else 0
    t = (num * n) // den
    if t >= n:
        return n, t, None
    return n, t, tuple(ranked.where(F.col("__pos") == t).select(*keys).first())


def split_positional(df: DataFrame, key: str | Sequence[str], num: int = 9, den: int = 10,
                     out: str = "is_train") -> DataFrame:
    """Mark the first ``(num * n) div den`` rows in key order as train (AGG4).

    The result is a filterable flag; ``train``/``test`` are then plain filters
    that Catalyst can push into the scan.
    """
    keys = _keys(key)
    _, _, cutoff = positional_cutoff(df, keys, num, den)
    if cutoff is None:
        return df.withColumn(out, F.lit(True))
    # field by field, nulls first: earlier fields equal and this one smaller
    less, same = F.lit(False), F.lit(True)
    for k, v in zip(keys, cutoff):
        c, value = F.col(k), F.lit(v).cast(df.schema[k].dataType)
        smaller = F.lit(False) if v is None else c.isNull() | F.coalesce(c < value, F.lit(False))
        less, same = less | (same & smaller), same & c.eqNullSafe(value)
    return df.withColumn(out, less)


def train_test(df: DataFrame, key: str | Sequence[str], num: int = 9, den: int = 10):
    flagged = split_positional(df, key, num, den, out="__train")
    return (flagged.where("__train").drop("__train"),
            flagged.where(~F.col("__train")).drop("__train"))


def split_hash(df: DataFrame, key: str, train_percent: int = 90, seed: int = 42,
               out: str = "is_train") -> DataFrame:
    """Stable pseudo-random split by key hash: no pass over the data needed."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return df.withColumn(out, bucket < train_percent)


def batches(df: DataFrame, key: str | Sequence[str], size: int, out: str = "batch_id") -> DataFrame:
    """Fixed-size batches in key order: batch_id = position div size (AGG5)."""
    if size <= 0:
        raise ValueError("batch size must be positive")
    pos = with_position(df, key, "__pos")
    return pos.withColumn(out, F.floor(F.col("__pos") / size).cast("long")).drop("__pos")


def batch_sizes(df: DataFrame, batch_col: str = "batch_id") -> DataFrame:
    """(batch_id, n_rows) per batch."""
    return df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_rows"))


def with_progress(df: DataFrame, name: str = "progress"):
    """Row-count progress metric (AGG6) via ``observe`` instead of per-row logs."""
    from pyspark.sql import Observation

    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
