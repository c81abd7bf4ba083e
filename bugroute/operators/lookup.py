"""Rows of a large table, brought to the texts that name them.

A table that is too large to broadcast would take the texts' tokens through a shuffle,
and what is found for each of them through another.  Here texts are dealt to slots by a
hash of their key, a partition each, and cut into tokens there; a slot asks once for
every distinct token, and its partition gets the rows that it asked for.  Nothing but
the texts, the slots' distinct tokens and their rows is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOT = "__slot"
MOST_SLOTS = 1 << 16


def slots_for(df: DataFrame, size: int, per_slot: int) -> int:
    return min(max(math.ceil(size / per_slot), df.sparkSession.sparkContext.defaultParallelism), MOST_SLOTS)


def slot_of(keys: list[str], slots: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"), F.lit(0))   # never null, and known not to be


def deal(df: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """``df`` with the slot of its ``keys``, a partition each."""
    return df.withColumn(SLOT, slot_of(keys, slots)).repartitionById(slots, F.col(SLOT))


def with_rows(flat: DataFrame, keys: list[str], on: str, table: DataFrame, slots: int, how: str = "inner") -> DataFrame:
    """``flat``, made from dealt rows in their partitions, joined with ``table`` on ``on``."""
    # the keys are asked for as well, so that both sides read the same shuffled rows
    asked = flat.where(F.col(on).isNotNull()).groupBy(SLOT, on).agg(F.min(F.xxhash64(*keys)).alias("__any"))
    found = asked.where("__any is not null").select(SLOT, on).join(table, on).repartitionById(slots, F.col(SLOT))
    return flat.join(found.hint("shuffle_hash"), [SLOT, on], how)
