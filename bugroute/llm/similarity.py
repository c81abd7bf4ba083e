"""Exact set-similarity join of a table of sets (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import materialize


def prefix_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a < b, of ``nodes`` (node, label, s) with different labels
    whose sets ``s`` may share ``percent`` of their union; none that does is left
    out.

    Each set is ordered by how rare its members are in the table.  Sets that are
    so similar have one of their first n - ceil(n t) + 1 members in common (prefix
    filter), sizes within t of each other (length filter), and from the first
    common member on still hold enough on both sides (positional filter).  A
    member that only one set has joins nothing.
    """
    flat = nodes.select("node", "label", F.size("s").alias("n"), F.explode("s").alias("x"))
    count = flat.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ordered = flat.join(count, "x", "left").groupBy("node", "label", "n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(1)).alias("c"), "x"))).alias("s"))
    prefix = ordered.select("node", "label", "n", F.posexplode(
        F.slice("s", 1, F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)).alias("pos", "e"))
    prefix = materialize(prefix.where("e.c > 1").select("node", "label", "n", "pos", F.col("e.x").alias("x")), "prefixes")
    a, b = prefix.toDF("a", "la", "na", "pa", "x"), prefix.toDF("b", "lb", "nb", "pb", "x")
    near = ((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
            & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            & ((100 + percent) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
               >= percent * (F.col("na") + F.col("nb"))))
    return a.alias("l").join(b.alias("r"), (F.col("l.x") == F.col("r.x")) & near).select("a", "b").distinct()
