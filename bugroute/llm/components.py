"""Connected components of an edge table (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.llm.common import materialize


def _star(edges: DataFrame) -> DataFrame:
    """Each node's neighbours are tied to the least of them and itself.  The
    least neighbour is a partial aggregate joined back, so a node with very many
    neighbours is split like any skewed join key."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return edges.join(least, "u")


def _is_stars(edges: DataFrame) -> bool:
    """Does every node have one edge to a smaller node, or only edges from larger ones?"""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
    per = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.count(F.lit(1)).alias("all"))
    return per.agg(F.count_if(F.expr("up > 1 or (up = 1 and all > 1)"))).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``edges``
    (two columns of one type).

    Large and small stars in turn (union-find over a table): every round links
    nodes to the least node known to them, until each component is one star.
    Nulls and loops are left out; repeated edges don't matter; without edges
    there are no rows.
    """
    a, b = edges.columns
    now = materialize(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges")
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u != v").distinct()
        small = _star(large)
        now = materialize(
            small.select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(small.select("u", F.col("low").alias("v"))).where("u != v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after the labels tied by ``links`` (label pairs)
    have become one."""
    more = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(more, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
