"""Loss per example and in total (LS1-LS14): one function, 14 names.

Per-example scores are a narrow projection; totals are one global aggregate
(partial sums per task, one final merge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from bugroute.functions.losses import canonical, loss_score


def _masked(df: DataFrame, name: str, labels: str, pre_output: str, activation: str, mask: str | None):
    """The score of a loss under a mask: an array masks single outputs, a number
    the whole example; the score under a null mask is null."""
    if mask is not None and isinstance(df.schema[mask].dataType, ArrayType):
        return loss_score(canonical(name), labels, pre_output, activation, mask)
    score = loss_score(canonical(name), labels, pre_output, activation)
    return score if mask is None else score * F.col(mask).cast("double")


def loss(df: DataFrame, name: str, labels: str = "labels", pre_output: str = "pre_output",
         activation: str = "identity", mask: str | None = None, out: str = "score") -> DataFrame:
    """Add the per-example score of loss ``name``.  ``mask`` names a column with a
    factor for the example, or an array with one for each output."""
    return df.withColumn(out, _masked(df, name, labels, pre_output, activation, mask))


def loss_total(df: DataFrame, name: str, labels: str = "labels", pre_output: str = "pre_output",
               activation: str = "identity", mask: str | None = None,
               average: bool = True) -> DataFrame:
    """One row (loss, total, average): the sum over examples and, when
    ``average``, that sum divided by the number of examples."""
    scored = loss(df, name, labels, pre_output, activation, mask, "__s")
    agg = scored.agg(F.sum("__s").alias("total"), F.count(F.lit(1)).alias("n"))
    avg = F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("total") / F.col("n"))
    return agg.select(F.lit(canonical(name)).alias("loss"), F.col("total"),
                      (avg if average else F.col("total")).alias("average"))


def loss_totals(df: DataFrame, names_activations, labels: str = "labels",
                pre_output: str = "pre_output", mask: str | None = None) -> DataFrame:
    """(loss, total, average) for several losses in ONE pass over ``df``:
    one projection with every score, one aggregate, then a stack."""
    scores = []
    for i, (name, act) in enumerate(names_activations):
        scores.append(_masked(df, name, labels, pre_output, act, mask).alias(f"__s{i}"))
    agg = df.select(*scores).agg(F.count(F.lit(1)).alias("n"),
                                 *[F.sum(f"__s{i}").alias(f"__t{i}") for i in range(len(scores))])
    stacked = F.stack(F.lit(len(scores)), *[x for i, (name, _) in enumerate(names_activations)
                                            for x in (F.lit(canonical(name)), F.col(f"__t{i}"))])
    out = agg.select("n", stacked.alias("loss", "total"))
    avg = F.when(F.col("n") == 0, F.lit(float("nan"))).otherwise(F.col("total") / F.col("n"))
    return out.select("loss", "total", avg.alias("average"))
