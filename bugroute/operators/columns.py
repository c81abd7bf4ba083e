"""Projections, filters and predicates (PRJ1-3, PRJ6, FLT1-3).

All of these are narrow transformations: Catalyst pushes the filters and the
column pruning down to the scan, and no shuffle is introduced.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
    "in": lambda c, v: c.isin(list(v)),
    "not in": lambda c, v: ~c.isin(list(v)),
}


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep only ``columns``, in the given order (PRJ1, PRJ2)."""
    return df.select(*[F.col(c) for c in columns])


def int_condition(column: str, op: str, value) -> "F.Column":
    """Condition on the integer value of a column (unparsable cells -> null)."""
    if op not in _OPS:
        raise ValueError(f"unknown operator {op!r}; use one of {sorted(_OPS)}")
    return _OPS[op](F.col(column).try_cast("int"), value)


def drop_where(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Remove the rows that satisfy ``column op value`` (FLT1).

    Rows whose cell is not an integer (null after ``try_cast``) are removed
    too, since the condition cannot be decided for them.
    """
    cond = int_condition(column, op, value)
    return df.filter(F.coalesce(~cond, F.lit(False)))


def count_where(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """What ``drop_where`` does to a table, as one row: (n_kept, n_removed,
    n_bad), n_bad of the removed rows for a cell that is not an integer."""
    cond = int_condition(column, op, value)
    return df.agg(F.count_if(~cond).alias("n_kept"), F.count_if(cond | cond.isNull()).alias("n_removed"),
                  F.count_if(F.col(column).try_cast("int").isNull()).alias("n_bad"))


KEPT = "kept"


def divide_rows(df: DataFrame, rules: Mapping[str, "F.Column"], path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(kept rows, rejected rows with the column ``verdict``, {verdict: rows}) in one
    pass over ``df`` (FLT1, SRC1).

    ``rules``: reason -> condition that rejects a row; the first one that holds
    is its verdict, and a condition that is null (it can't be decided) holds.  The
    rows are written once, by verdict, and counted on the way; a reader of either
    part reads its own files only.
    """
    from pyspark.sql import Observation

    verdict = F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in rules.items()), F.lit(KEPT))
    marked = df.withColumn("verdict", verdict)
    names = [KEPT, *rules]
    seen = Observation()
    marked.observe(seen, *(F.count_if(F.col("verdict") == n).alias(f"n{i}") for i, n in enumerate(names))).write.partitionBy(
        "verdict").parquet(path)
    rows = df.sparkSession.read.schema(marked.schema).parquet(path)
    counts = {n: seen.get[f"n{i}"] for i, n in enumerate(names)}
    return rows.where(F.col("verdict") == KEPT).drop("verdict"), rows.where(F.col("verdict") != KEPT), counts


def drop_empty_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop rows with empty or missing text (FLT2); CSV empties arrive as null."""
    return df.filter(F.length(F.coalesce(F.col(column), F.lit(""))) > 0)


def safe_int(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Keep rows whose ``column`` parses as an int; add/replace it as int (FLT3)."""
    parsed = F.col(column).try_cast("int")
    return df.withColumn(out or column, parsed).filter(F.col(out or column).isNotNull())


def to_category(df: DataFrame, column: str, mapping: Mapping[int, str] | DataFrame,
                out: str | None = None, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Int -> category name (PRJ3).

    ``mapping`` is a dict or a (key, name) DataFrame; it is joined, by broadcast
    if its measured size allows.  Unknown keys give null.
    """
    out = out or column
    if not isinstance(mapping, DataFrame):
        rows = [(int(k), str(v)) for k, v in sorted(mapping.items())]
        mapping = df.sparkSession.createDataFrame(rows, "key int, name string")
    key, name = mapping.columns[:2]
    m = mapping.select(F.col(key).alias("__key"), F.col(name).alias("__name"))
    size = m.agg(F.sum(F.octet_length("__name") + 16)).first()[0] or 0
    if size <= max_broadcast_bytes:
        m = F.broadcast(m)
    joined = df.join(m, F.col(column) == F.col("__key"), "left")
    return joined.withColumn(out, F.col("__name")).drop("__key", "__name")


def identity_names(values: Sequence[int]) -> dict[int, str]:
    """Category names of component/product ids: the number as text."""
    return {int(v): str(int(v)) for v in values}


def describe_schema(df: DataFrame, states: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Schema report: (idx, name, type, states) one row per column (PRJ6).

    Built from the schema alone (metadata): no data is read.
    """
    states = states or {}
    rows = [
        (i, f.name, f.dataType.simpleString(), list(states.get(f.name, [])) or None)
        for i, f in enumerate(df.schema.fields)
    ]
    schema = T.StructType([
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("states", T.ArrayType(T.StringType()), True),
    ])
    return df.sparkSession.createDataFrame(rows, schema)
