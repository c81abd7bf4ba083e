"""Categories, one-hot encoding and class indexing (AGG1-3, PRJ4).

Only distinct value lists reach the driver, and every such list is checked
against a bound before it is used as a literal.  The data itself is never
collected: the distinct runs as a partial (map-side) + final hash aggregate.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.functions.arrays import one_hot_array

DEFAULT_MAX_STATES = 100_000
DENSE_ONE_HOT_LIMIT = 20_000
LITERAL_STATES = 64   # up to here a list is searched in the row


def category_table(df: DataFrame, column: str, parse_int: bool = True) -> DataFrame:
    """Distributed (value, state_idx) table, ascending by value (AGG1): the rank
    of each distinct value by a range sort, without a single-task window."""
    from bugroute.operators.ordering import rank_by

    value = F.col(column).try_cast("int") if parse_int else F.col(column)
    distinct = df.select(value.alias(column)).where(F.col(column).isNotNull()).distinct()
    return rank_by(distinct, [F.col(column)], "state_idx")


def fit_categories(df: DataFrame, column: str, parse_int: bool = True,
                   max_states: int = DEFAULT_MAX_STATES) -> list:
    """Sorted distinct values of ``column`` (non-parsable cells ignored).

    Raises if there are more than ``max_states`` values, so an unbounded list
    never lands on the driver.
    """
    value = F.col(column).try_cast("int") if parse_int else F.col(column)
    distinct = df.select(value.alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = distinct.orderBy("v").limit(max_states + 1).collect()
    if len(rows) > max_states:
        raise ValueError(f"{column}: more than {max_states} categories")
    return [r.v for r in rows]


def fit_categories_many(df: DataFrame, columns: Sequence[str], parse_int: bool = True,
                        max_states: int = DEFAULT_MAX_STATES) -> dict:
    """Sorted distinct values of several columns in ONE pass over ``df``:
    (column, value) pairs are exploded, de-duplicated by one partial + final
    aggregate, and only the distinct pairs (checked against ``max_states``
    per column) reach the driver."""
    cols = list(columns)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"),
                 (F.col(c).try_cast("int") if parse_int else F.col(c).cast("string")).alias("v"))
        for c in cols]))
    distinct = (df.select(pairs.alias("p")).select("p.c", "p.v").where(F.col("v").isNotNull())
                .distinct())
    bound = max_states * len(cols) + 1
    rows = distinct.limit(bound).collect()
    out = {c: [] for c in cols}
    for r in rows:
        out[r.c].append(r.v)
    for c in cols:
        if len(out[c]) > max_states:
            raise ValueError(f"{c}: more than {max_states} categories")
        out[c].sort()
    if len(rows) >= bound:
        raise ValueError(f"more than {max_states} categories in a column")
    return out


def one_hot(df: DataFrame, column: str, states: Sequence, out: str = "array",
            strict: bool = False) -> DataFrame:
    """Replace ``column`` by its one-hot encoding over ``states`` (PRJ4).

    out='array'   -> array<double> column, same name (dense; default)
    out='columns' -> one double column per state, ``{column}[{state}]``
    out='vector'  -> sparse ML vector (for thousands of states)
    Unknown values give all zeros, or an error with ``strict=True``.
    """
    states = list(states)
    c = F.col(column)
    if strict:
        known = c.isin(states) if states else F.lit(False)
        c = F.when(known, c).otherwise(F.raise_error(F.concat(
            F.lit(f"unknown state in {column}: "), c.cast("string"))))
    if out == "array":
        if len(states) > DENSE_ONE_HOT_LIMIT:
            raise ValueError("too many states for a dense array; use out='vector'")
        return df.withColumn(column, one_hot_array(c, states))
    if out == "columns":
        cols = [F.coalesce((c == F.lit(s)).cast("double"), F.lit(0.0)).alias(f"{column}[{s}]")
                for s in states]
        pos = df.columns.index(column)
        rest = [F.col(x) for x in df.columns]
        return df.select(*rest[:pos], *cols, *rest[pos + 1:])
    if out == "vector":
        from pyspark.ml.feature import OneHotEncoder

        spark = df.sparkSession
        table = spark.createDataFrame([(s, float(i)) for i, s in enumerate(states)],
                                      f"__state {df.schema[column].dataType.simpleString()}, __idx double")
        joined = df.join(F.broadcast(table), c == F.col("__state"), "left")
        # Unknown -> index k, dropped by dropLast: all zeros.
        joined = joined.withColumn("__idx", F.coalesce("__idx", F.lit(float(len(states)))))
        # Fitted on one row holding the largest index: k + 1 categories, the
        # last one (unknown) dropped, so vectors have exactly k slots.
        enc = OneHotEncoder(inputCols=["__idx"], outputCols=["__vec"], dropLast=True)
        model = enc.fit(spark.createDataFrame([(float(len(states)),)], "__idx double"))
        encoded = model.transform(joined)
        return encoded.withColumn(column, F.col("__vec")).drop("__state", "__idx", "__vec")
    raise ValueError(f"unknown out={out!r}")


def category_places(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict]:
    """(``df`` with each column replaced by its place among the column's distinct
    values, {column: number of values}); null and unparsable cells have none.

    The value tables stay tables: each is joined back, by broadcast if it was
    counted as at most ``DEFAULT_MAX_STATES`` rows.
    """
    widths = {}
    for c in columns:
        table = category_table(df, c).select(F.col(c).alias("__value"), F.col("state_idx").cast("int").alias("__place"))
        widths[c] = table.count()
        if widths[c] <= DEFAULT_MAX_STATES:
            table = F.broadcast(table)
        joined = df.join(table, F.col(c).try_cast("int") == F.col("__value"), "left")
        df = joined.select(*(F.col("__place").alias(c) if x == c else F.col(x) for x in df.columns))
    return df, widths


def one_hot_vectors(df: DataFrame, widths: dict) -> DataFrame:
    """Replace places (``category_places``) by sparse ML vectors of the given widths;
    a null place gives no entry."""
    from pyspark.ml.feature import OneHotEncoder

    names = [c for c, n in widths.items() if n]
    keyed = df.select("*", *(F.coalesce(F.col(c), F.lit(widths[c])).cast("double").alias(f"__at_{c}") for c in names))
    # fitted on the largest index of each column, which stands for "none" and is dropped
    encoder = OneHotEncoder(inputCols=[f"__at_{c}" for c in names], outputCols=[f"__hot_{c}" for c in names], dropLast=True)
    top = df.sparkSession.createDataFrame([tuple(float(widths[c]) for c in names)], [f"__at_{c}" for c in names])
    hot = encoder.fit(top).transform(keyed) if names else keyed
    return hot.select(*(F.col(f"__hot_{c}").alias(c) if c in names else F.col(c) for c in df.columns))


def index_classes(df: DataFrame, column: str = "class", mode: str = "dense",
                  out: str = "label", max_classes: int = DEFAULT_MAX_STATES,
                  classes: list | None = None) -> tuple[DataFrame, list]:
    """Class -> label index (AGG2). Returns (df with ``out``, class list).

    mode='dense'    -> 0..k-1 in ascending class order
    mode='identity' -> the class number is its own label
    ``classes`` reuses an already fitted class list.
    """
    if classes is None:
        classes = fit_categories(df, column, parse_int=True, max_states=max_classes)
    value = F.col(column).try_cast("int")
    if mode == "identity":
        return df.withColumn(out, value), classes
    if mode != "dense":
        raise ValueError(f"unknown mode {mode!r}")
    return join_index(df, value, classes, out), classes


def join_index(df: DataFrame, value, states: Sequence, out: str) -> DataFrame:
    """``out``: the place of ``value`` in the list ``states`` (null if absent): a
    short list is searched in the row, a longer one joined by hash; the list has been
    checked against a bound, so it is broadcast."""
    if len(states) <= LITERAL_STATES:
        place = F.array_position(F.array(*(F.lit(int(s)) for s in states)), value) if states else F.lit(0)
        return df.withColumn(out, F.when(place > 0, (place - 1).cast("int")))
    table = df.sparkSession.createDataFrame([(int(s), i) for i, s in enumerate(states)], "__state int, __place int")
    keyed = df.withColumn("__value", value).join(F.broadcast(table), F.col("__value") == F.col("__state"), "left")
    return keyed.select(*(F.col(c) for c in df.columns if c != out), F.col("__place").alias(out))


def class_index_table(df: DataFrame, column: str = "class") -> DataFrame:
    """(class, class_idx) dense index over distinct classes, as a table (AGG2)."""
    t = category_table(df, column, parse_int=True)
    return t.withColumnRenamed("state_idx", "class_idx")


def n_classes(df: DataFrame, column: str = "class", approx: bool = False) -> DataFrame:
    """Number of distinct (parsable) classes as a one-row table (AGG3)."""
    value = F.col(column).try_cast("int")
    agg = F.approx_count_distinct(value) if approx else F.count_distinct(value)
    return df.agg(agg.cast("long").alias("n_classes"))
