"""Array (vector) Column expressions, JVM-side higher-order functions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_doubles(c: Column | str) -> Column:
    return _col(c).cast("array<double>")


def with_scalar(arr: Column, scalar: Column, body) -> Column:
    """``body(arr, scalar)`` with both worked out once a row.  A lambda that
    names an outer expression evaluates it again for every element; as a field of
    an outer lambda's argument it is a value."""
    bound = F.array(F.struct(arr.alias("a"), scalar.alias("s")))
    return F.transform(bound, lambda t: body(t["a"], t["s"]))[0]


def squared_norm(c: Column | str) -> Column:
    return F.aggregate(as_doubles(c), F.lit(0.0), lambda acc, x: acc + x * x)


def unit_vector(c: Column | str) -> Column:
    """v / |v| in double precision; the zero vector stays zero (VEC1)."""
    v = as_doubles(c)
    return with_scalar(v, F.sqrt(squared_norm(v)), lambda a, norm: F.when(norm == 0, a).otherwise(
        F.transform(a, lambda x: x / norm)))


def clear_nan_values(c: Column | str) -> Column:
    """NaN -> 0 element-wise, type kept (VEC2)."""
    return F.transform(_col(c), lambda x: F.when(F.isnan(x), F.lit(0).cast("float")).otherwise(x))


def one_hot_array(c: Column | str, states: Sequence[object]) -> Column:
    """0/1 doubles, one per declared state, in the given order (PRJ4).

    A value outside the states (or null) gives all zeros.
    """
    if not states:
        return F.array().cast("array<double>")
    place = F.array_position(F.array(*map(F.lit, states)), _col(c))
    return one_hot_at(place - 1, len(states))


def one_hot_at(place: Column, size: int) -> Column:
    """``size`` doubles, 1 at ``place`` (from 0) and 0 elsewhere; a place outside
    (or null) gives all zeros."""
    zeros = F.array_repeat(F.lit(0.0), size)
    inside = (place >= 0) & (place < size)
    return F.when(inside, F.concat(
        F.array_repeat(F.lit(0.0), place.cast("int")), F.array(F.lit(1.0)),
        F.array_repeat(F.lit(0.0), (F.lit(size - 1) - place).cast("int")))).otherwise(zeros)


def pad_array(c: Column | str, length: int, fill: object = 0) -> Column:
    """Cut or pad an array to a fixed length (Huffman codes/points, VEC4)."""
    return F.slice(F.concat(_col(c), F.array_repeat(F.lit(fill), length)), 1, length)


def posexplode_rows(df, keep, array_col, pos: str = "pos", value: str = "value"):
    """``posexplode`` without the inferred ``size(array) > 0`` filter.

    Spark adds that filter below a plain generator and inlines the whole
    expression that built the array into it, so an expensive array (regex
    split, repeated word lists) would be computed twice or more.  The outer
    generator is not given the filter; its null row for an empty array is
    removed here instead (array elements themselves are never null here).
    """
    keep = [keep] if isinstance(keep, str) else list(keep)
    out = df.select(*keep, F.posexplode_outer(_col(array_col)).alias(pos, value))
    return out.where(F.col(pos).isNotNull())
