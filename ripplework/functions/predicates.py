"""Row predicates: truth of a field, strict equality, nested paths, shapes.

They are for filters, where null counts as false; nothing wraps them, so that readers can take them over.
"""

from __future__ import annotations

import datetime
import numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field(path: str | list[str]) -> Column:
    """A field by name or by the names on the way to it. A null on the way gives null."""
    names = [path] if isinstance(path, str) else list(path)
    out = F.col(f"`{names[0]}`")
    for name in names[1:]:
        out = out[name]
    return out


def type_of(df: DataFrame, path: str | list[str]) -> T.DataType:
    names = [path] if isinstance(path, str) else list(path)
    kind: T.DataType = df.schema
    for name in names:
        kind = kind.valueType if isinstance(kind, T.MapType) else kind[name].dataType
    return kind


def truthy(df: DataFrame, path: str | list[str]) -> Column:
    """Not for null, false, zero, not-a-number and the empty string; true for all else, empty arrays and objects included."""
    kind, c = type_of(df, path), field(path)
    if isinstance(kind, T.BooleanType):
        held = c
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        held = (c != 0) & ~F.isnan(c)
    elif isinstance(kind, T.NumericType):
        held = c != 0
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        held = c != ""
    else:
        held = c.isNotNull()
    return held


_FAMILY = (
    (bool, T.BooleanType),
    (numbers.Number, T.NumericType),
    (str, T.StringType),
    (datetime.datetime, (T.TimestampType, T.TimestampNTZType)),
    (datetime.date, T.DateType),
)


def strictly_equal(df: DataFrame, path: str | list[str], value: object) -> Column:
    """Equality without casts: a value of another type than the field's equals nothing. None stands for null."""
    if value is None:
        return field(path).isNull()
    if isinstance(value, float) and value != value:
        return F.lit(False)
    kind = type_of(df, path)
    for python, spark in _FAMILY:
        if isinstance(value, python):
            return field(path) == F.lit(value) if isinstance(kind, spark) else F.lit(False)
    raise TypeError(f"no field equals a {type(value).__name__}")


def matches(df: DataFrame, shape: dict, above: tuple[str, ...] = ()) -> Column:
    """Every leaf of the shape equal; fields that it doesn't name don't count."""
    out = F.lit(True)
    for name, want in shape.items():
        path = [*above, name]
        out = out & (matches(df, want, tuple(path)) if isinstance(want, dict) else strictly_equal(df, path, want))
    return out


def within(c: Column, low: object, high: object, collapsed: str = "inclusive", floating: bool = False) -> Column:
    """low <= c <= high, bounds in either order, None for an open side. A null or NaN value is within no bounds but two open ones.

    collapsed="empty": equal bounds hold nothing. floating: c can be NaN, which Spark sorts above all numbers.
    """
    if low is not None and high is not None:
        low, high = min(low, high), max(low, high)
        if low == high and collapsed == "empty":
            return F.lit(False)
    out = F.lit(True)
    if low is not None:
        out = c >= F.lit(low)
        if high is None and floating:
            out = out & ~F.isnan(c)
    if high is not None:
        out = out & (c <= F.lit(high)) if low is not None else c <= F.lit(high)
    return out
