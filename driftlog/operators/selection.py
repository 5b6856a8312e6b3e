"""Equality filters, ranges, keyset pages and scalar aggregates over typed tables."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coercion as C

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def equals(df: DataFrame, field: str, value: Any) -> Column:
    """Equality of a column and a value: plain where their types agree, so that it reaches the scan, else of canonical texts."""
    if field not in df.columns:
        return F.lit(False)
    kind = df.schema[field].dataType
    same = (
        (isinstance(value, bool) and isinstance(kind, T.BooleanType) and value)
        or (isinstance(value, int) and not isinstance(value, bool) and isinstance(kind, T.LongType | T.IntegerType | T.ShortType))
        or (isinstance(value, float) and isinstance(kind, T.DoubleType))
        or (isinstance(value, str) and value != "" and isinstance(kind, T.StringType))
    )
    return F.col(field) == F.lit(value) if same else C.canonical(F.col(field), kind) == F.lit(C.text_of(value))


def matching(df: DataFrame, conditions: dict[str, Any]) -> Column:
    return reduce(lambda a, b: a & b, [equals(df, f, v) for f, v in conditions.items()], F.lit(True))


def where(df: DataFrame, conditions: dict[str, Any], order: str | None = None, limit: int = 0) -> DataFrame:
    """Rows that meet all conditions; with a limit the first by ``order``, so that reruns agree."""
    out = df.where(matching(df, conditions)) if conditions else df
    return out.orderBy(order).limit(limit) if limit and order else out


def between(df: DataFrame, field: str, low: Any = None, high: Any = None, conditions: dict[str, Any] | None = None, order: str | None = None, limit: int = 0, by_key: bool = False) -> DataFrame:
    """Rows with ``low <= field <= high``; None is open. ``by_key`` compares sort keys, where types come before values."""
    out = where(df, conditions or {})
    column = F.col(field)
    if by_key:
        column = C.sort_key(column, df.schema[field].dataType)
        low, high = (None if x is None else C.key_of(x) for x in (low, high))
    if low is not None:
        out = out.where(column >= F.lit(low))
    if high is not None:
        out = out.where(column <= F.lit(high))
    return out.orderBy(column, order or field).limit(limit) if limit else out


def page(df: DataFrame, key: str, size: int, cursor: Any = None, conditions: dict[str, Any] | None = None) -> DataFrame:
    """The next ``size`` rows after ``cursor`` in order of ``key``: a top-k of the filtered rows, whatever the page's number."""
    out = where(df, conditions or {})
    out = out if cursor is None else out.where(F.col(key) > F.lit(cursor))
    return out.orderBy(key).limit(max(1, size))


def measure(df: DataFrame, fn: str, field: str | None = None, decimals: int | None = None, numbers_only: bool = False) -> Column:
    """An aggregate with the numeric coercion of records: sum 0 and avg, min, max null for no rows.

    With ``decimals`` sums are exact over values of so many decimals, so that
    their order is of no matter. With ``numbers_only``, as over a many-to-many
    relation, avg divides by the numbers and a sum of nothing is null.
    """
    if fn not in FUNCTIONS:
        raise ValueError(f"{fn} is none of {', '.join(FUNCTIONS)}")
    if fn == "count":
        return F.count(F.lit(1))
    kind = df.schema[field].dataType
    value = C.number(F.col(field), kind)
    total = F.sum(value) if decimals is None else F.sum(value.cast(T.DecimalType(18, decimals))).cast("double")
    if fn == "sum":
        return total if numbers_only else F.coalesce(total, F.lit(0.0))
    if fn == "avg":  # rows that have the field count, numbers or not
        return total / F.count(value) if numbers_only else F.coalesce(total, F.lit(0.0)) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return (F.min if fn == "min" else F.max)(value)


def aggregate(df: DataFrame, measures: dict[str, tuple[str, str | None]], conditions: dict[str, Any] | None = None, by: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """``{name: (function, field)}`` over the rows that meet the conditions, in one pass, by group if ``by`` is given."""
    out = where(df, conditions or {})
    return out.groupBy(*(by or [])).agg(*[measure(df, fn, field, decimals).alias(name) for name, (fn, field) in measures.items()])


def edge(df: DataFrame, field: str, largest: bool = False) -> DataFrame:
    """(value): the field's value with the first or last sort key, of any type; null values and missing fields aside."""
    key = C.sort_key(F.col(field), df.schema[field].dataType)
    pick = F.max_by if largest else F.min_by
    return df.where(F.col(field).isNotNull()).agg(pick(F.col(field), key).alias("value"))
