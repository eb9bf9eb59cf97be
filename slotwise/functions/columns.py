"""Scalar column expressions. All of them stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flags import packed_names, set_bits


def minutes_between(start: Column, end: Column, unit: str = "minute", negative: str = "keep") -> Column:
    """Minutes from ``start`` to ``end``.

    ``unit`` is ``minute`` (whole minutes, toward zero), ``second`` (whole seconds
    over 60) or ``micro`` (nothing cut off). ``negative='null'`` drops negative spans.
    """
    # Zone-less stamps are subtracted as they are; no session zone comes in.
    span = end - start
    if unit == "minute":
        span = span.cast("interval minute").cast("long")
    elif unit == "second":
        span = span.cast("interval second").cast("long") / F.lit(60.0)
    elif unit == "micro":
        span = span.cast("interval second").cast("decimal(20, 6)").cast("double") / F.lit(60.0)
    else:
        raise ValueError(f"unit {unit!r}")
    return span if negative == "keep" else F.when(span >= 0, span)


def flag_count(df: DataFrame, prefix: str) -> Column:
    """How many columns of ``prefix`` are true in a row; null counts as 0.

    One expression whatever the number of flags, so a log with hundreds of them
    still has a single projection; of packed flags it counts the bits.
    """
    if packed_names(df, prefix):
        return set_bits(F.col(f"{prefix}flags"))
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in df.columns if c.startswith(prefix)]
    return reduce(add, flags, F.lit(0)).cast("long")


def clean_procedure_name(column: Column) -> Column:
    """Procedure text without its bracketed code."""
    return F.trim(F.regexp_replace(column, r"\s*\[.*\]", ""))


def within(column: Column, bounds: tuple[float, float]) -> Column:
    """Inside the closed interval; null is outside."""
    return column.between(*bounds)


def within_abs(column: Column, limit: float) -> Column:
    return F.abs(column) < limit


def stamps_differ(a: Column, b: Column) -> Column:
    """Two stamps that were not taken in one click; a missing stamp is no pass."""
    return a != b


def outside_values(column: Column, values: tuple[str, ...]) -> Column:
    """Known and none of ``values``."""
    return column.isNotNull() & ~column.isin(list(values))


def clip_low(column: Column, low: float = 0) -> Column:
    """``column`` but at least ``low``; null stays null."""
    return F.when(column.isNotNull(), F.greatest(column, F.lit(low)))


def occupied_or_default(column: Column, default: float) -> Column:
    """A positive length, or ``default`` where none is known."""
    return F.when(column > 0, column).otherwise(F.lit(default))


def share(condition: Column) -> Column:
    """Percentage of rows with ``condition``; unknown rows do not count."""
    return F.avg(condition.cast("double")) * 100
