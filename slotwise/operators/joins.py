"""Lookup joins and codes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.session import BROADCAST_ROWS, sized

from .days import number_rows


def attach(
    df: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a lookup whose size is known only once it is computed.

    The lookup is computed once and written, then counted. A small one is
    broadcast, so the cases are not shuffled. A larger one is joined by shuffle,
    where adaptive execution splits the keys that hold many cases. A null key
    never matches.
    """
    return df.join(sized(lookup, broadcast_rows), list(on), how)


def keep_matching(
    df: DataFrame, wanted: DataFrame, on: Sequence[str], broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``wanted``, joined like a lookup."""
    return attach(df, wanted.select(*on), on, "left_semi", broadcast_rows)


def translate(column: Column, names: Mapping[str, str]) -> Column:
    """Value from a fixed dictionary, else the value itself."""
    pairs = [F.lit(part) for pair in names.items() for part in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def value_codes(train: DataFrame, column: str, code: str) -> DataFrame:
    """A 0-based number per distinct value of ``column``, in value order."""
    values = train.where(F.col(column).isNotNull()).select(column).distinct()
    return number_rows(values, column, code)


def encode(df: DataFrame, codes: DataFrame, column: str, code: str) -> DataFrame:
    """Attach the numbers of :func:`value_codes`; -1 for values without one."""
    return attach(df, codes, [column]).withColumn(code, F.coalesce(code, F.lit(-1).cast("long")))
