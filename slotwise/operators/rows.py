"""Row selection: first per key, best per group, top k.

All of these are ranks with an upper limit. Spark pushes such a limit below the
exchange (window group limit), so one map task sends at most ``k`` rows of a key
and a key that holds a third of the log reaches its reducer already reduced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of every group in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_rows(log: DataFrame, key: str = "case_id", order: str = "row_seq") -> DataFrame:
    """One row per case: the earliest in file order."""
    return first_in_group(log, [key], [F.col(order).asc()])


def prepared(log: DataFrame, specialty: str | None = None) -> DataFrame:
    """The case table of a log, of one specialty if named."""
    if specialty is not None:
        log = log.where(F.col("specialty") == specialty)
    return first_rows(log)


def best_in_group(df: DataFrame, keys: Sequence[str], score: Column, *ties: str) -> DataFrame:
    """The highest-scoring row of every group, ties by the named columns."""
    return first_in_group(df, keys, [score.desc(), *[F.col(t).asc_nulls_last() for t in ties]])


def top(df: DataFrame, k: int, score: str, *ties: str, ascending: bool = False) -> DataFrame:
    """The ``k`` highest rows; each task keeps ``k`` rows, nothing is sorted whole."""
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_first() for t in ties]).limit(k)
