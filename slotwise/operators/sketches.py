"""Approximate quantiles from sketches that are stored and merged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values a sketch keeps at least; up to so many values in all it is exact.
SIZE = 400


def rank_error(size: int = SIZE) -> float:
    """Share of the rows by which a quantile's rank is off at most, in 99 of 100 cases."""
    # The published fit for this sketch and single quantiles.
    return 2.296 / size ** 0.9723


def quantile_sketches(df: DataFrame, column: str, keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``keys``, ``n``, ``total`` and ``sketch`` (bytes) per group; nulls left out.

    A KLL sketch holds a few kilobytes whatever the group's rows, so map tasks send
    a sketch a group. Store the result by day, say, and merge it with later ones.
    """
    x = F.col(column).cast("double")
    return df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(x).alias("total"), F.kll_sketch_agg_double(x, size).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """The sketches of coarser groups; the same bound on the error holds for them.

    Rows without a sketch, as of an empty table, are left out.
    """
    return sketches.where(F.col("sketch").isNotNull()).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, quantiles: Mapping[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``n``, ``mean``, and per name the least value that its share of the rows does not exceed."""
    known = sketches.where(F.col("n") > 0)
    return known.select(
        *keys, "n", F.try_divide("total", F.col("n")).alias("mean"),
        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()])
