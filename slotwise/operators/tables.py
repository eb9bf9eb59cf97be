"""Aggregated tables: correlations, fits, prediction quality, wide and list forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import pearson


def correlation_table(
    df: DataFrame,
    predictors: Mapping[str, str],
    targets: Mapping[str, str],
    min_spread: float | None = None,
) -> DataFrame:
    """``predictor`` and one correlation column per target.

    ``predictors`` maps labels to columns, ``targets`` result names to columns. Rows
    that lack the predictor or any target do not count. A predictor whose sample
    deviation is below ``min_spread`` is left out.
    """
    known = F.lit(True)
    for column in targets.values():
        known = known & F.col(column).isNotNull()
    lines = []
    for label, column in predictors.items():
        x = F.when(known, F.col(column).cast("double"))
        lines.append(
            F.struct(
                F.lit(label).alias("predictor"),
                F.stddev_samp(x).alias("_spread"),
                *[pearson(x, F.col(t)).alias(name) for name, t in targets.items()],
            )
        )
    # All correlations come from one pass without a shuffle of rows.
    table = df.agg(F.array(*lines).alias("_lines")).select(F.inline("_lines"))
    if min_spread is not None:
        table = table.where(F.col("_spread").isNull() | (F.col("_spread") >= min_spread))
    return table.drop("_spread")


def signal_capture(table: DataFrame, planned: str, actual: str) -> DataFrame:
    """Mean ratio of the strength of two correlation columns."""
    ratio = F.try_divide(F.abs(F.col(planned)), F.abs(F.col(actual)))
    return table.agg(F.avg(ratio).alias("capture_ratio"))


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and correlation over all rows."""
    return df.agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        pearson(F.col(x), F.col(y)).alias("r"),
    )


def group_fit(
    df: DataFrame, keys: Sequence[str], y: str, others: Sequence[str] = (), by: Sequence[str] = ()
) -> DataFrame:
    """How much of ``y`` the group means explain, and what they leave; a row for each value of ``by``.

    ``r2`` is 1 - SSE / SST. For each column of ``others``, ``r_<column>`` is the
    correlation of the residual with it. Only sums per group are shuffled; means
    are never joined back to rows.
    """
    yv = F.col(y).cast("double")
    known = df.where(yv.isNotNull())
    sums = [F.count("*").alias("_n"), F.sum(yv).alias("_y"), F.sum(yv * yv).alias("_yy")]
    for i, name in enumerate(others):
        x = F.col(name).cast("double")
        pair = x.isNotNull()
        sums += [
            F.count(x).alias(f"_n{i}"), F.sum(F.when(pair, yv)).alias(f"_y{i}"),
            F.sum(F.when(pair, yv * yv)).alias(f"_yy{i}"), F.sum(x).alias(f"_x{i}"),
            F.sum(x * x).alias(f"_xx{i}"), F.sum(x * yv).alias(f"_xy{i}"),
        ]
    groups = known.groupBy(*by, *keys).agg(*sums)
    mean = F.col("_y") / F.col("_n")
    n, sum_y, sum_yy = (F.sum(c) for c in ("_n", "_y", "_yy"))
    left = F.sum(F.col("_yy") - F.col("_y") * mean)
    out = [
        n.alias("n"),
        F.count("*").alias("n_groups"),
        (1 - F.try_divide(left, sum_yy - sum_y * sum_y / n)).alias("r2"),
    ]
    for i, name in enumerate(others):
        m, sy, syy, sx, sxx, sxy = (F.col(f"_{k}{i}") for k in ("n", "y", "yy", "x", "xx", "xy"))
        rows = F.sum(m)
        r = F.sum(sy - m * mean)
        rr = F.sum(syy - sy * mean * 2 + m * mean * mean)
        rx = F.sum(sxy - sx * mean)
        x, xx = F.sum(sx), F.sum(sxx)
        spread = F.sqrt(rr - r * r / rows) * F.sqrt(xx - x * x / rows)
        out.append(F.try_divide(rx - r * x / rows, spread).alias(f"r_{name}"))
    return groups.groupBy(*by).agg(*out)


def prediction_quality(df: DataFrame, actual: str, prediction: str) -> DataFrame:
    """Count, mean absolute error, R2 and mean bias of a prediction column."""
    a, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    error = a - p
    return df.where(error.isNotNull()).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        (1 - F.try_divide(F.sum(error * error), F.var_pop(a) * F.count("*"))).alias("r2"),
        F.avg(error).alias("bias"),
    )


def wide_by_flag(df: DataFrame, key: str, flag: str, value: str, no: str, yes: str) -> DataFrame:
    """One row per key with the mean of ``value`` without and with the flag; a
    missing combination is null. Naming the two values saves a pass over the data."""
    return (
        df.groupBy(key).pivot(flag, [False, True]).agg(F.avg(value))
        .withColumnsRenamed({"false": no, "true": yes})
    )


def ordered_list(
    df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], length: int | None = None
) -> DataFrame:
    """One row per group with one list per field, in order. For groups known to be
    short; it holds a group in memory.

    With ``length``, ``order`` has to be the position from 1 in the group (of
    :func:`sequence_days`, which splits large days), and a group's lists are cut
    into segments of that many rows, numbered from 0 in ``segment``: no task holds
    more than a segment of any group.
    """
    packed = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    if length is not None:
        df = df.withColumn("segment", F.floor((F.col(order) - 1) / length).cast("long"))
        keys = [*keys, "segment"]
    return df.groupBy(*keys).agg(packed.alias("_rows")).select(
        *keys, *[F.col(f"_rows.{f}").alias(f"{f}_list") for f in fields]
    )
