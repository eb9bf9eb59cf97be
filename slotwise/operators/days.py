"""Ordered steps inside a room-day: position, previous case, running sums.

A room-day is normally a handful of cases, and one exchange on the room-day key
feeds every window. A day can also be huge (a default room, a default date), and
a plain window would then put it into one task. Such days are found by counting
first. Their rows are range-partitioned on the full sort order, so one day spreads
over many tasks; each task works on its slice and takes from the slices before it
one carry row: how many rows, which sums, which last row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.session import cut, sized

DAY = ("or_room", "date")

# A day with more rows than this is split. One task sorts this many rows easily.
HOT_ROWS = 1_000_000
# Split days together get at most this many slices; a larger log gets larger slices.
MOST_SLICES = 10_000
# Fractions are summed as whole microseconds and whole parts of a microsecond.
_MICROS, _PARTS = 60_000_000.0, float(1 << 30)


def hot_days(df: DataFrame, keys: Sequence[str] = DAY, rows: int = HOT_ROWS) -> DataFrame | None:
    """The groups with more than ``rows`` rows and their row counts, or None.

    Give the raw log: no later filter makes a group larger, and its total comes from
    file footers, so a log too small to have such a group is not read. A count per
    group is reduced before the shuffle. The answer has at most ``total / rows``
    rows; it is broadcast only after a count.
    """
    if df.count() <= rows:
        return None
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > rows)
    return None if counts.isEmpty() else cut(counts)


def sequence_days(
    df: DataFrame,
    order: str,
    *,
    tie: str = "row_seq",
    keys: Sequence[str] = DAY,
    position: str | None = None,
    size: str | None = None,
    previous: Mapping[str, str] | None = None,
    previous_known: Mapping[str, str] | None = None,
    running: Mapping[str, tuple[str, bool]] | None = None,
    hot: DataFrame | None = None,
    slice_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ordered columns within each group of ``keys``.

    ``position``: rank by ``order``, ties by ``tie``; null where ``order`` is null.
    ``size``: number of rows with an ``order`` value.
    ``previous``: new column -> column of the row before.
    ``previous_known``: new column -> the last value before that is not null.
    ``running``: new column -> (column, inclusive) sum up to this row, or before it.
    Fractional minutes are summed as whole numbers, so that no order or split of
    the sum changes the last bit of the result.
    ``hot``: answer of :func:`hot_days` for the same keys; its days are split. The
    rows are then written once, so hand in only the columns that are needed.
    """
    previous, running, known = dict(previous or {}), dict(running or {}), dict(previous_known or {})
    fractional = sorted({s for s, _ in running.values() if df.schema[s].dataType.typeName() in ("double", "float")})
    if fractional:
        whole, rest, steps = {}, {}, {}
        for s in fractional:
            micros = F.col(s).cast("double") * _MICROS
            whole[s], rest[s] = f"_whole_{s}", f"_rest_{s}"
            steps |= {whole[s]: F.floor(micros).cast("long"), rest[s]: F.round((micros - F.floor(micros)) * _PARTS).cast("long")}
        exact = {n: r for n, r in running.items() if r[0] not in whole}
        for n, (s, inclusive) in running.items():
            if s in whole:
                exact |= {f"_whole_{n}": (whole[s], inclusive), f"_rest_{n}": (rest[s], inclusive)}
        summed = sequence_days(
            df.withColumns(steps), order, tie=tie, keys=keys, position=position, size=size, previous=previous,
            previous_known=known, running=exact, hot=hot, slice_rows=slice_rows)
        fixed = {n: F.col(f"_whole_{n}") / _MICROS + F.col(f"_rest_{n}") / (_MICROS * _PARTS)
                 for n, (s, _) in running.items() if s in whole}
        return summed.withColumns(fixed).drop(*steps, *[n for n in exact if n not in running])
    if hot is None:
        return _plain(df, order, tie, keys, position, size, previous, running, known)

    df = cut(df)  # both parts below read it
    same_day = [df[k].eqNullSafe(hot[k]) for k in keys]
    marked = sized(hot)
    calm = df.join(marked, same_day, "left_anti")
    busy = df.join(marked, same_day, "left_semi")
    slices = max(2, min(MOST_SLICES, math.ceil(hot.agg(F.sum("_rows")).first()[0] / slice_rows)))
    return _plain(calm, order, tie, keys, position, size, previous, running, known).unionByName(
        _sliced(busy, order, tie, keys, position, size, previous, running, slices, known)
    )


def number_rows(df: DataFrame, order: str, name: str, slices: int | None = None) -> DataFrame:
    """0-based number of each row by the unique column ``order``.

    The whole table counts as one group split over tasks, so no task sorts it all.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = df.withColumn("_all", F.lit(0))
    numbered = _sliced(one, order, order, ["_all"], name, None, {}, {}, slices)
    return numbered.withColumn(name, F.col(name) - 1).drop("_all")


def _sort(order: str, tie: str) -> list[Column]:
    return [F.col(order).asc_nulls_last(), F.col(tie).asc()]


def _plain(df, order, tie, keys, position, size, previous, running, known=()) -> DataFrame:
    day = Window.partitionBy(*keys)
    steps = day.orderBy(*_sort(order, tie))
    new = {}
    if position:
        new[position] = F.when(F.col(order).isNotNull(), F.row_number().over(steps)).cast("long")
    if size:
        new[size] = F.count(order).over(day)
    for name, source in previous.items():
        new[name] = F.lag(source).over(steps)
    for name, source in dict(known).items():
        new[name] = F.last(source, ignorenulls=True).over(steps.rowsBetween(Window.unboundedPreceding, -1))
    for name, (source, inclusive) in running.items():
        last = Window.currentRow if inclusive else -1
        new[name] = F.coalesce(
            F.sum(source).over(steps.rowsBetween(Window.unboundedPreceding, last)), F.lit(0)
        )
    return df.withColumns(new)


def _sliced(df, order, tie, keys, position, size, previous, running, slices, known=()) -> DataFrame:
    known = dict(known)
    # The slice number must not change between its two uses, whatever is recomputed
    # after a lost executor, so the sliced rows are written once.
    by_key = [F.col(k).asc_nulls_first() for k in keys]
    rows = cut(
        df.repartitionByRange(slices, *by_key, *_sort(order, tie))
        .withColumn("_slice", F.spark_partition_id())
    )
    sources = sorted({source for source, _ in running.values()})
    local = _plain(
        rows, order, tie, [*keys, "_slice"], "_place", None,
        {f"_prev_{n}": s for n, s in previous.items()}, running, {f"_known_{n}": s for n, s in known.items()},
    )
    steps = Window.partitionBy(*keys, "_slice").orderBy(*_sort(order, tie))
    local = local.withColumn("_row", F.row_number().over(steps))

    last = F.max_by(
        F.struct(*[F.col(s).alias(n) for n, s in previous.items()], F.lit(1).alias("_one")),
        F.struct(F.col(order).isNull(), F.col(order), F.col(tie)),
    )
    place = F.struct(F.col(order).isNull(), F.col(order), F.col(tie))
    carry = rows.groupBy(*keys, "_slice").agg(
        F.count(order).alias("_n"),
        last.alias("_last"),
        *[F.max_by(s, F.when(F.col(s).isNotNull(), place)).alias(f"_end_{n}") for n, s in known.items()],
        *[F.coalesce(F.sum(s), F.lit(0)).alias(f"_sum_{s}") for s in sources],
    )
    # At most one row per slice and day, far fewer than the rows they stand for.
    chain = Window.partitionBy(*keys).orderBy("_slice")
    before = chain.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_n_day"),
        F.lag("_last").over(chain).alias("_last_before"),
        *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_end_{n}") for n in known],
        *[F.coalesce(F.sum(f"_sum_{s}").over(before), F.lit(0)).alias(f"_before_{s}") for s in sources],
    )
    # One row per (day, slice): at most `slices` + number of split days.
    carry = carry.withColumnsRenamed({k: f"_key_{k}" for k in keys}).withColumnRenamed("_slice", "_s")
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    joined = local.join(sized(carry), [*same, F.col("_slice") == F.col("_s")], "inner")

    out = {}
    if position:
        out[position] = F.col("_place") + F.col("_n_before")
    if size:
        out[size] = F.col("_n_day")
    for name in previous:
        out[name] = F.when(F.col("_row") == 1, F.col(f"_last_before.{name}")).otherwise(F.col(f"_prev_{name}"))
    for name in known:
        out[name] = F.coalesce(F.col(f"_known_{name}"), F.col(f"_end_{name}"))
    for name, (source, _) in running.items():
        out[name] = F.col(name) + F.col(f"_before_{source}")
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])
