"""Distributions from counts per distinct value.

Minutes take few distinct values, so counting them first shrinks any number of
rows to a table bounded by the value range before the shuffle. Everything below
works on that table and is exact.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.session import cut, sized

from .sketches import quantile_sketches, sketch_quantiles


def value_counts(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys``, ``_value`` and how often it occurs as ``_n``; nulls left out."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).alias("_value"))
        .agg(F.count("*").alias("_n"))
    )


#: More distinct values than this are not sorted in one task.
MANY_VALUES = 200_000


def _ranked(counts: DataFrame, keys: Sequence[str], many: bool | None = None, wanted: Sequence[float] = ()) -> DataFrame:
    """``counts`` with rows up to a value (``_upto``), rows (``_total``) and sum (``_sum``) of the group.

    Whole minutes are few, and one window a group ranks them. Fractional values can
    be as many as rows: beyond ``MANY_VALUES`` of them, or with ``many``, only rows
    around the ``wanted`` quantiles are ranked and returned.
    """
    if many is None and counts.schema["_value"].dataType.typeName() in ("double", "float", "decimal"):
        counts = cut(counts)
        many = counts.count() > MANY_VALUES
    if many:
        return _near(counts, keys, wanted)
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({
        "_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(group),
        "_sum": F.sum(F.col("_value") * F.col("_n")).over(group)})


def _near(counts: DataFrame, keys: Sequence[str], wanted: Sequence[float]) -> DataFrame:
    """Selection in two steps, for any number of distinct values.

    Values are range-partitioned in slices; sums over slices tell which of them
    hold the wanted indices, and only those are sorted, each by itself.
    """
    spark = counts.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = [*keys, "_all"]  # with no keys, one column to be grouped by all the same
    rows = cut(
        counts.withColumn("_all", F.lit(0)).repartitionByRange(slices, *[F.col(k).asc_nulls_first() for k in keys], F.col("_value"))
        .withColumn("_slice", F.spark_partition_id()))
    sums = rows.groupBy(*group, "_slice").agg(F.sum("_n").alias("_here"), F.sum(F.col("_value") * F.col("_n")).alias("_part"))
    chain = Window.partitionBy(*group)
    sums = sums.withColumns({
        "_before": F.sum("_here").over(chain.orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_here"),
        "_total": F.sum("_here").over(chain), "_sum": F.sum("_part").over(chain)})
    hit = F.lit(False)
    for q in wanted:
        index = F.lit(q) * (F.col("_total") - 1)
        for i in (F.floor(index), F.ceil(index)):
            hit = hit | ((i >= F.col("_before")) & (i < F.col("_before") + F.col("_here")))
    # At most two slices a quantile and group.
    chosen = sums.where(hit).drop("_here", "_part").withColumnsRenamed({k: f"_key_{k}" for k in [*group, "_slice"]})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in [*group, "_slice"]]
    inside = Window.partitionBy(*group, "_slice").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = rows.join(sized(chosen), same, "inner").withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))
    return ranked.select(*keys, "_value", "_n", "_upto", "_total", "_sum")


def _quantile(q: float, method: str) -> Column:
    """Aggregate over ranked counts. ``nearest``: the value at the rounded index;
    ``linear``: interpolated between the two neighbours."""
    index = F.lit(q) * (F.col("_total") - 1)

    def at(i: Column) -> Column:
        return F.min(F.when(F.col("_upto") > i, F.col("_value"))).cast("double")

    if method == "nearest":
        return at(F.round(index))
    if method == "linear":
        low = at(F.floor(index))
        return low + (at(F.ceil(index)) - low) * F.max(index - F.floor(index))
    raise ValueError(f"method {method!r}")


def distribution(
    df: DataFrame,
    column: str,
    quantiles: Mapping[str, float],
    keys: Sequence[str] = (),
    method: str = "nearest",
    many: bool | None = None,
) -> DataFrame:
    """Count, mean, median and the named quantiles of ``column`` per group.

    ``method``: ``nearest`` and ``linear`` are exact; ``approx`` takes them from
    sketches, off by :func:`rank_error` of the rows. ``many`` says whether there are
    many distinct values; by default fractional ones are counted first.
    """
    if method == "approx":
        sketches = quantile_sketches(df, column, keys)
        return sketch_quantiles(sketches, {"median": 0.5, **quantiles}, keys)
    return (
        _ranked(value_counts(df, column, keys), keys, many, [0.5, *quantiles.values()])
        .groupBy(*keys)
        .agg(
            F.max("_total").alias("n"),
            (F.max("_sum") / F.max("_total")).alias("mean"),
            _quantile(0.5, "linear").alias("median"),
            *[_quantile(q, method).alias(name) for name, q in quantiles.items()],
        )
    )


def histogram(
    df: DataFrame,
    column: str,
    bins: int | None = None,
    width: float | None = None,
    bounds: tuple[float, float] | None = None,
    merge_empty: bool = False,
) -> DataFrame:
    """Equal-width bins: ``bin``, ``bin_start``, ``bin_end``, ``n``, empty bins too.

    Give ``bins`` for that many bins between the smallest and the largest value, or
    between ``bounds``; the last bin takes its upper edge. Give ``width`` for bins of
    that width from 0 upward; ``merge_empty`` makes one row of a run of empty ones.
    """
    counts = value_counts(df, column)
    return bins_of_width(counts, width, merge_empty) if width is not None else bins_of_range(counts, bins, bounds)


def bins_of_range(
    counts: DataFrame, bins: int, bounds: tuple[float, float] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """``bins`` equal bins over a table of :func:`value_counts`, per group of ``keys``."""
    x = F.col("_value").cast("double")
    if bounds is None:
        group = Window.partitionBy(*keys)
        low, high = F.min(x).over(group), F.max(x).over(group)
    else:
        low, high = F.lit(float(bounds[0])), F.lit(float(bounds[1]))
    pad = F.when(high == low, 0.5).otherwise(0.0)
    placed = counts.select(*keys, x.alias("_x"), "_n", (low - pad).alias("_low"), (high + pad).alias("_high"))
    number = F.floor((F.col("_x") - F.col("_low")) * bins / (F.col("_high") - F.col("_low")))
    binned = (
        placed.where(F.col("_x").between(F.col("_low"), F.col("_high")))
        .groupBy(*keys, "_low", "_high", F.least(number, F.lit(bins - 1).cast("long")).alias("_bin"))
        .agg(F.sum("_n").alias("_n"))
    )
    step = (F.max("_high") - F.min("_low")) / bins
    return _fill(binned, F.min("_low"), step, F.lit(bins - 1).cast("long"), keys)


def bins_of_width(counts: DataFrame, width: float, merge_empty: bool = False) -> DataFrame:
    """Bins of ``width`` from 0 up over a table of :func:`value_counts`.

    Empty bins up to the largest value are rows with 0, made by as many tasks as
    they ask for; one stray value can make them very many. With ``merge_empty`` a
    run of empty bins is one row, from the first one's start to the last one's end.
    """
    x = F.col("_value").cast("double")
    binned = cut(counts.where(x >= 0).groupBy(F.floor(x / width).alias("bin")).agg(F.sum("_n").alias("n")))
    last = binned.agg(F.max("bin")).first()[0]
    spark = counts.sparkSession
    if merge_empty:
        # One row a bin that holds something.
        before = F.coalesce(F.lag("bin").over(Window.partitionBy(F.lit(0)).orderBy("bin")), F.lit(-1).cast("long"))
        gap = F.struct((before + 1).alias("bin"), F.col("bin").alias("end"), F.lit(0).cast("long").alias("n"))
        full = F.struct("bin", (F.col("bin") + 1).alias("end"), "n")
        runs = binned.select(F.when(F.col("bin") > before + 1, F.array(gap, full)).otherwise(F.array(full)).alias("runs"))
        bins = runs.select(F.inline("runs"))
    else:
        every = spark.range(0, 0 if last is None else last + 1).withColumnRenamed("id", "bin")
        bins = every.join(sized(binned), "bin", "left").select("bin", (F.col("bin") + 1).alias("end"), F.coalesce("n", F.lit(0)).alias("n"))
    return bins.select("bin", (F.col("bin") * float(width)).alias("bin_start"), (F.col("end") * float(width)).alias("bin_end"), "n")


def _fill(binned: DataFrame, low: Column, step: Column, last: Column, keys: Sequence[str]) -> DataFrame:
    """One row per bin up to ``last``, with 0 where nothing fell. Bins, not rows, are
    gathered: their number is a parameter."""
    gathered = binned.groupBy(*keys).agg(
        low.alias("_start"), step.alias("_step"), last.alias("_last"),
        F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_filled"),
    ).where(F.col("_start").isNotNull() & F.col("_last").isNotNull())
    bins = gathered.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("bin"))
    return bins.select(
        *keys,
        "bin",
        (F.col("_start") + F.col("bin") * F.col("_step")).alias("bin_start"),
        (F.col("_start") + (F.col("bin") + 1) * F.col("_step")).alias("bin_end"),
        F.coalesce(F.col("_filled")[F.col("bin")], F.lit(0).cast("long")).alias("n"),
    )


#: A kernel further off than this many bandwidths is zero in double precision.
_REACH = 38.61


def density(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    *,
    bounds: tuple[float, float] | None = None,
    points: int = 500,
    factor: float | None = 0.15,
    error: float | None = None,
) -> DataFrame:
    """Gaussian kernel density on a grid: ``keys``, ``n``, ``point``, ``x``, ``density``.

    The bandwidth is ``factor`` times the sample deviation of the group, or with
    ``factor=None`` the n ** (-1/5) rule. The grid spans ``bounds``, or the group's
    own range. Each distinct value is one kernel weighted by its count, so the
    result equals a density over all rows. A value meets only the points at which
    its kernel is not zero.

    Fractional values can be as many as rows. With ``error`` each is first shared
    between the two ends of a cell of the bandwidth times sqrt(8 * error), so a
    group has no more kernels than cells, whatever its rows; densities are then off
    by at most ``error`` times the height of a group's single kernel,
    1 / (bandwidth * sqrt(2 pi)).
    """
    counts = cut(value_counts(df, column, keys))  # read three times
    value, weight = F.col("_value"), F.col("_n")
    scale = F.lit(factor) if factor is not None else F.pow(F.col("_rows").cast("double"), F.lit(-0.2))
    spread = F.sqrt(F.try_divide(F.col("_squares") - F.col("_sum") * F.col("_sum") / F.col("_rows"), F.col("_rows") - 1))
    groups = (
        counts.groupBy(*keys)
        .agg(F.sum(weight).alias("_rows"), F.sum(value * weight).alias("_sum"), F.sum(value * value * weight).alias("_squares"),
             F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
        .withColumn("_h", spread * scale)
        .where(F.col("_h") > 0)
        .select(*keys, "_rows", "_h", *([F.lit(float(b)).alias(c) for b, c in zip(bounds, ("_low", "_high"))] if bounds else ["_low", "_high"]))
    )
    marks = groups.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    # Without keys there is one row of marks.
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    kernels = (counts.join(marks, same) if keys else counts.join(F.broadcast(marks))).select(
        *keys, "_rows", "_h", "_low", "_high", value.cast("double").alias("_value"), weight.cast("double").alias("_n"))
    if error is not None:
        kernels = _shared(kernels, keys, error)
    step = (F.col("_high") - F.col("_low")) / (points - 1)
    reach = F.col("_h") * _REACH
    place = lambda at, whole, other: F.coalesce(whole(F.try_divide(at - F.col("_low"), step)), F.lit(other))
    first = F.greatest(place(value - reach, F.ceil, 0), F.lit(0))
    last = F.least(place(value + reach, F.floor, points - 1), F.lit(points - 1))
    met = kernels.withColumn("point", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
    x = F.col("_low") + F.col("point") * (F.col("_high") - F.col("_low")) / (points - 1)
    z = (x - value) / F.col("_h")
    kernel = weight * F.exp(z * z * -0.5) / (F.col("_rows") * F.col("_h") * math.sqrt(2 * math.pi))
    # Every point of the grid once with nothing, so that those without a kernel are there.
    grid = groups.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    named = [*keys, F.col("_rows").alias("n"), F.col("point").cast("long").alias("point"), x.alias("x")]
    return (
        met.select(*named, kernel.alias("_k"))
        .unionByName(grid.select(*named, F.lit(0.0).alias("_k")))
        .groupBy(*keys, "n", "point", "x")
        .agg(F.sum("_k").alias("density"))
    )


def _shared(kernels: DataFrame, keys: Sequence[str], error: float) -> DataFrame:
    """Kernels at cell ends in place of those at values; each value counts at both ends of its cell, more at the nearer."""
    width = F.col("_h") * math.sqrt(8 * error)
    at = (F.col("_value") - F.col("_low")) / width
    cell, part = F.floor(at), at - F.floor(at)
    ends = F.array(F.struct(cell.alias("cell"), (F.col("_n") * (1 - part)).alias("n")),
                   F.struct((cell + 1).alias("cell"), (F.col("_n") * part).alias("n")))
    group = [*keys, "_rows", "_h", "_low", "_high"]
    return (
        kernels.select(*group, F.inline(ends).alias("_cell", "_n"))
        .groupBy(*group, "_cell").agg(F.sum("_n").alias("_n"))
        .select(*group, (F.col("_low") + F.col("_cell") * width).alias("_value"), "_n")
    )


def violin(df: DataFrame, column: str, key: str, points: int = 100) -> DataFrame:
    """Outline, mean, median and count of ``column`` per value of ``key``."""
    outline = density(df, column, [key], points=points, factor=None)
    marks = distribution(df, column, {}, [key]).drop("n")
    return outline.join(marks, key)


def box_stats(df: DataFrame, column: str, key: str, min_rows: int = 50, many: bool | None = None) -> DataFrame:
    """Quartiles per group, and whiskers at the outermost values inside the 5th to
    95th percentile."""
    counts = value_counts(df, column, [key])
    marks = {"q1": 0.25, "median": 0.5, "q3": 0.75, "_p5": 0.05, "_p95": 0.95}
    boxes = (
        _ranked(counts, [key], many, list(marks.values()))
        .groupBy(key)
        .agg(F.max("_total").alias("n"), *[_quantile(q, "linear").alias(name) for name, q in marks.items()])
        .where(F.col("n") >= min_rows)
    )
    inside = F.when(F.col("_value").between(F.col("_p5"), F.col("_p95")), F.col("_value"))
    return (
        counts.join(boxes, key)
        .groupBy(key, "n", "q1", "median", "q3")
        .agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))
    )
