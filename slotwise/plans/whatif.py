"""The prep lookup and what the schedule would look like under it.

Actual events stay as they were; only planned times move.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import minutes_between, prep_bucket, with_measures, within
from slotwise.functions.buckets import PREP_LABELS, bucket_label
from slotwise.operators import (
    DAY,
    attach,
    first_in_group,
    sequence_days,
    top,
    translate,
    wide_by_flag,
)
from slotwise.schema import SPECIALTY_NAMES
from slotwise.session import cut

LOOKUP_KEYS = ["specialty", "has_anesthesia"]


def _lookup_rows(cases: DataFrame) -> DataFrame:
    rows = with_measures(cases, "patient_prep_min", "has_anesthesia", unit="second")
    return rows.where(within(F.col("patient_prep_min"), (0, 240)) & F.col("specialty").isNotNull())


def prep_lookup(cases: DataFrame) -> DataFrame:
    """Mean patient prep per specialty, with and without anesthesia."""
    return _lookup_rows(cases).groupBy(*LOOKUP_KEYS).agg(
        F.avg("patient_prep_min").alias("lookup_prep"), F.count("*").alias("n")
    )


def prep_lookup_grid(cases: DataFrame, names: Mapping[str, str] = SPECIALTY_NAMES) -> DataFrame:
    grid = wide_by_flag(
        _lookup_rows(cases), "specialty", "has_anesthesia", "patient_prep_min",
        "no_anesthesia", "with_anesthesia",
    )
    return grid.withColumn("display_name", translate(F.col("specialty"), names))


def prep_lookup_grid_ends(cases: DataFrame, k: int = 5, names: Mapping[str, str] = SPECIALTY_NAMES) -> DataFrame:
    """The first and the last ``k`` specialties by name."""
    grid = cut(prep_lookup_grid(cases, names))  # one row per specialty, read twice
    first = grid.orderBy(F.col("specialty").asc()).limit(k).withColumn("part", F.lit("first"))
    last = grid.orderBy(F.col("specialty").desc()).limit(k).withColumn("part", F.lit("last"))
    return first.unionByName(last)


def with_lookup(
    cases: DataFrame, *measures: str, how: str = "left", fit_before: str | None = None
) -> DataFrame:
    """Cases with measures in seconds over 60, and ``lookup_prep``.

    The lookup comes from the same cases, or with ``fit_before`` only from those
    before that date.
    """
    fit = cases if fit_before is None else cases.where(F.col("date") < F.lit(fit_before).cast("date"))
    rows = with_measures(cases, "planned_prep_min", "has_anesthesia", *measures, unit="second")
    return attach(rows, prep_lookup(fit).drop("n"), LOOKUP_KEYS, how)


def lookup_counts(cases: DataFrame, value: str, fit_before: str | None = None) -> DataFrame:
    """How often each combination of lookup key, planned prep and ``value`` occurs, as
    ``_n``, with the ``lookup_prep`` of its key.

    One pass over the log gives the counts, which are written once. The lookup is
    their sums per key, with partial sums in every task, and is attached to the
    counts after a check of its size; no task gathers the counts of a key. Stamps of
    whole minutes keep the counts far fewer than the cases; finer ones do not.
    """
    rows = with_measures(
        cases, *dict.fromkeys(["planned_prep_min", "patient_prep_min", "has_anesthesia", value]), unit="second"
    )
    fit = within(F.col("patient_prep_min"), (0, 240))
    if fit_before is not None:
        fit = fit & (F.col("date") < F.lit(fit_before).cast("date"))
    prep = F.when(fit, F.col("patient_prep_min"))
    counts = cut(rows.groupBy(*LOOKUP_KEYS, "planned_prep_min", value).agg(
        F.count("*").alias("_n"), F.sum(prep).alias("_prep"), F.count(prep).alias("_fit")
    ))
    lookup = counts.where(F.col("specialty").isNotNull()).groupBy(*LOOKUP_KEYS).agg(
        F.try_divide(F.sum("_prep"), F.sum("_fit")).alias("lookup_prep")
    )
    return attach(counts.drop("_prep", "_fit"), lookup, LOOKUP_KEYS)


def _moved(value: str) -> Column:
    """The value after the plan makes room for the looked-up prep."""
    return F.col(value) - (F.col("lookup_prep") - F.col("planned_prep_min"))


def _cases(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))


def _mean(x: Column) -> Column:
    return F.try_divide(F.sum(x * F.col("_n")), F.sum(F.when(x.isNotNull(), F.col("_n"))))


def _pct(condition: Column) -> Column:
    return F.try_divide(_cases(condition) * 100.0, F.sum("_n"))


def whatif_room_overrun(cases: DataFrame, fit_before: str | None = None) -> DataFrame:
    """Room overrun per class of planned prep, before and after."""
    counts = lookup_counts(cases, "room_overrun_min", fit_before).withColumn(
        "new_overrun", _moved("room_overrun_min")
    ).dropna(subset=["planned_prep_min", "room_overrun_min"])
    new = F.col("new_overrun")
    grouped = counts.groupBy(prep_bucket(F.col("planned_prep_min")).alias("bucket")).agg(
        F.sum("_n").alias("n_before"),
        _mean(F.col("room_overrun_min")).alias("mean_before"),
        _cases(new.isNotNull()).alias("n_after"),
        _mean(new).alias("mean_after"),
    )
    return grouped.where(F.col("bucket").isNotNull()).withColumn(
        "label", bucket_label(F.col("bucket"), PREP_LABELS)
    )


def before_after(counts: DataFrame, value: str) -> DataFrame:
    """Mean and late shares of ``value`` over :func:`lookup_counts`, now and under the
    lookup."""
    old, new = F.col(value), _moved(value)
    return counts.where(old.isNotNull() & new.isNotNull()).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        _mean(old).alias("mean_before"),
        _mean(new).alias("mean_after"),
        _pct(old > 0).alias("pct_late_before"),
        _pct(new > 0).alias("pct_late_after"),
        _pct(old > 15).alias("pct_late_15_before"),
        _pct(new > 15).alias("pct_late_15_after"),
        (_cases(old > 0) - _cases(new > 0)).alias("n_removed"),
    )


def whatif_start_delay(cases: DataFrame, fit_before: str | None = None) -> DataFrame:
    return before_after(lookup_counts(cases, "start_delay_min", fit_before), "start_delay_min")


def whatif_procedure_overrun(cases: DataFrame, fit_before: str | None = None) -> DataFrame:
    return before_after(lookup_counts(cases, "procedure_overrun_min", fit_before), "procedure_overrun_min")


def lookup_residual(cases: DataFrame) -> DataFrame:
    """How far real patient prep lies from its lookup value."""
    counts = lookup_counts(cases, "patient_prep_min")
    left = F.col("patient_prep_min") - F.col("lookup_prep")
    return counts.where(within(F.col("patient_prep_min"), (0, 240)) & left.isNotNull()).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        _pct(left > 0).alias("pct_over"),
        _pct(left > 15).alias("pct_over_15"),
        _mean(F.abs(left)).alias("mae"),
    )


def _unallocated(cases: DataFrame, overrun: tuple[float, float], hours: tuple[int, int]) -> DataFrame:
    """Cases without planned prep that overran and whose stamps are complete."""
    rows = with_lookup(
        cases, "start_delay_min", "patient_prep_min", "procedure_min", "procedure_overrun_min", how="inner"
    )
    return rows.where(
        (F.col("planned_prep_min") == 0)
        & F.col("patient_prep_min").isNotNull()
        & within(F.col("procedure_min"), (20, 180))
        & within(F.col("procedure_overrun_min"), overrun)
        & within(F.hour("ts_patient_in_or_planned"), hours)
    ).select(
        *DAY, "row_seq", "case_id", "specialty", "ts_patient_in_or_planned", "ts_patient_leaves_or_planned",
        "lookup_prep", "start_delay_min", "procedure_overrun_min",
    )


def feasible_candidates(
    cases: DataFrame, min_lookup: float = 20, hours: tuple[int, int] = (7, 16), write: bool = True
) -> DataFrame:
    """Cases the feasible days are made of. Several steps read them, so they are
    written once; ``write=False`` for one step that reads them once."""
    rows = _unallocated(cases, (10, 90), hours)
    rows = rows.where(F.col("start_delay_min").isNotNull() & (F.col("lookup_prep") > min_lookup))
    return cut(rows) if write else rows


def _head(rows: DataFrame, shown: int) -> DataFrame:
    return first_in_group(
        rows, DAY, [F.col("ts_patient_in_or_planned").asc(), F.col("row_seq").asc()], shown
    )


def feasible_whatif_days(
    candidates: DataFrame,
    *,
    case_range: tuple[int, int] = (3, 4),
    overrun: tuple[float, float] = (15, 90),
    shown: int = 3,
    split: bool = True,
) -> DataFrame:
    """Days whose first candidates leave room for the lookup prep between their
    planned slots.

    ``split`` says that a day can be too large for one task: days are then counted
    first and only rows of days in range are exchanged. Otherwise one exchange on
    the day serves all steps, and ``candidates`` are read once.
    """
    numbers = {
        "n_cases": F.count("*"),
        "mean_overrun": F.avg("procedure_overrun_min"),
        "mean_start_delay": F.avg("start_delay_min"),
    }
    in_range = (
        within(F.col("n_cases"), case_range)
        & (F.col("mean_overrun") > overrun[0]) & (F.col("mean_overrun") < overrun[1])
    )
    if split:
        days = candidates.groupBy(*DAY).agg(*[c.alias(n) for n, c in numbers.items()]).where(in_range)
        # Rows take their day's numbers along, so that one exchange on the day is left.
        kept = attach(candidates, days, list(DAY), "inner")
    else:
        day = Window.partitionBy(*DAY)
        kept = candidates.dropna(subset=list(DAY)).withColumns({n: c.over(day) for n, c in numbers.items()}).where(in_range)
    kept = kept.select(
        *DAY, "row_seq", "ts_patient_in_or_planned", "ts_patient_leaves_or_planned", "lookup_prep", *numbers)
    # Only days of a few cases are left, so the steps below see short groups.
    pairs = sequence_days(
        _head(kept, shown), "ts_patient_in_or_planned",
        previous={"_left": "ts_patient_leaves_or_planned", "_need": "lookup_prep"},
    )
    room = minutes_between(F.col("_left"), F.col("ts_patient_in_or_planned"), "second")
    fits = pairs.groupBy(*DAY).agg(
        *[F.any_value(c).alias(c) for c in numbers],
        F.coalesce(F.min(room >= F.col("_need")), F.lit(True)).alias("_feasible"),
    )
    return fits.where("_feasible").drop("_feasible")


def feasible_whatif_day(candidates: DataFrame, shown: int = 3, **limits) -> DataFrame:
    """The first cases of the worst feasible day, before and after."""
    days = feasible_whatif_days(candidates, shown=shown, **limits)
    best = top(days, 1, "mean_overrun", "date", "or_room")
    # One day.
    rows = candidates.join(F.broadcast(best.select(*DAY)), list(DAY), "left_semi")
    return _head(rows, shown).select(
        *DAY, "case_id", "specialty", "lookup_prep", "start_delay_min",
        F.col("procedure_overrun_min").alias("old_overrun"),
        (F.col("procedure_overrun_min") - F.col("lookup_prep")).alias("new_overrun"),
    )


def best_whatif_days(
    cases: DataFrame,
    k: int = 1,
    *,
    case_range: tuple[int, int] = (3, 4),
    min_good: int = 3,
    min_old: float = 20,
    max_new: float = 15,
    hours: tuple[int, int] = (7, 16),
) -> DataFrame:
    """Days on which the lookup would remove most of the overrun."""
    new = F.col("procedure_overrun_min") - F.col("lookup_prep")
    days = _unallocated(cases, (15, 90), hours).groupBy(*DAY).agg(
        F.count("*").alias("n_cases"),
        F.avg("procedure_overrun_min").alias("mean_old_overrun"),
        F.avg(new).alias("mean_new_overrun"),
        F.avg(F.abs(new)).alias("mean_abs_new_overrun"),
        F.count_if(F.abs(new) < 15).alias("n_good_fix"),
    ).where(
        within(F.col("n_cases"), case_range)
        & (F.col("n_good_fix") >= min_good)
        & (F.col("mean_old_overrun") > min_old)
        & (F.col("mean_abs_new_overrun") < max_new)
    )
    # Means of floats: equal scores must not be told apart by their last bits.
    score = F.round(F.col("mean_old_overrun") - F.col("mean_abs_new_overrun"), 9)
    return top(days.withColumn("score", score), k, "score", "date", "or_room")
