"""The clean surgical set: funnel, procedures, day types, waiting, signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import (
    clean_procedure_name,
    day_type,
    minutes_between,
    outside_values,
    pearson,
    share,
    stamps_differ,
    with_measures,
    within,
    within_abs,
)
from slotwise.operators import (
    DAY,
    attach,
    best_in_group,
    correlation_table,
    first_rows,
    sequence_days,
    top,
)
from slotwise.operators.days import number_rows
from slotwise.operators.distribution import bins_of_range
from slotwise.schema import NON_SURGICAL
from slotwise.session import cut

MIN_CASES = 50


def clean_stamps() -> Column:
    return stamps_differ(F.col("ts_or_prep_start"), F.col("ts_or_prep_done"))


_MEASURES = (
    "planned_prep_min", "planned_inor_min", "actual_prep_min", "actual_inor_min", "start_delay_min",
    "room_overrun_min", "staff_count", "resource_count", "has_anesthesia", "prep_gap_min", "inor_gap_min",
)
_KEPT = (
    "row_seq", "case_id", "or_room", "date", "specialty", "patient_age", "procedure_name",
    "ts_patient_in_or_planned", "ts_patient_leaves_or_planned", "ts_or_prep_start", "ts_patient_in_or",
    "ts_procedure_start", "ts_procedure_end", "ts_patient_leaves_or", *_MEASURES,
)


def surgical_set(cases: DataFrame, exclude: Sequence[str] = NON_SURGICAL, clip: float = 300) -> DataFrame:
    """Cases with separate prep stamps, plausible gaps and a surgical specialty.

    Negative durations count as unknown here. Flags are counted and dropped, so the
    set stays narrow whatever the width of the log.
    """
    rows = with_measures(cases, *_MEASURES, negative="null").withColumn(
        "procedure_name", clean_procedure_name(F.col("procedure_text_id"))
    )
    return rows.where(
        within_abs(F.col("prep_gap_min"), clip)
        & within_abs(F.col("inor_gap_min"), clip)
        & clean_stamps()
        & outside_values(F.col("specialty"), tuple(exclude))
    ).select(*_KEPT)


def with_places(valid: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Place in the day among the kept cases, day size, first and last marks."""
    rows = sequence_days(
        valid, "ts_patient_in_or_planned", position="position", size="total_cases_that_day", hot=hot
    )
    place, size = F.col("position"), F.col("total_cases_that_day")
    return rows.withColumns({"is_first_of_day": place == 1, "is_last_of_day": place == size})


def data_funnel(log: DataFrame, exclude: Sequence[str] = NON_SURGICAL) -> DataFrame:
    """Rows left after each cleaning step, raw rows to analysis set."""
    clean = clean_stamps()
    kept = surgical_set(first_rows(log), exclude).agg(F.count("*")).scalar()
    counts = log.agg(
        F.count("*").alias("raw"),
        F.count_if(clean).alias("clean"),
        F.count_if(clean & outside_values(F.col("specialty"), tuple(exclude))).alias("surgical"),
    ).withColumn("kept", kept)
    steps = [
        F.struct(F.lit(i).cast("long").alias("step"), F.lit(name).alias("name"), F.col(c).alias("n"))
        for i, (name, c) in enumerate(
            (("raw rows", "raw"), ("clean prep stamps", "clean"),
             ("surgical specialties", "surgical"), ("analysis set", "kept")), start=1)
    ]
    return counts.select("raw", F.inline(F.array(*steps))).select(
        "step", "name", "n", (F.col("n") * 100.0 / F.col("raw")).alias("pct_of_raw")
    )


def phase_comparison(valid: DataFrame, min_cases: int = MIN_CASES, key: str = "procedure_name") -> DataFrame:
    """Planned and actual prep and surgery per procedure, or per another ``key``.

    ``prep_worse`` and ``zero_planned`` compare means at one decimal, so a mean
    below 0.05 counts as nothing planned.
    """
    return (
        valid.groupBy(key)
        .agg(
            F.count("*").alias("n"),
            F.avg("planned_prep_min").alias("planned_prep"),
            F.avg("actual_prep_min").alias("actual_prep"),
            F.avg("prep_gap_min").alias("prep_gap"),
            F.avg("planned_inor_min").alias("planned_surgery"),
            F.avg("actual_inor_min").alias("actual_surgery"),
            F.avg("inor_gap_min").alias("surgery_gap"),
        )
        .where(F.col("n") >= min_cases)
        .withColumn(
            "prep_worse",
            F.abs(F.round("prep_gap", 1)) > F.abs(F.round("surgery_gap", 1)),
        )
        .withColumn("zero_planned", F.round("planned_prep", 1) == 0)
    )


def phase_gap_summary(valid: DataFrame, min_cases: int = MIN_CASES) -> DataFrame:
    """Mean gaps over all cases, and the share of procedures with the larger prep gap."""
    sums = valid.groupBy("procedure_name").agg(
        F.count("*").alias("_n"), F.sum("prep_gap_min").alias("_prep"), F.sum("inor_gap_min").alias("_inor")
    )
    prep, inor = (F.abs(F.round(F.col(c) / F.col("_n"), 1)) for c in ("_prep", "_inor"))
    return sums.agg(
        F.sum("_n").alias("n"),
        F.try_divide(F.sum("_prep"), F.sum("_n")).alias("mean_prep_gap"),
        F.try_divide(F.sum("_inor"), F.sum("_n")).alias("mean_surgery_gap"),
        share(F.when(F.col("_n") >= min_cases, prep > inor)).alias("pct_prep_worse"),
    )


def zero_allocation_split(
    valid: DataFrame, min_cases: int = MIN_CASES, key: str = "procedure_name"
) -> DataFrame:
    """Procedures with and without planned prep: mean of their means."""
    return phase_comparison(valid, min_cases, key).groupBy("zero_planned").agg(
        F.count("*").alias("n_procedures"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("planned_prep", "actual_prep", "prep_gap", "surgery_gap")],
    )


def zero_allocation_top(
    valid: DataFrame, k: int = 10, min_cases: int = MIN_CASES, key: str = "procedure_name"
) -> DataFrame:
    rows = phase_comparison(valid, min_cases, key).where("zero_planned").select(
        key, "n", "planned_prep", "actual_prep", "prep_gap", "surgery_gap"
    )
    return top(rows, k, "prep_gap", key)


def zero_allocation_histogram(
    valid: DataFrame, bins: int = 40, min_cases: int = MIN_CASES, key: str = "procedure_name"
) -> DataFrame:
    """Actual prep of the cases of all procedures without planned prep.

    Rows are counted per procedure and minute first; procedures are judged on those
    counts, so cases are never joined to procedures.
    """
    planned = F.col("planned_prep_min")
    counts = valid.groupBy(key, F.col("actual_prep_min").alias("_value")).agg(
        F.count("*").alias("_n"), F.sum(planned).alias("_sum"), F.count(planned).alias("_known")
    )
    procedure = Window.partitionBy(key)
    mean = F.sum("_sum").over(procedure) / F.sum("_known").over(procedure)
    judged = counts.select(
        "_value", "_n", F.sum("_n").over(procedure).alias("_cases"), F.round(mean, 1).alias("_mean")
    ).where((F.col("_cases") >= min_cases) & (F.col("_mean") == 0) & F.col("_value").isNotNull())
    return bins_of_range(judged.groupBy("_value").agg(F.sum("_n").alias("_n")), bins)


def _long_days(valid: DataFrame, min_cases: int, hot: DataFrame | None) -> DataFrame:
    return with_places(valid, hot).where(F.col("total_cases_that_day") >= min_cases)


def _classified(long_days: DataFrame) -> DataFrame:
    place, delay = F.col("position"), F.col("start_delay_min")
    first, last = F.col("is_first_of_day"), F.col("is_last_of_day")
    return (
        long_days.groupBy(*DAY)
        .agg(
            # Exact ties with the class bounds are common in short days, so the
            # last bits of the division must not decide.
            F.round(pearson(place, delay), 9).alias("position_delay_corr"),
            F.max(F.when(first, delay)).alias("first_case_delay"),
            F.max(F.when(first, F.col("prep_gap_min"))).alias("first_case_prep_gap"),
            F.avg(delay).alias("mean_day_delay"),
            F.max(F.when(last, F.col("room_overrun_min"))).alias("last_case_finish_delay"),
            F.max("total_cases_that_day").alias("n_cases"),
            F.max(F.when(first, F.col("specialty"))).alias("specialty"),
        )
        .dropna()
        .withColumn("day_type", day_type(F.col("position_delay_corr")))
    )


def or_day_classification(valid: DataFrame, min_cases: int = 3, hot: DataFrame | None = None) -> DataFrame:
    """One row per room-day: does delay grow, shrink or stay along the day?"""
    return _classified(_long_days(valid, min_cases, hot))


def day_type_summary(days: DataFrame) -> DataFrame:
    return days.groupBy("day_type").agg(
        F.count("*").alias("n_days"),
        F.avg("first_case_delay").alias("mean_first_delay"),
        F.avg("first_case_prep_gap").alias("mean_first_prep_gap"),
        F.avg("mean_day_delay").alias("mean_day_delay"),
        F.avg("last_case_finish_delay").alias("mean_last_finish_delay"),
    )


def delay_curve_by_day_type(
    valid: DataFrame, min_cases: int = 3, min_rows: int = 30, hot: DataFrame | None = None
) -> DataFrame:
    # Both sides of the join below come from these rows; they are made once.
    rows = cut(_long_days(valid, min_cases, hot).select(
        *DAY, "position", "start_delay_min", "prep_gap_min", "room_overrun_min", "specialty",
        "is_first_of_day", "is_last_of_day", "total_cases_that_day",
    ))
    return (
        rows.join(_classified(rows).select(*DAY, "day_type"), list(DAY))
        .groupBy("day_type", "position")
        .agg(F.avg("start_delay_min").alias("mean_delay"), F.count("*").alias("n"))
        .where(F.col("n") >= min_rows)
    )


def example_days(days: DataFrame, min_cases: int = 4) -> DataFrame:
    """The clearest day of each type: highest, lowest and flattest correlation."""
    r = F.col("position_delay_corr")
    clear = F.when(F.col("day_type") == "Cascading", r).when(F.col("day_type") == "Recovery", -r).otherwise(-F.abs(r))
    return best_in_group(days.where(F.col("n_cases") >= min_cases), ["day_type"], clear, "date", "or_room")


def day_examples(valid: DataFrame, min_cases: int = 4, hot: DataFrame | None = None) -> DataFrame:
    """The cases of the example days with their places."""
    chosen = example_days(or_day_classification(valid, 3, hot), min_cases).select(*DAY, "day_type")
    # One day per type; places are counted again for these days only.
    return with_places(valid.join(F.broadcast(chosen), list(DAY)), hot)


def day_timeline(cases: DataFrame) -> DataFrame:
    """Planned slot and actual phases of each case as intervals, in minutes after
    midnight; intervals without length are left out."""
    phases = (
        ("planned", "ts_patient_in_or_planned", "ts_patient_leaves_or_planned"),
        ("room prep", "ts_or_prep_start", "ts_patient_in_or"),
        ("patient prep", "ts_patient_in_or", "ts_procedure_start"),
        ("surgery", "ts_procedure_start", "ts_procedure_end"),
        ("closing", "ts_procedure_end", "ts_patient_leaves_or"),
    )
    day = F.col("date").cast("timestamp_ntz")
    bars = F.array(*[
        F.struct(
            F.lit(name).alias("phase"),
            minutes_between(day, F.col(start), "micro").alias("start_min"),
            minutes_between(day, F.col(end), "micro").alias("end_min"),
        )
        for name, start, end in phases
    ])
    kept = [c for c in ("day_type", *DAY, "position", "case_id") if c in cases.columns]
    return cases.select(*kept, F.inline(bars)).where(F.col("end_min") > F.col("start_min"))


def waiting_impact(valid: DataFrame, working_days: int = 500) -> DataFrame:
    """Waiting caused by late starts, and what a right prep allocation would take off.

    ``working_days`` is what the log spans; the default is two years of 250.
    """
    delay = F.col("start_delay_min")
    totals = valid.agg(
        F.count(delay).alias("n_cases"),
        share(delay > 0).alias("pct_late"),
        share(delay > 15).alias("pct_late_15"),
        share(delay > 30).alias("pct_late_30"),
        F.avg(delay).alias("mean_delay"),
        F.median(delay).alias("median_delay"),
        F.avg("prep_gap_min").alias("mean_prep_gap"),
        (F.sum(F.when(delay > 0, delay)) / 60.0).alias("wait_hours"),
    )
    hours = F.col("mean_prep_gap") * F.col("n_cases") / 60.0
    return totals.withColumns({
        "corrected_mean_delay": F.col("mean_delay") - F.col("mean_prep_gap"),
        "correctable_hours": hours,
        "correctable_hours_per_day": hours / float(working_days),
    })


def waiting_distribution(valid: DataFrame, bins: int = 60) -> DataFrame:
    """Histogram of the delay now and after taking off the mean prep gap."""
    counts = (
        valid.where(F.col("start_delay_min").isNotNull())
        .groupBy(F.col("start_delay_min").cast("double").alias("current"))
        .agg(F.count("*").alias("_n"), F.sum("prep_gap_min").alias("_gap"), F.count("prep_gap_min").alias("_gaps"))
    )
    # One row per minute of delay; see the distribution operators.
    everything = Window.partitionBy()
    gap = F.sum("_gap").over(everything) / F.sum("_gaps").over(everything)
    both = counts.select("_n", "current", (F.col("current") - gap).alias("corrected"))
    long = both.unpivot(["_n"], ["current", "corrected"], "series", "_value")
    return bins_of_range(long.where(within(F.col("_value"), (-30, 120))), bins, keys=["series"])


# Result label -> column of the per-procedure table.
SCHEDULE_PREDICTORS = {
    "staff count": "mean_staff",
    "equipment count": "mean_resources",
    "pct anesthesia": "pct_anesthesia",
    "pct first of day": "pct_first_of_day",
    "pct last of day": "pct_last_of_day",
}
MORE_PREDICTORS = {
    **SCHEDULE_PREDICTORS,
    "procedure code": "procedure_code",
    "mean age": "mean_age",
    "mean position": "mean_position",
    "mean cases that day": "mean_total_cases",
}


def procedure_profile(placed: DataFrame, min_cases: int = MIN_CASES) -> DataFrame:
    return (
        placed.groupBy("procedure_name")
        .agg(
            F.count("*").alias("n"),
            F.avg("prep_gap_min").alias("mean_prep_gap"),
            F.avg("actual_prep_min").alias("mean_actual_prep"),
            F.avg("planned_prep_min").alias("mean_planned_prep"),
            F.avg("staff_count").alias("mean_staff"),
            F.avg("resource_count").alias("mean_resources"),
            F.avg(F.col("has_anesthesia").cast("double")).alias("pct_anesthesia"),
            F.avg("patient_age").alias("mean_age"),
            F.avg(F.col("is_first_of_day").cast("double")).alias("pct_first_of_day"),
            F.avg(F.col("is_last_of_day").cast("double")).alias("pct_last_of_day"),
            F.avg("position").alias("mean_position"),
            F.avg("total_cases_that_day").alias("mean_total_cases"),
        )
        .where(F.col("n") >= min_cases)
    )


def scheduling_signal_table(
    placed: DataFrame, wide: bool = False, min_cases: int = MIN_CASES
) -> DataFrame:
    """What is known at planning time against actual and planned prep.

    ``wide`` adds age, mean place, day size and the code of the procedure.
    """
    profile = procedure_profile(placed, min_cases)
    if wide:
        named = profile.where(F.col("procedure_name").isNotNull())
        codes = number_rows(named.select("procedure_name"), "procedure_name", "procedure_code")
        profile = attach(profile, codes, ["procedure_name"])
    table = correlation_table(
        profile,
        MORE_PREDICTORS if wide else SCHEDULE_PREDICTORS,
        {"r_actual": "mean_actual_prep", "r_planned": "mean_planned_prep"},
        min_spread=None if wide else 0.01,
    )
    return table.withColumn("schedule_gap", F.col("r_actual") - F.col("r_planned"))
