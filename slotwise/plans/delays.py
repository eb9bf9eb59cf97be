"""Start delays: by place in the day, by reason, by allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import (
    DELAY_LABELS,
    PREP_LABELS,
    bucket_label,
    delay_bucket,
    measure,
    pearson,
    position_label,
    prep_bucket,
    share,
    with_measures,
)
from slotwise.operators import DAY, best_in_group, distribution, sequence_days, top


def _delay() -> Column:
    return F.col("delay_minutes")


def _timed(cases: DataFrame) -> DataFrame:
    return cases.dropna(subset=["ts_patient_in_or_planned", "ts_patient_in_or", "delay_minutes"])


def case_positions(
    cases: DataFrame, rank_on: str = "filtered", hot: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Place of each timed case in its room-day, and how many there are.

    ``rank_on='all'`` counts places over every planned case of the day instead of
    the timed ones only. ``keep`` names more columns to carry along.
    """
    needed = ("row_seq", "case_id", *DAY, "ts_patient_in_or_planned", "ts_patient_in_or", "delay_minutes")
    narrow = cases.select(*dict.fromkeys([*needed, *keep]))
    steps = sequence_days(
        narrow if rank_on == "all" else _timed(narrow), "ts_patient_in_or_planned",
        position="case_position", size="cases_in_day", hot=hot,
    )
    return steps if rank_on == "filtered" else _timed(steps)


def delay_by_position(cases: DataFrame, rank_on: str = "filtered", hot: DataFrame | None = None) -> DataFrame:
    return (
        case_positions(cases, rank_on, hot)
        .groupBy(position_label(F.col("case_position")).alias("position_label"))
        .agg(
            F.avg(_delay()).alias("mean_delay"),
            F.median(_delay()).alias("median_delay"),
            share(_delay() > 0).alias("pct_delayed"),
            F.count("*").alias("n_cases"),
        )
    )


def day_ends(cases: DataFrame) -> DataFrame:
    """First, last and later delays per room-day.

    Only the ends and a sum are needed, so this is one aggregate with partial
    results per task; no room-day is sorted.
    """
    step = F.struct("ts_patient_in_or_planned", "row_seq")
    return (
        _timed(cases)
        .dropna(subset=list(DAY))
        .groupBy(*DAY)
        .agg(
            F.count("*").alias("n_cases"),
            F.sum(_delay()).alias("_sum"),
            F.min_by("delay_minutes", step).alias("first_delay"),
            F.max_by("delay_minutes", step).alias("last_delay"),
        )
        .withColumn(
            "mean_later_delay",
            F.try_divide(F.col("_sum") - F.col("first_delay"), F.col("n_cases") - 1),
        )
        .drop("_sum")
    )


def cascade_correlation(cases: DataFrame, min_later: int = 2) -> DataFrame:
    """Does a late first case go with late later cases?"""
    first, later = F.col("first_delay"), F.col("mean_later_delay")
    return day_ends(cases).where(F.col("n_cases") - 1 >= min_later).agg(
        F.count("*").alias("n_days"),
        pearson(first, later).alias("r"),
        share(later > first).alias("pct_later_worse"),
    )


def worst_cascade_days(cases: DataFrame, k: int = 10, min_cases: int = 3) -> DataFrame:
    days = day_ends(cases).where(F.col("n_cases") >= min_cases).drop("mean_later_delay")
    days = days.withColumn("cascade_gap", F.col("last_delay") - F.col("first_delay"))
    return top(days, k, "cascade_gap", "date", "or_room")


def _reasoned(cases: DataFrame) -> DataFrame:
    return cases.where((_delay() > 0) & F.col("delay_reason").isNotNull())


def _by_reason(cases: DataFrame, *keys: str) -> DataFrame:
    return _reasoned(cases).groupBy(*keys, "delay_reason").agg(
        F.count("*").alias("n_cases"),
        F.avg(_delay()).alias("mean_delay"),
        (F.sum(_delay()) / 60.0).alias("hours_lost"),
    )


def top_delay_reasons(cases: DataFrame, k: int = 15) -> DataFrame:
    reasons = _by_reason(cases)
    # The total reads every column of the table above, so both use one shuffle.
    sums = F.struct(*[F.sum(c).alias(c) for c in ("n_cases", "mean_delay", "hours_lost")])
    total = reasons.agg(sums).scalar()["n_cases"]
    return top(reasons, k, "n_cases", "delay_reason").withColumn(
        "pct_of_delayed", F.col("n_cases") * 100.0 / total
    )


def top_reason_per_specialty(cases: DataFrame) -> DataFrame:
    reasons = _by_reason(cases, "specialty").drop("hours_lost")
    return best_in_group(reasons, ["specialty"], F.col("n_cases"), "delay_reason")


def time_lost_by_reason(cases: DataFrame, k: int = 10) -> DataFrame:
    return top(_by_reason(cases), k, "hours_lost", "delay_reason")


def bucket_report(rows: DataFrame, value: str, **extra) -> DataFrame:
    """Mean of ``value`` per class of planned prep, with each class's share of all
    rows. All classes come from one aggregate."""
    known = rows.dropna(subset=["planned_prep_min", value])
    # At most five rows reach this window, one per class and one for no class.
    total = F.sum("n").over(Window.partitionBy())
    return (
        known.groupBy(prep_bucket(F.col("planned_prep_min")).alias("bucket"))
        .agg(F.count("*").alias("n"), F.avg(value).alias(f"mean_{value}"),
             *[c.alias(name) for name, c in extra.items()])
        .withColumn("pct_of_total", F.col("n") * 100.0 / total)
        .where(F.col("bucket").isNotNull())
        .withColumn("label", bucket_label(F.col("bucket"), PREP_LABELS))
    )


def delay_by_prep_bucket(cases: DataFrame) -> DataFrame:
    rows = with_measures(cases, "planned_prep_min", "start_delay_min", unit="second")
    return bucket_report(rows, "start_delay_min")


def prep_bucket_profile(cases: DataFrame) -> DataFrame:
    rows = with_measures(cases, "planned_prep_min", "start_delay_min", unit="second")
    delay = F.col("start_delay_min")
    return bucket_report(
        rows, "start_delay_min", pct_late=share(delay > 0), pct_late_15=share(delay > 15)
    )


def overrun_by_prep_bucket(cases: DataFrame) -> DataFrame:
    rows = with_measures(cases, "planned_prep_min", "procedure_overrun_min", unit="second")
    return bucket_report(rows, "procedure_overrun_min")


def delay_amplification(cases: DataFrame) -> DataFrame:
    """Do cases without planned prep end even later than they start?"""
    rows = with_measures(cases, "planned_prep_min", "start_delay_min", "room_overrun_min")
    return rows.where(F.col("planned_prep_min") == 0).agg(
        F.count("*").alias("n"),
        F.avg("start_delay_min").alias("mean_start_delay"),
        F.avg("room_overrun_min").alias("mean_finish_overrun"),
        F.avg(F.col("room_overrun_min") - F.col("start_delay_min")).alias("mean_growth"),
    )


def two_failures(cases: DataFrame) -> DataFrame:
    """Late starts and long stays, side by side and together."""
    rows = with_measures(cases, "start_delay_min", "inor_gap_min", "room_overrun_min")
    delay, gap, late_end = (F.col(c) for c in ("start_delay_min", "inor_gap_min", "room_overrun_min"))
    return rows.agg(
        F.count("*").alias("n_cases"),
        share(delay > 0).alias("pct_late"),
        share(delay > 15).alias("pct_late_15"),
        F.avg(delay).alias("mean_start_delay"),
        share(gap > 0).alias("pct_over"),
        share(gap > 15).alias("pct_over_15"),
        F.avg(gap).alias("mean_duration_gap"),
        share(late_end > 0).alias("pct_finish_late"),
        F.avg(late_end).alias("mean_finish_overrun"),
    )


def failure_distributions(cases: DataFrame, method: str = "nearest") -> DataFrame:
    """Spread of delay, duration gap and both in-room times, one row each."""
    names = ["start_delay_min", "inor_gap_min", "actual_inor_min", "planned_inor_min"]
    long = with_measures(cases, *names).select(*names).unpivot([], names, "series", "minutes")
    return distribution(long, "minutes", {"p25": 0.25, "p75": 0.75, "p90": 0.9}, ["series"], method)


def hours_lost_by_specialty(cases: DataFrame) -> DataFrame:
    rows = with_measures(cases, "start_delay_min", "inor_gap_min")
    delay, gap = F.col("start_delay_min"), F.col("inor_gap_min")
    return rows.groupBy("specialty").agg(
        F.count("*").alias("n_cases"),
        share(delay > 0).alias("pct_late"),
        share(gap > 0).alias("pct_over"),
        (F.sum(F.greatest(delay, F.lit(0))) / 60.0).alias("hours_late"),
        (F.sum(F.greatest(gap, F.lit(0))) / 60.0).alias("hours_over"),
    )


def gap_by_delay_bucket(cases: DataFrame) -> DataFrame:
    rows = with_measures(cases, "start_delay_min", "inor_gap_min")
    rows = rows.dropna(subset=["start_delay_min", "inor_gap_min"])
    return (
        rows.groupBy(delay_bucket(F.col("start_delay_min")).alias("bucket"))
        .agg(
            F.count("*").alias("n"),
            share(F.col("inor_gap_min") > 0).alias("pct_over"),
            F.avg("inor_gap_min").alias("mean_duration_gap"),
        )
        .withColumn("label", bucket_label(F.col("bucket"), DELAY_LABELS))
    )


def delay_gap_independence(cases: DataFrame) -> DataFrame:
    delay, gap = measure("start_delay_min"), measure("inor_gap_min")
    return cases.agg(pearson(delay, gap).alias("r_delay_duration_gap"))
