"""Time between consecutive cases of a room: turnaround, idle time, buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import (
    BUFFER_LABELS,
    bucket_label,
    buffer_bucket,
    minutes_between,
    pearson,
    share,
    with_measures,
    within,
)
from slotwise.operators import (
    box_stats, distribution, histogram, merged_sketches, quantile_sketches, sequence_days, sketch_quantiles,
)
from slotwise.operators.sketches import SIZE

QUARTILES = {"p25": 0.25, "p75": 0.75, "p90": 0.9}


def _span(start: str, end: str):
    return minutes_between(F.col(start), F.col(end))


def turnaround_pairs(cases: DataFrame, limit: int = 180, hot: DataFrame | None = None) -> DataFrame:
    """Each case with the one before it in its room-day, by actual entry, and the
    parts of the time between them."""
    moved = cases.dropna(subset=["ts_patient_leaves_or", "ts_patient_in_or"]).select(
        "row_seq", "case_id", "or_room", "date", "specialty", "ts_patient_in_or", "ts_patient_leaves_or",
        "ts_or_cleaning_start", "ts_or_cleaned", "ts_or_prep_start", "ts_or_prep_done",
    )
    pairs = sequence_days(
        moved,
        "ts_patient_in_or",
        previous={
            "prev_leaves_or": "ts_patient_leaves_or",
            "prev_cleaning_start": "ts_or_cleaning_start",
            "prev_cleaned": "ts_or_cleaned",
        },
        hot=hot,
    )
    return pairs.select(
        "case_id", "or_room", "date", "specialty", "prev_cleaned",
        "ts_or_prep_start", "ts_or_prep_done", "ts_patient_in_or",
        _span("prev_leaves_or", "ts_patient_in_or").alias("turnaround_min"),
        _span("prev_leaves_or", "prev_cleaning_start").alias("wait_before_cleaning_min"),
        _span("prev_cleaning_start", "prev_cleaned").alias("cleaning_min"),
        _span("prev_cleaned", "ts_patient_in_or").alias("post_cleaning_gap_min"),
    ).where(within(F.col("turnaround_min"), (0, limit)))


def turnaround_distribution(pairs: DataFrame, method: str = "nearest") -> DataFrame:
    return distribution(pairs, "turnaround_min", QUARTILES, method=method)


def turnaround_sketches(pairs: DataFrame, size: int = SIZE) -> DataFrame:
    """A quantile sketch of turnaround per specialty and day, to be stored and merged over any days."""
    return quantile_sketches(pairs, "turnaround_min", ["specialty", "date"], size)


def sketched_turnaround(sketches: DataFrame, size: int = SIZE) -> DataFrame:
    """Turnaround per specialty from the sketches of its days; exact up to ``size`` pairs, then within ``rank_error``."""
    return sketch_quantiles(merged_sketches(sketches, ["specialty"], size), {**QUARTILES, "median": 0.5}, ["specialty"])


def turnaround_components(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.avg("wait_before_cleaning_min").alias("mean_wait_before_cleaning"),
        F.avg("cleaning_min").alias("mean_cleaning"),
        F.avg("post_cleaning_gap_min").alias("mean_post_cleaning_gap"),
        share(F.col("wait_before_cleaning_min").isNotNull()).alias("cleaning_coverage_pct"),
    )


def turnaround_by_specialty(pairs: DataFrame, min_pairs: int = 50) -> DataFrame:
    return (
        pairs.groupBy("specialty")
        .agg(
            F.avg("turnaround_min").alias("mean_turnaround"),
            F.median("turnaround_min").alias("median_turnaround"),
            F.avg("post_cleaning_gap_min").alias("mean_post_cleaning_gap"),
            F.count("*").alias("n_pairs"),
        )
        .where(F.col("n_pairs") >= min_pairs)
    )


def idle_pairs(pairs: DataFrame) -> DataFrame:
    """The gap after cleaning, split at the start and end of room prep; pairs with
    an implausible part are left out."""
    return pairs.select(
        "case_id", "or_room", "date", "specialty", "turnaround_min",
        _span("prev_cleaned", "ts_or_prep_start").alias("gap_before_prep_min"),
        _span("ts_or_prep_start", "ts_or_prep_done").alias("room_prep_min"),
        _span("ts_or_prep_done", "ts_patient_in_or").alias("gap_after_prep_min"),
    ).where(
        within(F.col("gap_before_prep_min"), (-5, 120))
        & within(F.col("room_prep_min"), (0, 120))
        & within(F.col("gap_after_prep_min"), (-5, 120))
    )


def _idle_means() -> list[Column]:
    return [
        F.avg("gap_before_prep_min").alias("mean_gap_before_prep"),
        F.avg("room_prep_min").alias("mean_room_prep"),
        F.avg("gap_after_prep_min").alias("mean_gap_after_prep"),
        F.avg(F.col("gap_before_prep_min") + F.col("gap_after_prep_min")).alias("mean_wasted"),
        F.avg("turnaround_min").alias("mean_turnaround"),
        F.count("*").alias("n_pairs"),
    ]


def idle_breakdown(pairs: DataFrame) -> DataFrame:
    return idle_pairs(pairs).agg(*_idle_means())


def idle_by_specialty(pairs: DataFrame, min_pairs: int = 30) -> DataFrame:
    return idle_pairs(pairs).groupBy("specialty").agg(*_idle_means()).where(F.col("n_pairs") >= min_pairs)


def turnaround_histogram(pairs: DataFrame, bins: int = 60) -> DataFrame:
    return histogram(pairs, "turnaround_min", bins=bins)


def turnaround_boxes(pairs: DataFrame, min_pairs: int = 50) -> DataFrame:
    return box_stats(pairs, "turnaround_min", "specialty", min_pairs)


def overtime_by_specialty(cases: DataFrame, min_cases: int = 50) -> DataFrame:
    over = F.col("overtime_minutes")
    return (
        cases.dropna(subset=["overtime_minutes", "ts_procedure_start", "ts_procedure_end"])
        .groupBy("specialty")
        .agg(
            F.avg(over).alias("mean_overtime"),
            F.median(over).alias("median_overtime"),
            share(over > 0).alias("pct_over"),
            share(over < 0).alias("pct_under"),
            F.count("*").alias("n_cases"),
        )
        .where(F.col("n_cases") >= min_cases)
    )


def cleaning_coverage(cases: DataFrame, name: str) -> DataFrame:
    """How often a cleaning time is known, and how often it is zero."""
    rows = with_measures(cases, name)
    zero = F.col(name) == 0
    return rows.agg(
        F.count("*").alias("n_cases"),
        F.count(name).alias("n_known"),
        share(F.col(name).isNotNull()).alias("coverage_pct"),
        F.count_if(zero).alias("n_zero"),
        share(zero).alias("zero_pct"),
    )


def planned_cleaning_distribution(cases: DataFrame, method: str = "nearest") -> DataFrame:
    rows = with_measures(cases, "planned_cleaning_min").where(F.col("planned_cleaning_min") > 0)
    return distribution(rows, "planned_cleaning_min", {"p75": 0.75}, method=method)


def actual_cleaning_distribution(cases: DataFrame, method: str = "nearest") -> DataFrame:
    rows = with_measures(cases, "actual_cleaning_min")
    rows = rows.where(within(F.col("actual_cleaning_min"), (1, 120)))
    return distribution(rows, "actual_cleaning_min", QUARTILES, method=method)


def buffer_pairs(cases: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Each case with the one before it by plan: planned buffer, real turnaround,
    entry delay."""
    stamps = ["ts_patient_in_or_planned", "ts_patient_leaves_or_planned", "ts_patient_in_or", "ts_patient_leaves_or"]
    known = cases.dropna(subset=stamps).select("row_seq", "case_id", "or_room", "date", "specialty", *stamps)
    pairs = sequence_days(
        known,
        "ts_patient_in_or_planned",
        previous={
            "prev_leaves_planned": "ts_patient_leaves_or_planned",
            "prev_leaves": "ts_patient_leaves_or",
        },
        hot=hot,
    )
    return pairs.select(
        "case_id", "or_room", "date", "specialty",
        _span("prev_leaves_planned", "ts_patient_in_or_planned").alias("planned_buffer_min"),
        _span("prev_leaves", "ts_patient_in_or").alias("turnaround_min"),
        _span("ts_patient_in_or_planned", "ts_patient_in_or").alias("entry_delay_min"),
    ).where(
        within(F.col("planned_buffer_min"), (0, 120)) & within(F.col("turnaround_min"), (0, 180))
    )


def buffer_summary(pairs: DataFrame) -> DataFrame:
    zero = F.col("planned_buffer_min") == 0
    return pairs.agg(
        F.count("*").alias("n_pairs"),
        F.count_if(zero).alias("n_zero_buffer"),
        share(zero).alias("zero_buffer_pct"),
        F.avg("planned_buffer_min").alias("mean_buffer"),
        F.median("planned_buffer_min").alias("median_buffer"),
        F.avg("turnaround_min").alias("mean_turnaround"),
        F.median("turnaround_min").alias("median_turnaround"),
    )


def _by_buffer(pairs: DataFrame, *aggregates) -> DataFrame:
    return (
        pairs.groupBy(buffer_bucket(F.col("planned_buffer_min")).alias("bucket"))
        .agg(*aggregates, F.count("*").alias("n_pairs"))
        .withColumn("label", bucket_label(F.col("bucket"), BUFFER_LABELS))
    )


def entry_delay_by_buffer(pairs: DataFrame) -> DataFrame:
    return _by_buffer(
        pairs,
        F.avg("entry_delay_min").alias("mean_entry_delay"),
        F.median("entry_delay_min").alias("median_entry_delay"),
        share(F.col("entry_delay_min") > 0).alias("pct_late"),
        F.avg("turnaround_min").alias("mean_turnaround"),
    )


def buffer_delay_correlation(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        pearson(F.col("planned_buffer_min"), F.col("entry_delay_min")).alias("r"),
        F.count("*").alias("n_pairs"),
    )


def _exceeded() -> list[Column]:
    over = F.col("turnaround_min") - F.col("planned_buffer_min")
    return [
        share(over > 0).alias("pct_exceeded"),
        F.avg(F.when(over > 0, over)).alias("mean_overshoot"),
    ]


def buffer_overshoot(pairs: DataFrame) -> DataFrame:
    return pairs.agg(*_exceeded())


def overshoot_by_buffer(pairs: DataFrame) -> DataFrame:
    return _by_buffer(pairs, *_exceeded())
