"""Patient prep, the prep gap and what staff and equipment say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotwise.functions import (
    clean_procedure_name,
    pearson,
    share,
    with_measures,
    within,
    within_abs,
)
from slotwise.operators import correlation_table, distribution, signal_capture, top

PREP_BOUNDS = (0, 240)
COMPLEXITY = {"staff_count": "mean_staff", "resource_count": "mean_resources"}


def prepared_patients(cases: DataFrame, *more: str) -> DataFrame:
    """Cases with a plausible patient prep time."""
    rows = with_measures(cases, "patient_prep_min", "has_anesthesia", *more)
    return rows.where(within(F.col("patient_prep_min"), PREP_BOUNDS))


def patient_prep_distribution(cases: DataFrame, method: str = "nearest") -> DataFrame:
    quantiles = {"p25": 0.25, "p75": 0.75, "p90": 0.9}
    return distribution(prepared_patients(cases), "patient_prep_min", quantiles, method=method)


def patient_prep_by_anesthesia(cases: DataFrame) -> DataFrame:
    return prepared_patients(cases, "actual_inor_min").groupBy("has_anesthesia").agg(
        F.avg("patient_prep_min").alias("mean_prep"),
        F.median("patient_prep_min").alias("median_prep"),
        F.avg("actual_inor_min").alias("mean_inor"),
        F.count("*").alias("n_cases"),
    )


def patient_prep_by_specialty(cases: DataFrame, min_cases: int = 100) -> DataFrame:
    return (
        prepared_patients(cases, "staff_count", "resource_count")
        .groupBy("specialty")
        .agg(
            F.avg("patient_prep_min").alias("mean_prep"),
            F.median("patient_prep_min").alias("median_prep"),
            F.avg("staff_count").alias("mean_staff"),
            F.avg("resource_count").alias("mean_resources"),
            F.count("*").alias("n_cases"),
        )
        .where(F.col("n_cases") >= min_cases)
    )


def by_procedure(rows: DataFrame, means: dict[str, str], min_cases: int, key: str = "procedure_text_id") -> DataFrame:
    """Means per procedure of at least ``min_cases`` rows; ``means`` maps result to
    source column."""
    return (
        rows.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"), *[F.avg(c).alias(name) for name, c in means.items()])
        .where(F.col("n") >= min_cases)
    )


def prep_complexity_correlation(cases: DataFrame, min_cases: int = 50) -> DataFrame:
    rows = prepared_patients(cases, "planned_inor_min", "staff_count", "resource_count")
    rows = rows.where(within(F.col("planned_inor_min"), (0, 600)))
    procedures = by_procedure(
        rows,
        {"mean_prep": "patient_prep_min", "mean_planned": "planned_inor_min",
         "mean_staff": "staff_count", "mean_resources": "resource_count"},
        min_cases,
    )
    return correlation_table(
        procedures, COMPLEXITY, {"r_actual_prep": "mean_prep", "r_planned_inor": "mean_planned"}
    )


def gap_rows(
    rows: DataFrame, *, clip: float = 300, unit: str = "minute", negative: str = "keep", clean: bool = False
) -> DataFrame:
    """Rows with both gaps known and inside the clip, with ``procedure``.

    Give deduplicated cases, or the raw log to weigh a case by its procedures.
    ``clean`` groups by procedure text without its code.
    """
    text = F.col("procedure_text_id")
    return with_measures(
        rows, "planned_prep_min", "prep_gap_min", "inor_gap_min", "staff_count", "resource_count",
        unit=unit, negative=negative,
    ).where(within_abs(F.col("prep_gap_min"), clip) & within_abs(F.col("inor_gap_min"), clip)).withColumn(
        "procedure", clean_procedure_name(text) if clean else text
    )


def _worse(prep: Column, inor: Column, compare: str) -> Column:
    return F.abs(prep) > F.abs(inor) if compare == "absolute" else prep > inor


def prep_vs_inor_gap(gaps: DataFrame, min_cases: int = 50, compare: str = "signed") -> DataFrame:
    """Where plans go wrong: before the patient enters or after. Means over all
    rows, and over the means of frequent procedures."""
    procedures = gaps.groupBy("procedure").agg(
        F.count("*").alias("_n"),
        F.sum("prep_gap_min").alias("_prep"),
        F.sum("inor_gap_min").alias("_inor"),
    )
    frequent = (F.col("_n") >= min_cases) & F.col("procedure").isNotNull()
    prep, inor = F.col("_prep") / F.col("_n"), F.col("_inor") / F.col("_n")
    return procedures.agg(
        F.sum("_n").alias("n_rows"),
        (F.sum("_prep") / F.sum("_n")).alias("mean_prep_gap"),
        (F.sum("_inor") / F.sum("_n")).alias("mean_inor_gap"),
        F.count_if(frequent).alias("n_procedures"),
        share(F.when(frequent, _worse(prep, inor, compare))).alias("pct_prep_worse"),
        F.avg(F.when(frequent, prep)).alias("procedure_prep_gap"),
        F.avg(F.when(frequent, inor)).alias("procedure_inor_gap"),
    )


def gap_by_procedure(gaps: DataFrame, min_cases: int = 50) -> DataFrame:
    return by_procedure(
        gaps,
        {"mean_prep_gap": "prep_gap_min", "mean_inor_gap": "inor_gap_min",
         "mean_planned_prep": "planned_prep_min", "mean_staff": "staff_count",
         "mean_resources": "resource_count"},
        min_cases,
        "procedure",
    )


def gap_complexity_signal(gaps: DataFrame, min_cases: int = 50) -> DataFrame:
    """Does complexity drive the gap, and does the plan know it?"""
    return correlation_table(
        gap_by_procedure(gaps, min_cases), COMPLEXITY,
        {"r_actual": "mean_prep_gap", "r_planned": "mean_planned_prep"},
    )


def gap_signal_capture(gaps: DataFrame, min_cases: int = 50) -> DataFrame:
    return signal_capture(gap_complexity_signal(gaps, min_cases), "r_planned", "r_actual")


def gap_signal_long(gaps: DataFrame, min_cases: int = 50) -> DataFrame:
    """The signal table with one row per factor and metric, as a bar chart takes it."""
    table = gap_complexity_signal(gaps, min_cases)
    return table.unpivot(["predictor"], ["r_actual", "r_planned"], "metric", "r")


def worst_prep_gap(gaps: DataFrame, k: int = 10, min_cases: int = 50) -> DataFrame:
    table = gap_by_procedure(gaps, min_cases).drop("mean_planned_prep")
    return top(table, k, "mean_prep_gap", "procedure")


def gap_independence(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        pearson(F.col("prep_gap_min"), F.col("inor_gap_min")).alias("r"), F.count("*").alias("n")
    )
