"""Durations, delays and gaps of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import flag_count, minutes_between

# measure -> (from, to)
SPANS = {
    "planned_prep_min": ("ts_or_prep_planned_start", "ts_patient_in_or_planned"),
    "actual_prep_min": ("ts_or_prep_start", "ts_patient_in_or"),
    "start_delay_min": ("ts_patient_in_or_planned", "ts_patient_in_or"),
    "patient_prep_min": ("ts_patient_in_or", "ts_procedure_start"),
    "procedure_min": ("ts_procedure_start", "ts_procedure_end"),
    "post_procedure_min": ("ts_procedure_end", "ts_patient_leaves_or"),
    "actual_inor_min": ("ts_patient_in_or", "ts_patient_leaves_or"),
    "planned_inor_min": ("ts_patient_in_or_planned", "ts_patient_leaves_or_planned"),
    "room_overrun_min": ("ts_patient_leaves_or_planned", "ts_patient_leaves_or"),
    "procedure_overrun_min": ("ts_patient_leaves_or_planned", "ts_procedure_end"),
    "planned_cleaning_min": ("ts_patient_leaves_or_planned", "ts_or_cleaned_planned"),
    "actual_cleaning_min": ("ts_or_cleaning_start", "ts_or_cleaned"),
    "anesthesia_ready_min": ("ts_anesthesia_start", "ts_anesthesia_ready"),
    "ready_to_knife_min": ("ts_anesthesia_ready", "ts_procedure_start"),
}

# measure -> (actual, planned)
GAPS = {
    "prep_gap_min": ("actual_prep_min", "planned_prep_min"),
    "inor_gap_min": ("actual_inor_min", "planned_inor_min"),
}


def measure(name: str, unit: str = "minute", negative: str = "keep") -> Column:
    """The column expression of one measure over the log's stamps.

    ``negative='null'`` drops negative durations; signed measures (delays,
    overruns, gaps) always keep their sign.
    """
    if name in GAPS:
        actual, planned = (measure(part, unit, negative) for part in GAPS[name])
        return actual - planned
    signed = name.endswith(("_delay_min", "_overrun_min"))
    start, end = SPANS[name]
    return minutes_between(F.col(start), F.col(end), unit, "keep" if signed else negative)


def with_measures(df: DataFrame, *names: str, unit: str = "minute", negative: str = "keep") -> DataFrame:
    """``df`` with the named measures; also takes ``staff_count``,
    ``resource_count`` and ``has_anesthesia``."""
    special = {
        "staff_count": lambda: flag_count(df, "staff_"),
        "resource_count": lambda: flag_count(df, "resource_"),
        "has_anesthesia": lambda: F.col("ts_anesthesia_start").isNotNull(),
    }
    return df.withColumns(
        {n: special[n]() if n in special else measure(n, unit, negative) for n in names}
    )
