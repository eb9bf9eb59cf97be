"""Checks of the log itself: inventory, coverage, stamp quality, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import measure, minutes_between, pearson, share, with_measures, within
from slotwise.operators import first_rows, group_fit

from .surgical import clean_stamps


def case_inventory(log: DataFrame) -> DataFrame:
    raw = log.agg(F.count("*")).scalar()
    return first_rows(log).agg(
        F.count("*").alias("n_cases"),
        F.countDistinct("specialty").alias("n_specialties"),
        F.countDistinct("or_room").alias("n_rooms"),
        F.countDistinct("procedure_text_id").alias("n_procedures"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        share(F.col("is_acute")).alias("pct_acute"),
    ).withColumn("n_rows", raw)


def overtime_identity(cases: DataFrame) -> DataFrame:
    """Is logged overtime always start delay plus duration gap?"""
    off = F.col("overtime_minutes") - measure("start_delay_min") - measure("inor_gap_min")
    return cases.agg(
        F.count("*").alias("n_cases"),
        F.count(off).alias("n_known"),
        F.count_if(off != 0).alias("n_differ"),
        F.max(F.abs(off)).alias("max_difference"),
    )


def metric_identity(cases: DataFrame) -> DataFrame:
    """Logged delay and overtime against the same figures from the stamps."""
    return cases.agg(
        pearson(F.col("delay_minutes"), measure("start_delay_min")).alias("r_delay"),
        share(F.col("delay_minutes") == measure("start_delay_min")).alias("pct_delay_equal"),
        pearson(F.col("overtime_minutes"), measure("room_overrun_min")).alias("r_overtime"),
        share(F.col("overtime_minutes") == measure("room_overrun_min")).alias("pct_overtime_equal"),
    )


STAMP_PAIRS = (
    ("room prep", "ts_or_prep_start", "ts_or_prep_done"),
    ("cleaning", "ts_or_cleaning_start", "ts_or_cleaned"),
    ("patient prep", "ts_patient_in_or", "ts_procedure_start"),
)


def same_click_audit(cases: DataFrame) -> DataFrame:
    """Stamp pairs taken in one click, and what is left to use."""
    sums = []
    for i, (_, start, end) in enumerate(STAMP_PAIRS):
        differ = F.col(start) != F.col(end)
        sums += [F.count(differ).alias(f"_known{i}"), F.count_if(differ).alias(f"_usable{i}")]
    totals = cases.agg(F.count("*").alias("n_cases"), *sums)
    lines = [
        F.struct(
            F.lit(name).alias("pair"),
            F.col(f"_known{i}").alias("n_known"),
            F.try_divide((F.col(f"_known{i}") - F.col(f"_usable{i}")) * 100.0, F.col(f"_known{i}")).alias("same_click_pct"),
            F.col(f"_usable{i}").alias("n_usable"),
            F.try_divide(F.col(f"_usable{i}") * 100.0, F.col("n_cases")).alias("usable_pct"),
        )
        for i, (name, _, _) in enumerate(STAMP_PAIRS)
    ]
    return totals.select(F.inline(F.array(*lines)))


def measure_coverage(cases: DataFrame) -> DataFrame:
    """Share of cases for which each window is known."""
    names = ("planned_prep_min", "start_delay_min", "patient_prep_min", "actual_prep_min", "actual_cleaning_min")
    known = cases.agg(*[share(measure(n).isNotNull()).alias(n) for n in names])
    return known.unpivot([], list(names), "measure", "coverage_pct")


def clean_subset_bias(cases: DataFrame) -> DataFrame:
    """Is the subset with separate room prep stamps like all cases?"""
    clean = F.coalesce(clean_stamps(), F.lit(False))
    anesthesia = F.col("ts_anesthesia_start").isNotNull()
    ahead = minutes_between(F.col("ts_or_prep_start"), F.col("ts_or_prep_planned_start"))
    return cases.agg(
        F.count("*").alias("n_cases"),
        F.count_if(clean).alias("n_clean"),
        share(anesthesia).alias("anesthesia_pct_all"),
        share(F.when(clean, anesthesia)).alias("anesthesia_pct_clean"),
        share(F.when(clean, ahead > 0)).alias("early_prep_pct_clean"),
        F.avg(F.when(clean, ahead)).alias("mean_minutes_ahead_clean"),
    )


def zero_prep_by_group(cases: DataFrame, key: str) -> DataFrame:
    """How often no prep is planned, by acute flag or by specialty."""
    rows = with_measures(cases, "planned_prep_min", "start_delay_min")
    return rows.groupBy(key).agg(
        F.count("planned_prep_min").alias("n"),
        share(F.col("planned_prep_min") == 0).alias("zero_prep_pct"),
        F.avg("start_delay_min").alias("mean_start_delay"),
    )


def anesthesia_subphases(cases: DataFrame) -> DataFrame:
    ready, knife = measure("anesthesia_ready_min"), measure("ready_to_knife_min")
    return cases.agg(
        F.count(ready).alias("n_ready"), F.avg(ready).alias("mean_start_to_ready"),
        F.count(knife).alias("n_knife"), F.avg(knife).alias("mean_ready_to_knife"),
    )


def room_prep_vs_delay(cases: DataFrame) -> DataFrame:
    clean = cases.where(clean_stamps())
    return clean.agg(
        pearson(measure("actual_prep_min"), measure("start_delay_min")).alias("r"),
        F.count(measure("actual_prep_min")).alias("n"),
    )


def lookup_fit_by_target(cases: DataFrame) -> DataFrame:
    """How well specialty and anesthesia explain room prep and patient prep."""
    rows = with_measures(cases, "actual_prep_min", "patient_prep_min", "has_anesthesia")
    keys = ["specialty", "has_anesthesia"]
    # Both targets of a row side by side, so that the cases are made and read once.
    targets = {"room prep": F.when(clean_stamps(), F.col("actual_prep_min")),
               "patient prep": F.when(within(F.col("patient_prep_min"), (0, 240)), F.col("patient_prep_min"))}
    pairs = F.array(*[F.struct(F.lit(name).alias("target"), y.cast("double").alias("minutes")) for name, y in targets.items()])
    long = rows.where(F.col("specialty").isNotNull()).select(*keys, F.inline(pairs))
    return group_fit(long, keys, "minutes", by=["target"])
