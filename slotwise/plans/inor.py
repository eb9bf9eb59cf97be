"""Time in the room: its phases, the planned slot, and what predicts it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import share, with_measures, within
from slotwise.operators import correlation_table, group_fit, line_fit
from slotwise.operators.distribution import value_counts

from .prep import COMPLEXITY, by_procedure

PHASES = ("patient_prep_min", "procedure_min", "post_procedure_min")


def phased(cases: DataFrame) -> DataFrame:
    """Cases whose three phases and planned slot are plausible."""
    rows = with_measures(
        cases, *PHASES, "actual_inor_min", "planned_inor_min", "staff_count", "resource_count"
    )
    return rows.where(
        within(F.col("patient_prep_min"), (0, 240))
        & within(F.col("procedure_min"), (0, 600))
        & within(F.col("post_procedure_min"), (0, 240))
        & within(F.col("planned_inor_min"), (0, 600))
    )


def _means() -> list[Column]:
    return [
        F.avg("patient_prep_min").alias("mean_prep"),
        F.avg("procedure_min").alias("mean_procedure"),
        F.avg("post_procedure_min").alias("mean_post"),
        F.avg("actual_inor_min").alias("mean_actual"),
        F.avg("planned_inor_min").alias("mean_planned"),
        F.count("*").alias("n_cases"),
    ]


def _gap() -> Column:
    return F.col("actual_inor_min") - F.col("planned_inor_min")


def inor_breakdown(cases: DataFrame) -> DataFrame:
    return phased(cases).agg(*_means())


def inor_phase_share(cases: DataFrame) -> DataFrame:
    rows = phased(cases).where(F.col("actual_inor_min") > 0)
    return rows.agg(
        *[
            F.avg(F.col(c) * 100.0 / F.col("actual_inor_min")).alias(name)
            for c, name in zip(PHASES, ("prep_pct", "procedure_pct", "post_pct"))
        ]
    )


def slot_overrun(cases: DataFrame) -> DataFrame:
    return phased(cases).agg(
        share(_gap() > 0).alias("pct_over"), F.avg(_gap()).alias("mean_gap"), F.count("*").alias("n_cases")
    )


def phase_complexity(cases: DataFrame, min_cases: int = 50) -> DataFrame:
    procedures = by_procedure(
        phased(cases),
        {"mean_prep": "patient_prep_min", "mean_procedure": "procedure_min",
         "mean_post": "post_procedure_min", "mean_planned": "planned_inor_min",
         "mean_staff": "staff_count", "mean_resources": "resource_count"},
        min_cases,
    )
    return correlation_table(
        procedures, COMPLEXITY,
        {"r_prep": "mean_prep", "r_procedure": "mean_procedure", "r_post": "mean_post",
         "r_planned": "mean_planned"},
    )


def inor_by_specialty(cases: DataFrame, min_cases: int = 100) -> DataFrame:
    return (
        phased(cases).groupBy("specialty")
        .agg(*_means(), F.avg(_gap()).alias("mean_gap"))
        .where(F.col("n_cases") >= min_cases)
    )


def prep_staff_points(cases: DataFrame, min_cases: int = 50) -> DataFrame:
    means = {"mean_prep": "patient_prep_min", "mean_staff": "staff_count"}
    return by_procedure(phased(cases), means, min_cases)


def prep_staff_fit(cases: DataFrame, min_cases: int = 50) -> DataFrame:
    return line_fit(prep_staff_points(cases, min_cases), "mean_staff", "mean_prep")


def duration_lookup(cases: DataFrame, min_cases: int = 50) -> DataFrame:
    """Actual and planned stay per procedure: how much more to plan."""
    rows = with_measures(cases, "actual_inor_min", "planned_inor_min")
    rows = rows.dropna(subset=["actual_inor_min", "planned_inor_min"]).withColumn("_gap", _gap())
    means = {"mean_actual": "actual_inor_min", "mean_planned": "planned_inor_min", "mean_gap": "_gap"}
    return by_procedure(rows, means, min_cases)


FEATURE_SETS = (
    ("procedure_text_id",),
    ("specialty",),
    ("diagnosis_group",),
    ("has_anesthesia",),
    ("specialty", "has_anesthesia"),
    ("procedure_text_id", "specialty"),
)


def feature_r2(cases: DataFrame, y: str = "actual_inor_min", sets: Sequence[Sequence[str]] = FEATURE_SETS) -> DataFrame:
    """Variance that the group means of each feature set explain.

    All sets are grouping sets of one aggregate, so the case table is built and
    read once.
    """
    columns = list(dict.fromkeys(c for s in sets for c in s))
    value = F.col(y).cast("double")
    rows = with_measures(cases, y, "has_anesthesia").where(value.isNotNull())
    groups = rows.select(*columns, value.alias("_v")).groupingSets(
        [[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]
    ).agg(
        F.grouping_id(*columns).alias("_set"),
        F.count("*").alias("_n"), F.sum("_v").alias("_y"), F.sum(F.col("_v") * F.col("_v")).alias("_yy"),
    )
    label = F.lit(None).cast("string")
    for s in sets:
        bits = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        label = F.when(F.col("_set") == bits, F.lit(" + ".join(s))).otherwise(label)
    n, total = F.sum("_n"), F.sum("_y")
    left = F.sum(F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_n"))
    return groups.groupBy(label.alias("features")).agg(
        n.alias("n"),
        F.count("*").alias("n_groups"),
        (1 - F.try_divide(left, F.sum("_yy") - total * total / n)).alias("r2"),
    )


def residual_correlation(cases: DataFrame, key: str = "procedure_text_id") -> DataFrame:
    """What is left after the procedure mean, against age, staff and equipment."""
    rows = with_measures(cases, "actual_inor_min", "staff_count", "resource_count")
    return group_fit(rows, [key], "actual_inor_min", ["patient_age", "staff_count", "resource_count"])


def residual_spread(cases: DataFrame, key: str = "procedure_text_id", y: str = "actual_inor_min") -> DataFrame:
    """Mean absolute and root mean square distance from the group mean."""
    counts = value_counts(with_measures(cases, y), y, [key])
    group = Window.partitionBy(key)
    mean = F.sum(F.col("_value") * F.col("_n")).over(group) / F.sum("_n").over(group)
    off = counts.select("_n", (F.col("_value") - mean).alias("_off"))
    n = F.sum("_n")
    return off.agg(
        n.alias("n"),
        (F.sum(F.abs("_off") * F.col("_n")) / n).alias("mae"),
        F.sqrt(F.sum(F.col("_off") * F.col("_off") * F.col("_n")) / n).alias("std"),
    )
