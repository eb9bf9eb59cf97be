"""Tables behind density charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotwise.functions import with_measures, within
from slotwise.operators import density, violin

from .prep import PREP_BOUNDS


def density_split(cases: DataFrame, value: str, bounds: tuple[float, float] = (-60, 120), points: int = 500) -> DataFrame:
    """Density of ``value`` over all cases, and over those without and with planned
    prep, the latter two scaled to their share."""
    rows = with_measures(cases, "planned_prep_min", value, unit="second")
    rows = rows.where(F.col("planned_prep_min").isNotNull() & within(F.col(value), bounds))
    planned = F.col("planned_prep_min")
    own = F.when(planned == 0, "zero prep").when(planned > 0, "has prep")
    # Each row counts in its part and in the whole; counts merge before the shuffle.
    parts = rows.select(value, F.explode(F.array(F.lit("all"), own)).alias("part")).where(
        F.col("part").isNotNull()
    )
    curves = density(parts, value, ["part"], bounds=bounds, points=points)
    # A few rows per grid point; the whole is the largest part.
    total = F.max("n").over(Window.partitionBy("point"))
    return curves.select("part", "point", "x", (F.col("density") * F.col("n") / total).alias("density"))


def delay_density_split(cases: DataFrame, **grid) -> DataFrame:
    return density_split(cases, "start_delay_min", **grid)


def overrun_density_split(cases: DataFrame, **grid) -> DataFrame:
    return density_split(cases, "procedure_overrun_min", **grid)


def prep_violin(cases: DataFrame, points: int = 100) -> DataFrame:
    rows = with_measures(cases, "patient_prep_min", "has_anesthesia", unit="second")
    rows = rows.where(within(F.col("patient_prep_min"), PREP_BOUNDS))
    return violin(rows, "patient_prep_min", "has_anesthesia", points)
