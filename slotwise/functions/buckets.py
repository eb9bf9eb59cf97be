"""Classes of minutes and days. Classes are ordinals, so reports sort by size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREP_LABELS = ("0", "1-10", "11-20", "20+")
BUFFER_LABELS = ("0", "1-10", "11-20", "21-30", "31-45", "45+")
DELAY_LABELS = ("on time", "1-15", "16-30", "31-60", "60+")


def _upper_bounds(column: Column, bounds: tuple[float, ...]) -> Column:
    """0-based index of the first bound that ``column`` does not exceed."""
    index = F.when(column <= bounds[0], 0)
    for i, bound in enumerate(bounds[1:], start=1):
        index = index.when(column <= bound, i)
    return index.when(column.isNotNull(), len(bounds))


def prep_bucket(planned_prep: Column) -> Column:
    """Zero, up to 10, up to 20, more; negative allocations have no class."""
    return F.when(planned_prep >= 0, _upper_bounds(planned_prep, (0, 10, 20)))


def buffer_bucket(buffer: Column) -> Column:
    return F.when(buffer >= 0, _upper_bounds(buffer, (0, 10, 20, 30, 45)))


def delay_bucket(delay: Column) -> Column:
    """Early and punctual starts share the first class."""
    return _upper_bounds(delay, (0, 15, 30, 60))


def bucket_label(ordinal: Column, labels: tuple[str, ...]) -> Column:
    text = F.lit(None).cast("string")
    for i, label in enumerate(labels):
        text = F.when(ordinal == i, label).otherwise(text)
    return text


def position_label(position: Column, last: int = 5) -> Column:
    return F.when(position >= last, F.lit(f"{last}+")).otherwise(position.cast("string"))


def day_type(correlation: Column, cascading: float = 0.5, recovery: float = -0.2) -> Column:
    """How delay moved through a day, from its correlation with case position."""
    return (
        F.when(correlation > cascading, "Cascading")
        .when(correlation < recovery, "Recovery")
        .when(correlation.isNotNull(), "One-time shock")
    )
