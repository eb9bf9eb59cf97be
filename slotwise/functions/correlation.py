"""Null-safe Pearson correlation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column) -> Column:
    """Correlation over complete pairs; null if either side does not vary.

    The built-in ``corr`` raises a division error on a constant column in ANSI
    mode. All three moments merge, so the aggregate is partial before a shuffle.
    """
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)
