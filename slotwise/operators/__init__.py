from .codes import mean_coded, value_sums
from .days import DAY, hot_days, sequence_days
from .distribution import box_stats, density, distribution, histogram, violin
from .joins import attach, encode, keep_matching, translate, value_codes
from .rows import best_in_group, first_in_group, first_rows, prepared, top
from .sketches import merged_sketches, quantile_sketches, rank_error, sketch_quantiles
from .tables import (
    correlation_table,
    group_fit,
    line_fit,
    ordered_list,
    prediction_quality,
    signal_capture,
    wide_by_flag,
)

__all__ = [
    "DAY", "attach", "best_in_group", "box_stats", "correlation_table", "density",
    "distribution", "encode", "first_in_group", "first_rows", "group_fit", "histogram",
    "hot_days", "keep_matching", "line_fit", "mean_coded", "merged_sketches", "ordered_list",
    "prediction_quality", "prepared", "quantile_sketches", "rank_error", "sequence_days", "signal_capture", "sketch_quantiles", "top", "translate", "value_codes", "value_sums", "violin",
    "wide_by_flag",
]
