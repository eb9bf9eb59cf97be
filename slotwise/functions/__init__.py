from .buckets import (
    BUFFER_LABELS,
    DELAY_LABELS,
    PREP_LABELS,
    bucket_label,
    buffer_bucket,
    day_type,
    delay_bucket,
    position_label,
    prep_bucket,
)
from .columns import (
    clean_procedure_name,
    clip_low,
    flag_count,
    minutes_between,
    outside_values,
    occupied_or_default,
    share,
    stamps_differ,
    within,
    within_abs,
)
from .correlation import pearson
from .measures import GAPS, SPANS, measure, with_measures

__all__ = [
    "BUFFER_LABELS", "DELAY_LABELS", "GAPS", "PREP_LABELS", "SPANS", "bucket_label",
    "buffer_bucket", "clean_procedure_name", "clip_low", "day_type", "delay_bucket",
    "flag_count", "measure", "minutes_between", "occupied_or_default", "outside_values",
    "pearson", "position_label", "prep_bucket", "share", "stamps_differ", "with_measures",
    "within", "within_abs",
]
