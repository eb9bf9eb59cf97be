"""Every report and operator as a query over a table folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwise.functions import (
    bucket_label,
    buffer_bucket,
    clean_procedure_name,
    delay_bucket,
    flag_count,
    measure,
    outside_values,
    position_label,
    prep_bucket,
)
from slotwise.functions.flags import pack_flags, unpack_flags
from slotwise.operators import (
    attach,
    DAY,
    encode,
    first_in_group,
    first_rows,
    histogram,
    hot_days,
    keep_matching,
    mean_coded,
    ordered_list,
    prediction_quality,
    prepared,
    sequence_days,
    top,
    translate,
    value_codes,
)
from slotwise.plans import audit, charts, delays, inor, models, prep, replay, surgical, turnaround, whatif
from slotwise.sources import case_log, read_events

# Parameters of the derived log: its stamps fall in one month and its specialties
# have other names than a hospital's.
EXCLUDED = ("error-0", "view-5")
CUTOFF = "2024-01-21"
MONTH_END = "2024-01-31"
NAMES = {"click-0": "Clicking", "view-1": "Viewing", "signup-2": "Signing"}

Query = Callable[[SparkSession, str], DataFrame]


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return case_log(read_events(spark, f"{folder}/events.parquet"))


def _settled(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions at six decimals, dates as text: equal on any
    engine and in any client."""
    out = []
    for f in df.schema:
        column = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        elif isinstance(f.dataType, T.DateType):
            column = column.cast("string")
        out.append(column.alias(f.name))
    return df.select(*out)


def _joined(df: DataFrame, *lists: str) -> DataFrame:
    """List columns as comma-separated text."""
    return df.withColumns(
        {c: F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))) for c in lists}
    )


def _on_log(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: _settled(f(_log(spark, folder)))


def _on_cases(f: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return _on_log(lambda log: f(prepared(log), *args, **kwargs))


def _on_days(f: Callable[..., DataFrame]) -> Query:
    """Queries with ordered steps in a room-day: the log's sizes are checked first."""
    return _on_log(lambda log: f(prepared(log), hot_days(log)))


def _on_turnaround(f) -> Query:
    return _on_days(lambda c, hot: f(turnaround.turnaround_pairs(c, hot=hot)))


def _on_buffers(f) -> Query:
    return _on_days(lambda c, hot: f(turnaround.buffer_pairs(c, hot=hot)))


def _on_gaps(f) -> Query:
    return _on_cases(lambda c: f(prep.gap_rows(c)))


def _on_valid(f) -> Query:
    return _on_cases(lambda c: f(surgical.surgical_set(c, EXCLUDED)))


def _on_valid_days(f) -> Query:
    return _on_days(lambda c, hot: f(surgical.surgical_set(c, EXCLUDED), hot))


def _on_predicted(f) -> Query:
    def run(c: DataFrame, hot: DataFrame | None) -> DataFrame:
        placed = surgical.with_places(surgical.surgical_set(c, EXCLUDED), hot)
        return f(replay.predict_by_lookup(placed, c), hot)

    return _on_days(run)


def _split_days(f) -> Query:
    """Queries on the train and test parts of the placed surgical set, and its large days."""

    def run(c: DataFrame, hot: DataFrame | None) -> DataFrame:
        placed = surgical.with_places(surgical.surgical_set(c, EXCLUDED), hot)
        return f(*models.temporal_split(placed, CUTOFF), hot)

    return _on_days(run)


def _split(f) -> Query:
    return _split_days(lambda train, test, hot: f(train, test))


# --- operators on their own ------------------------------------------------------


def _row_measures(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id",
        measure("start_delay_min").alias("delay_whole"),
        measure("start_delay_min", "second").alias("delay_second"),
        measure("start_delay_min", "micro").alias("delay_micro"),
        measure("patient_prep_min").alias("prep_signed"),
        measure("patient_prep_min", negative="null").alias("prep_known"),
        measure("prep_gap_min").alias("prep_gap"),
        measure("inor_gap_min").alias("inor_gap"),
    )


def _case_flags(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id",
        flag_count(cases, "staff_").alias("staff_count"),
        flag_count(cases, "resource_").alias("resource_count"),
        F.col("ts_anesthesia_start").isNotNull().alias("has_anesthesia"),
        clean_procedure_name(F.col("procedure_text_id")).alias("procedure_name"),
        translate(F.col("specialty"), NAMES).alias("display_name"),
        F.year("date").alias("year"),
        F.hour("ts_patient_in_or_planned").alias("hour"),
        outside_values(F.col("specialty"), EXCLUDED).alias("surgical"),
    )


def _packed_flags(log: DataFrame) -> DataFrame:
    """Counts over bits, and single flags read back."""
    back = unpack_flags(log.withColumns({f"{p}_count": flag_count(log, f"{p}_") for p in ("staff", "resource")}))
    return back.select("row_seq", "staff_count", "resource_count", "staff_e", "resource_d")


def _unit_measures(cases: DataFrame) -> DataFrame:
    """Measures of stamps with seconds and microseconds, which the derived log has none of."""
    shift = lambda stamp, micros: F.expr(f"timestampadd(MICROSECOND, {micros}, {stamp})")
    moved = cases.withColumns({
        "ts_patient_in_or": shift("ts_patient_in_or", "row_seq * 7919 % 999983 * 60"),
        "ts_procedure_start": shift("ts_procedure_start", "-(row_seq * 104729 % 999983 * 60)"),
    })
    return moved.select("case_id", *[
        measure(f"{m}_min", unit).alias(f"{m}_{unit}")
        for m in ("start_delay", "patient_prep") for unit in ("minute", "second", "micro")])


def _rows_by_first(train: DataFrame, test: DataFrame) -> DataFrame:
    """Known numbers of the rows that the forests are judged on."""
    known = test.dropna(subset=["actual_prep_min", "planned_prep_min"])
    return known.groupBy(F.col("is_first_of_day").alias("is_first")).agg(
        F.count("*").alias("n"), F.avg("actual_prep_min").alias("mean_actual_prep"),
        F.avg("planned_prep_min").alias("mean_planned_prep"))


def _overrun_labels(train: DataFrame, test: DataFrame) -> DataFrame:
    known = test.where(F.col("overtime_minutes").isNotNull())
    return known.groupBy((F.col("overtime_minutes") > 0).alias("overran")).agg(F.count("*").alias("n"))


def _planned_slot(train: DataFrame, test: DataFrame) -> DataFrame:
    return prediction_quality(test, "actual_inor_min", "planned_inor_min")


def _saturated_line(train: DataFrame, test: DataFrame) -> DataFrame:
    """The line on specialty, anesthesia and their product: its prediction is the training mean of the group."""
    keys, target = ["specialty", "has_anesthesia"], "patient_prep_min"
    means = train.groupBy(*keys).agg(F.avg(target).alias("predicted"))
    return prediction_quality(attach(test, means, keys, "inner"), target, "predicted")


def _tier_rows(cases: DataFrame) -> DataFrame:
    numbers = ["staff_count", "resource_count", "actual_prep_min", "overtime_minutes"]
    return models.model_rows(cases).dropna(subset=numbers).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in numbers])


def _bucket_codes(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id",
        prep_bucket(measure("planned_prep_min")).alias("prep_bucket"),
        delay_bucket(measure("start_delay_min")).alias("delay_bucket"),
        buffer_bucket(measure("planned_cleaning_min")).alias("buffer_bucket"),
        bucket_label(prep_bucket(measure("planned_prep_min")), ("0", "1-10", "11-20", "20+")).alias("label"),
    )


def _case_positions(cases: DataFrame, hot: DataFrame | None) -> DataFrame:
    return delays.case_positions(cases, hot=hot).select(
        "case_id", "case_position", "cases_in_day",
        position_label(F.col("case_position")).alias("position_label"),
    )


def _running_delay(cases: DataFrame, hot: DataFrame | None) -> DataFrame:
    timed = cases.dropna(subset=["delay_minutes", "ts_patient_in_or_planned"])
    return sequence_days(
        timed, "ts_patient_in_or_planned", previous={"previous_delay": "delay_minutes"},
        running={"upto": ("delay_minutes", True), "before": ("delay_minutes", False)}, hot=hot,
    ).select("case_id", "previous_delay", "upto", "before")


def _day_lists(cases: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Cases of the three longest recorded days in order, in segments of eight."""
    placed = delays.case_positions(cases, hot=hot)
    days = cases.dropna(subset=[*DAY, "delay_minutes", "ts_patient_in_or_planned", "ts_patient_in_or"])
    sizes = days.groupBy(*DAY).agg(F.count("*").alias("n")).where(F.col("n") >= 3)
    chosen = top(sizes, 3, "n", "date", "or_room")
    rows = placed.join(F.broadcast(chosen.select(*DAY)), list(DAY), "left_semi")
    return _joined(
        ordered_list(rows, DAY, "case_position", ["case_id", "delay_minutes"], length=8),
        "case_id_list", "delay_minutes_list",
    )


def _large_specialties(cases: DataFrame) -> DataFrame:
    sizes = cases.groupBy("specialty").agg(F.count("*").alias("n")).where(F.col("n") >= 100)
    return keep_matching(cases, sizes, ["specialty"]).select("case_id", "specialty")


def _lookup_rows(cases: DataFrame, how: str) -> DataFrame:
    return whatif.with_lookup(cases, "start_delay_min", how=how).select(
        "case_id", "specialty", "has_anesthesia", "lookup_prep"
    )


def _procedure_codes(train: DataFrame, test: DataFrame) -> DataFrame:
    codes = value_codes(train, "procedure_name", "procedure_code")
    return encode(test, codes, "procedure_name", "procedure_code").select("case_id", "procedure_code")


def _mean_codes(train: DataFrame, test: DataFrame) -> DataFrame:
    """Codes of both parts: of the first from the other folds, of the second from all training rows."""
    columns = {"specialty": "specialty_code", "procedure_text_id": "text_code"}
    parts = mean_coded(train, test, columns, "patient_prep_min")
    return parts[0].unionByName(parts[1]).select("case_id", (F.col("date") < F.lit(CUTOFF).cast("date")).alias("train"), *columns.values())


def _schedule_quality(train: DataFrame, test: DataFrame) -> DataFrame:
    return prediction_quality(test, "actual_prep_min", "planned_prep_min")


def _forest(f) -> Query:
    """Queries on the fitted prep forest and its scored test rows."""
    return _forest_days(lambda model, scored, hot: f(model, scored))


def _forest_days(f) -> Query:
    return _split_days(lambda train, test, hot: f(*models.prep_forest(train, test), hot))


def _importance(model, scored: DataFrame) -> DataFrame:
    return models.feature_importance(model, scored)


def _forest_predicted(scored: DataFrame) -> DataFrame:
    marks = {c: F.col(c) == 1 for c in ("is_first_of_day", "is_last_of_day", "has_anesthesia")}
    return scored.withColumns({**marks, "position": F.col("position").cast("long")})


def _with_age(train: DataFrame, test: DataFrame) -> DataFrame:
    features = models.PREP_FEATURES_WITH_AGE
    return models.compare_with_schedule(models.prep_forest(train, test, features)[1])


def _mean_coded(train: DataFrame, test: DataFrame) -> DataFrame:
    train, test = models.encode_procedures(train, test, "mean")
    return models.compare_with_schedule(models.score(models.fit_forest(train), test))


def _common_procedure(train: DataFrame, test: DataFrame) -> DataFrame:
    return models.procedure_forest(train, test, "PROC 1", min_train=20)


def _modelled(f, target: str = "patient_prep_min", bounds=(0, 240), flags: bool = False, **kwargs) -> Query:
    def run(c: DataFrame) -> DataFrame:
        return f(*models.temporal_split(models.model_rows(c, target, bounds, flags), CUTOFF), **kwargs)

    return _on_cases(run)


def _prep_bins(cases: DataFrame) -> DataFrame:
    return histogram(prep.prepared_patients(cases), "patient_prep_min", width=5)


def _example_timeline(valid: DataFrame, hot: DataFrame | None) -> DataFrame:
    return surgical.day_timeline(surgical.day_examples(valid, hot=hot))


def _example_cases(valid: DataFrame, hot: DataFrame | None) -> DataFrame:
    return surgical.day_examples(valid, hot=hot).select(
        "day_type", *DAY, "position", "case_id", "start_delay_min"
    )


def _candidates(predicted: DataFrame, hot: DataFrame | None) -> DataFrame:
    days = replay.cascade_day_candidates(
        predicted, min_first_gap=5, max_first_error=40, min_first_delay=0, max_corrected=60, hot=hot
    )
    lists = ["procedure_name_list", "start_delay_min_list", "planned_prep_min_list", "actual_prep_min_list"]
    return _joined(days.drop("predicted_prep_list", "corrected_delay_list"), *lists)


def _corrected(predicted: DataFrame, hot: DataFrame | None, whole: bool = True) -> DataFrame:
    return replay.corrected_days(predicted, whole, hot).select(
        *DAY, "position", "case_id", "procedure_name", "planned_prep_min", "predicted_prep",
        "actual_prep_min", "start_delay_min", "corrected_delay",
    )


def _feasible_days(cases: DataFrame, hot: DataFrame | None) -> DataFrame:
    split = hot is not None
    candidates = whatif.feasible_candidates(cases, hours=(0, 23), write=split)
    return whatif.feasible_whatif_days(candidates, case_range=(2, 4), split=split)


def _feasible_day(cases: DataFrame) -> DataFrame:
    return whatif.feasible_whatif_day(whatif.feasible_candidates(cases, hours=(0, 23)), case_range=(2, 4))


def _best_days(cases: DataFrame) -> DataFrame:
    return whatif.best_whatif_days(cases, 10, case_range=(1, 4), min_good=1, min_old=15, max_new=30, hours=(0, 23))


def build() -> dict[str, Query]:
    q: dict[str, Query] = {
        # delays
        "delay_by_position": _on_days(lambda c, hot: delays.delay_by_position(c, hot=hot)),
        "delay_by_position_all": _on_days(lambda c, hot: delays.delay_by_position(c, "all", hot)),
        "cascade_correlation": _on_cases(delays.cascade_correlation),
        "worst_cascade_days": _on_cases(delays.worst_cascade_days),
        "top_delay_reasons": _on_cases(delays.top_delay_reasons),
        "top_reason_per_specialty": _on_cases(delays.top_reason_per_specialty),
        "time_lost_by_reason": _on_cases(delays.time_lost_by_reason),
        "one_specialty_reasons": _on_log(lambda log: delays.top_delay_reasons(prepared(log, "click-0"))),
        # turnaround
        "turnaround_pairs": _on_turnaround(
            lambda p: p.drop("prev_cleaned", "ts_or_prep_start", "ts_or_prep_done", "ts_patient_in_or")),
        "turnaround_distribution": _on_turnaround(turnaround.turnaround_distribution),
        "turnaround_distribution_linear": _on_turnaround(
            lambda p: turnaround.turnaround_distribution(p, "linear")),
        "turnaround_components": _on_turnaround(turnaround.turnaround_components),
        "turnaround_by_specialty": _on_turnaround(lambda p: turnaround.turnaround_by_specialty(p, 5)),
        "turnaround_sketched": _on_turnaround(
            lambda p: turnaround.sketched_turnaround(turnaround.turnaround_sketches(p, 8192), 8192)),
        "turnaround_bins": _on_turnaround(lambda p: histogram(p, "turnaround_min", width=20, merge_empty=True)),
        "idle_pairs": _on_turnaround(turnaround.idle_pairs),
        "idle_breakdown": _on_turnaround(turnaround.idle_breakdown),
        "idle_by_specialty": _on_turnaround(lambda p: turnaround.idle_by_specialty(p, 2)),
        "overtime_by_specialty": _on_cases(turnaround.overtime_by_specialty),
        "planned_cleaning_coverage": _on_cases(turnaround.cleaning_coverage, "planned_cleaning_min"),
        "planned_cleaning_distribution": _on_cases(turnaround.planned_cleaning_distribution),
        "actual_cleaning_coverage": _on_cases(turnaround.cleaning_coverage, "actual_cleaning_min"),
        "actual_cleaning_distribution": _on_cases(turnaround.actual_cleaning_distribution),
        "planned_buffer_pairs": _on_buffers(lambda p: p),
        "planned_buffer_summary": _on_buffers(turnaround.buffer_summary),
        "entry_delay_by_buffer": _on_buffers(turnaround.entry_delay_by_buffer),
        "buffer_delay_correlation": _on_buffers(turnaround.buffer_delay_correlation),
        "buffer_overshoot": _on_buffers(turnaround.buffer_overshoot),
        "overshoot_by_buffer": _on_buffers(turnaround.overshoot_by_buffer),
        "turnaround_histogram": _on_turnaround(turnaround.turnaround_histogram),
        "turnaround_boxes": _on_turnaround(lambda p: turnaround.turnaround_boxes(p, 5)),
        # patient prep and gaps
        "patient_prep_distribution": _on_cases(prep.patient_prep_distribution),
        "patient_prep_by_anesthesia": _on_cases(prep.patient_prep_by_anesthesia),
        "prep_complexity_correlation": _on_cases(prep.prep_complexity_correlation),
        "patient_prep_by_specialty": _on_cases(prep.patient_prep_by_specialty),
        "prep_vs_inor_gap": _on_gaps(prep.prep_vs_inor_gap),
        "prep_vs_inor_gap_absolute": _on_gaps(lambda g: prep.prep_vs_inor_gap(g, compare="absolute")),
        "prep_vs_inor_gap_rows": _on_log(
            lambda log: prep.prep_vs_inor_gap(prep.gap_rows(log, unit="micro", clean=True))),
        "gap_complexity_signal": _on_gaps(prep.gap_complexity_signal),
        "gap_signal_long": _on_gaps(prep.gap_signal_long),
        "gap_signal_capture": _on_gaps(prep.gap_signal_capture),
        "worst_prep_gap": _on_gaps(prep.worst_prep_gap),
        "gap_independence": _on_gaps(prep.gap_independence),
        # time in the room
        "inor_breakdown": _on_cases(inor.inor_breakdown),
        "inor_phase_share": _on_cases(inor.inor_phase_share),
        "slot_overrun": _on_cases(inor.slot_overrun),
        "phase_complexity": _on_cases(inor.phase_complexity),
        "inor_by_specialty": _on_cases(inor.inor_by_specialty),
        "prep_staff_points": _on_cases(inor.prep_staff_points),
        "prep_staff_fit": _on_cases(inor.prep_staff_fit),
        "duration_lookup": _on_cases(inor.duration_lookup),
        "feature_r2": _on_cases(inor.feature_r2),
        "prep_feature_r2": _on_cases(inor.feature_r2, "patient_prep_min"),
        "residual_correlation": _on_cases(inor.residual_correlation),
        "residual_spread": _on_cases(inor.residual_spread),
        # surgical set
        "data_funnel": _on_log(lambda log: surgical.data_funnel(log, EXCLUDED)),
        "phase_comparison": _on_valid(surgical.phase_comparison),
        "phase_gap_summary": _on_valid(surgical.phase_gap_summary),
        "zero_allocation_split": _on_valid(surgical.zero_allocation_split),
        # The derived log plans some prep for every procedure but none at some ages.
        "zero_allocation_split_by_age": _on_valid(
            lambda v: surgical.zero_allocation_split(v, 10, "patient_age")),
        "zero_allocation_top": _on_valid(
            lambda v: surgical.zero_allocation_top(v, min_cases=10, key="patient_age")),
        "zero_allocation_histogram": _on_valid(
            lambda v: surgical.zero_allocation_histogram(v, min_cases=10, key="patient_age")),
        "or_day_classification": _on_valid_days(lambda v, hot: surgical.or_day_classification(v, hot=hot)),
        "day_type_summary": _on_valid_days(
            lambda v, hot: surgical.day_type_summary(surgical.or_day_classification(v, hot=hot))),
        "delay_curve_by_day_type": _on_valid_days(
            lambda v, hot: surgical.delay_curve_by_day_type(v, min_rows=5, hot=hot)),
        "day_examples": _on_valid_days(_example_cases),
        "day_timeline": _on_valid_days(_example_timeline),
        "waiting_impact": _on_valid(surgical.waiting_impact),
        "waiting_distribution": _on_valid(surgical.waiting_distribution),
        "scheduling_signal_table": _on_valid_days(
            lambda v, hot: surgical.scheduling_signal_table(surgical.with_places(v, hot))),
        "scheduling_signal_table_wide": _on_valid_days(
            lambda v, hot: surgical.scheduling_signal_table(surgical.with_places(v, hot), wide=True)),
        # replay
        "cascade_day_candidates": _on_predicted(_candidates),
        "corrected_days": _on_predicted(_corrected),
        "corrected_days_unplanned_part": _on_predicted(lambda p, hot: _corrected(p, hot, False)),
        "increasing_days": _on_predicted(replay.increasing_days),
        "replay_days": _on_valid_days(lambda v, hot: replay.replay_days(surgical.with_places(v, hot), hot=hot)),
        "replay_days_predicted": _on_predicted(lambda p, hot: replay.replay_days(p, True, hot=hot)),
        "waiting_saved": _on_predicted(lambda p, hot: replay.waiting_saved(p, CUTOFF, MONTH_END, hot)),
        # allocation classes and densities
        "delay_by_prep_bucket": _on_cases(delays.delay_by_prep_bucket),
        "prep_bucket_profile": _on_cases(delays.prep_bucket_profile),
        "delay_density_split": _on_cases(charts.delay_density_split),
        "overrun_by_prep_bucket": _on_cases(delays.overrun_by_prep_bucket),
        "overrun_density_split": _on_cases(charts.overrun_density_split),
        "prep_violin": _on_cases(charts.prep_violin),
        # lookup and what-if
        "prep_lookup": _on_cases(whatif.prep_lookup),
        "prep_lookup_grid": _on_cases(whatif.prep_lookup_grid, NAMES),
        "prep_lookup_grid_ends": _on_cases(whatif.prep_lookup_grid_ends, 5, NAMES),
        "whatif_room_overrun": _on_cases(whatif.whatif_room_overrun),
        "whatif_room_overrun_temporal": _on_cases(whatif.whatif_room_overrun, fit_before=CUTOFF),
        "whatif_start_delay": _on_cases(whatif.whatif_start_delay),
        "whatif_procedure_overrun": _on_cases(whatif.whatif_procedure_overrun),
        "lookup_residual": _on_cases(whatif.lookup_residual),
        "feasible_whatif_days": _on_days(_feasible_days),
        "feasible_whatif_day": _on_cases(_feasible_day),
        "best_whatif_days": _on_cases(_best_days),
        # audits
        "overtime_identity": _on_cases(audit.overtime_identity),
        "metric_identity": _on_cases(audit.metric_identity),
        "two_failures": _on_cases(delays.two_failures),
        "failure_distributions": _on_cases(delays.failure_distributions),
        "hours_lost_by_specialty": _on_cases(delays.hours_lost_by_specialty),
        "gap_by_delay_bucket": _on_cases(delays.gap_by_delay_bucket),
        "delay_gap_independence": _on_cases(delays.delay_gap_independence),
        "same_click_audit": _on_cases(audit.same_click_audit),
        "measure_coverage": _on_cases(audit.measure_coverage),
        "clean_subset_bias": _on_cases(audit.clean_subset_bias),
        "zero_prep_by_acute": _on_cases(audit.zero_prep_by_group, "is_acute"),
        "zero_prep_by_specialty": _on_cases(audit.zero_prep_by_group, "specialty"),
        "case_inventory": _on_log(audit.case_inventory),
        "anesthesia_subphases": _on_cases(audit.anesthesia_subphases),
        "room_prep_vs_delay": _on_cases(audit.room_prep_vs_delay),
        "lookup_fit_by_target": _on_cases(audit.lookup_fit_by_target),
        "delay_amplification": _on_cases(delays.delay_amplification),
        # operators on their own
        "case_log": _on_log(lambda log: log),
        "first_case_rows": _on_log(first_rows),
        "row_measures": _on_cases(_row_measures),
        "unit_measures": _on_cases(_unit_measures),
        "case_flags": _on_cases(_case_flags),
        "packed_flags": _on_log(lambda log: _packed_flags(pack_flags(log))),
        "bucket_codes": _on_cases(_bucket_codes),
        "case_positions": _on_days(_case_positions),
        "running_delay": _on_days(_running_delay),
        "first_three_cases": _on_cases(
            lambda c: first_in_group(
                c.dropna(subset=["ts_patient_in_or_planned"]), DAY,
                [F.col("ts_patient_in_or_planned").asc(), F.col("row_seq").asc()], 3,
            ).select(*DAY, "case_id")),
        "day_lists": _on_days(_day_lists),
        "large_specialty_cases": _on_cases(_large_specialties),
        "lookup_left_join": _on_cases(_lookup_rows, "left"),
        "lookup_inner_join": _on_cases(_lookup_rows, "inner"),
        "patient_prep_bins": _on_cases(_prep_bins),
        "placed_cases": _on_valid_days(
            lambda v, hot: surgical.with_places(v, hot).select(
                "case_id", "position", "total_cases_that_day", "is_first_of_day", "is_last_of_day")),
        # models
        "split_sizes": _on_valid_days(lambda v, hot: models.split_sizes(surgical.with_places(v, hot), CUTOFF)),
        "mean_codes": _modelled(_mean_codes),
        "procedure_codes": _split(_procedure_codes),
        "schedule_quality": _split(_schedule_quality),
        "forest_rows_by_first": _split(_rows_by_first),
        "overrun_labels": _modelled(_overrun_labels),
        "planned_slot_quality": _modelled(_planned_slot, "actual_inor_min", (0, 600)),
        "saturated_line": _modelled(_saturated_line),
        "tier_rows": _on_cases(_tier_rows),
        "prep_forest": _forest(lambda _, scored: models.compare_with_schedule(scored)),
        "prep_forest_by_first": _forest(lambda _, scored: models.compare_by_first(scored)),
        "prep_forest_importance": _forest(_importance),
        "prep_forest_with_age": _split(_with_age),
        "prep_forest_mean_coded": _split(_mean_coded),
        "procedure_forest": _split(_common_procedure),
        "forest_corrected_days": _forest_days(lambda _, s, hot: _corrected(_forest_predicted(s), hot)),
        "forest_cascade_candidates": _forest_days(lambda _, s, hot: _candidates(_forest_predicted(s), hot)),
        "forest_waiting_saved": _forest_days(
            lambda _, s, hot: replay.waiting_saved(_forest_predicted(s), CUTOFF, MONTH_END, hot=hot)),
        "boosted_prep": _modelled(models.boosted_prep),
        "linear_prep": _modelled(models.linear_prep),
        "component_linear_prep": _modelled(models.component_linear_prep, flags=True, k=9),
        "components_tell_specialty": _modelled(models.components_tell_specialty, flags=True, k=9),
        "complexity_tiers": _on_cases(lambda c: models.complexity_tiers(models.model_rows(c))),
        "overrun_classifier": _modelled(models.overrun_classifier),
        "inor_regression": _modelled(models.inor_regression, "actual_inor_min", (0, 600)),
        "text_features": _modelled(models.text_features),
        "known_procedure_test": _split(lambda a, b: models.known_procedure_test(a, b, min_rows=5)),
    }
    return q
