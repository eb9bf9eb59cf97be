"""Relations that hold on any log."""

import pytest
from pyspark.sql import functions as F

from slotwise.functions import with_measures
from slotwise.operators import prepared
from slotwise.plans import delays, models, replay, surgical, whatif


def test_overtime_is_delay_plus_gap(cases):
    from slotwise.plans.audit import overtime_identity

    assert overtime_identity(cases).first().n_differ == 0


def test_phases_add_up(cases):
    parts = ["patient_prep_min", "procedure_min", "post_procedure_min"]
    rows = with_measures(cases, *parts, "actual_inor_min").dropna(subset=parts)
    off = F.abs(F.col("actual_inor_min") - sum(F.col(p) for p in parts))
    assert rows.agg(F.max(off)).first()[0] <= 2


def test_funnel_falls(log):
    steps = [r.n for r in surgical.data_funnel(log, ("error-0",)).orderBy("step").collect()]
    assert steps == sorted(steps, reverse=True) and steps[-1] > 0


def test_position_counts_up(cases):
    rows = delays.case_positions(cases).groupBy("or_room", "date").agg(
        F.max("case_position").alias("top"), F.countDistinct("case_position").alias("d"),
        F.count("*").alias("n"), F.max("cases_in_day").alias("size"))
    assert rows.where("top != n or d != n or size != n").count() == 0


def test_shares_and_correlations_in_range(cases):
    for r in delays.delay_by_position(cases).collect():
        assert 0 <= r.pct_delayed <= 100
    days = surgical.or_day_classification(surgical.surgical_set(cases, ()))
    assert days.where("abs(position_delay_corr) > 1").count() == 0


def test_specialty_is_filtered_before_deduplication(log):
    one = prepared(log, "click-0")
    assert {r[0] for r in one.select("specialty").distinct().collect()} == {"click-0"}


def test_plan_equal_to_lookup_changes_nothing(spark, cases):
    counts = whatif.lookup_counts(cases, "start_delay_min").withColumn("planned_prep_min", F.col("lookup_prep"))
    line = whatif.before_after(counts, "start_delay_min").first()
    assert line.mean_before == pytest.approx(line.mean_after) and line.n_removed == 0


def test_constant_delay_day_is_dropped(spark):
    rows = [(i, "r", 1, i, 10, 5, 1, "s") for i in range(3)]
    names = "row_seq int, or_room string, date int, ts_patient_in_or_planned int, start_delay_min int, prep_gap_min int, room_overrun_min int, specialty string"
    valid = spark.createDataFrame(rows, names)
    assert surgical.or_day_classification(valid).count() == 0
    two = spark.createDataFrame([(i, "r", 1, i, 10 * i, 5, 1, "s") for i in range(2)], names)
    assert surgical.or_day_classification(two).count() == 0
    three = spark.createDataFrame([(i, "r", 1, i, 10 * i, 5, 1, "s") for i in range(3)], names)
    assert surgical.or_day_classification(three).first().day_type == "Cascading"


@pytest.fixture(scope="module")
def predicted(cases):
    placed = surgical.with_places(surgical.surgical_set(cases, ()))
    return replay.predict_by_lookup(placed, cases).cache()


def test_corrected_never_later_nor_negative(predicted):
    rows = replay.corrected_days(predicted).where("corrected_delay is not null")
    assert rows.where("corrected_delay < 0").count() == 0
    assert rows.where("start_delay_min >= 0 and benefit >= 0 and corrected_delay > start_delay_min").count() == 0


def test_corrected_day_is_one_day(predicted):
    day = predicted.select("or_room", "date").first()
    one = replay.corrected_day(predicted, day.or_room, str(day.date))
    every = replay.corrected_days(predicted).where(
        (F.col("or_room") == day.or_room) & (F.col("date") == F.lit(day.date)))
    pick = ["case_id", "corrected_delay"]
    assert sorted(one.select(*pick).collect()) == sorted(every.select(*pick).collect())


def test_replay_splits_add_up(predicted):
    rows = replay.replay_days(predicted)
    off = F.abs(F.col("finish") - F.col("actual_start") - F.col("prep_within") - F.col("prep_outside")
                - F.col("inor_within") - F.col("inor_outside"))
    assert rows.agg(F.max(off)).first()[0] < 1e-9
    assert rows.where("position = 1 and (alloc_start != 0 or actual_start != 0)").count() == 0


def test_forest_is_repeatable(cases):
    placed = surgical.with_places(surgical.surgical_set(cases, ()))
    train, test = models.temporal_split(placed, "2024-01-21")
    runs = []
    for _ in range(2):
        model, scored = models.prep_forest(train, test, trees=10, depth=4)
        runs.append(models.compare_with_schedule(scored).orderBy("prediction").collect())
    assert [r.prediction for r in runs[0]] == ["model", "schedule"]
    assert runs[0][0].mae == pytest.approx(runs[1][0].mae)
    weights = [r.importance for r in models.feature_importance(model, train).collect()]
    assert sum(weights) == pytest.approx(1)


def test_rare_procedure_has_no_model(cases):
    placed = surgical.with_places(surgical.surgical_set(cases, ()))
    train, test = models.temporal_split(placed, "2024-01-21")
    assert models.procedure_forest(train, test, "no such", trees=2, depth=2).count() == 0


def test_split_days_give_the_same_reports(cases):
    """Every room-day treated as too large for one task."""
    from slotwise.operators import hot_days
    from slotwise.plans import turnaround

    hot = hot_days(cases, rows=0)
    reports = {
        "positions": lambda h: delays.case_positions(cases, hot=h).select("case_id", "case_position", "cases_in_day"),
        "pairs": lambda h: turnaround.turnaround_pairs(cases, hot=h).select("case_id", "turnaround_min", "post_cleaning_gap_min"),
        "buffers": lambda h: turnaround.buffer_pairs(cases, hot=h),
        "days": lambda h: surgical.or_day_classification(surgical.surgical_set(cases, ()), hot=h),
    }
    for name, report in reports.items():
        assert sorted(map(str, report(hot).collect())) == sorted(map(str, report(None).collect())), name


def _taught(spark, n=1500):
    """Rows whose prep follows their features, in every third row from another procedure."""
    rows = spark.range(n).selectExpr(
        "CAST(id AS STRING) AS case_id", "date_add(DATE'2024-01-01', CAST(id % 31 AS INT)) AS date",
        "concat('P', id % 3) AS procedure_name", "id % 7 AS staff_count", "id % 5 AS resource_count",
        "CAST(id % 2 AS INT) AS has_anesthesia", "1 AS is_first_of_day", "0 AS is_last_of_day", "1L AS position",
        "1L AS total_cases_that_day", "10 * (id % 3) + 3 * (id % 7) + 8 * (id % 2) AS actual_prep_min", "0L AS planned_prep_min")
    return models.temporal_split(rows, "2024-01-21")


def test_forest_learns(spark):
    train, test = _taught(spark)
    _, scored = models.prep_forest(train, test, trees=20)
    got = {r.prediction: r for r in models.compare_with_schedule(scored).collect()}
    mean = train.agg(F.avg("actual_prep_min")).first()[0]
    constant = test.agg(F.avg(F.abs(F.col("actual_prep_min") - mean))).first()[0]
    assert got["model"].mae < 0.3 * constant and got["model"].mae < got["schedule"].mae
    assert got["model"].r2 > 0.9


def test_any_number_of_procedure_texts(spark, cases):
    """More texts than a tree has bins, some of them only in the test part."""
    rows = models.model_rows(cases, "actual_inor_min", (0, 600)).crossJoin(spark.range(8).withColumnRenamed("id", "again"))
    many = rows.withColumn("procedure_text_id", F.concat("case_id", F.lit("-"), "again"))
    assert many.select("procedure_text_id").distinct().count() > 5000
    train, test = models.temporal_split(many, "2024-01-21")
    got = models.inor_regression(train, test, trees=2, depth=3).collect()
    assert {r.model for r in got} == {"forest", "planned slot"} and all(r.n > 0 for r in got)


def test_models_without_flags_read_few_columns(cases):
    names = models.model_rows(cases).columns
    assert not [c for c in names if c.startswith(("staff_", "resource_")) and not c.endswith("_count")]
    assert [c for c in models.model_rows(cases, flags=True).columns if c.startswith("resource_") and c != "resource_count"]


def test_day_with_unseen_first_procedure_is_no_candidate(spark):
    rows = [("R1", "2024-01-22", 1, "seen", 0), ("R1", "2024-01-22", 2, "new", -1),
            ("R2", "2024-01-22", 1, "new", -1), ("R2", "2024-01-22", 2, "seen", 0)]
    days = spark.createDataFrame(rows, "or_room string, day string, position long, procedure_name string, procedure_code long").selectExpr(
        "or_room", "CAST(day AS DATE) AS date", "position", "procedure_name", "procedure_code", "position AS row_seq",
        "timestamp_ntz'2024-01-22 08:00:00' + make_dt_interval(0, CAST(position AS INT)) AS ts_patient_in_or_planned",
        "20 * position AS start_delay_min", "20 AS prep_gap_min", "0 AS planned_prep_min", "20 AS actual_prep_min", "18.0D AS predicted_prep")
    find = lambda rows: {r.or_room for r in replay.cascade_day_candidates(rows, max_corrected=100).collect()}
    assert find(days) == {"R1"}
    assert find(days.drop("procedure_code")) == {"R1", "R2"}
    # A missing delay in between is skipped.
    late = lambda last: days.where("or_room = 'R1'").unionByName(days.where("or_room = 'R1' AND position = 2").selectExpr(
        "or_room", "date", "3L AS position", "procedure_name", "procedure_code", "3L AS row_seq",
        "ts_patient_in_or_planned + INTERVAL 1 HOUR AS ts_patient_in_or_planned", f"CAST({last} AS INT) AS start_delay_min", "prep_gap_min",
        "planned_prep_min", "actual_prep_min", "predicted_prep")).withColumn(
            "start_delay_min", F.when(F.col("position") != 2, F.col("start_delay_min")))
    assert find(late(90)) == {"R1"} and find(late(10)) == set()
    one = replay.corrected_day(days, "R1", "2024-01-22")
    assert [r.corrected_delay for r in one.orderBy("position").collect()] == [2.0, 4.0]


def test_whatif_has_no_window_over_a_key(spark):
    """Stamps in seconds, nearly all cases in one lookup key: nothing is exchanged by that key alone but its sums."""
    from slotwise.plans import whatif

    cases = spark.range(20_000).selectExpr(
        "if(id % 50 = 0, 'B', 'A') AS specialty", "DATE'2024-01-01' AS date", "id AS row_seq", "CAST(id AS STRING) AS case_id",
        "timestamp_ntz'2024-01-01 08:00:00' AS ts_or_prep_planned_start",
        "timestamp_ntz'2024-01-01 08:00:00' AS ts_patient_in_or_planned",
        "timestampadd(SECOND, CAST(id % 7001 AS INT), timestamp_ntz'2024-01-01 08:00:00') AS ts_patient_in_or",
        "timestamp_ntz'2024-01-01 08:05:00' AS ts_anesthesia_start",
        "timestampadd(SECOND, CAST(id % 7001 + id % 997 AS INT), timestamp_ntz'2024-01-01 08:00:00') AS ts_procedure_start")
    report = whatif.whatif_start_delay(cases)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(specialty" not in plan
    row = report.first()
    prep = {k: [i % 997 / 60 for i in range(20_000) if (i % 50 == 0) == (k == "B")] for k in "AB"}
    mean = {k: sum(v) / len(v) for k, v in prep.items()}
    after = [i % 7001 / 60 - mean["B" if i % 50 == 0 else "A"] for i in range(20_000)]
    assert row.n == 20_000 and row.mean_after == pytest.approx(sum(after) / 20_000)
