"""Every model on rows that hold a known answer."""

import zlib

import pytest
from pyspark.sql import functions as F

from slotwise.functions import flag_count
from slotwise.functions.flags import pack_flags, unpack_flags
from slotwise.operators import mean_coded, prediction_quality
from slotwise.plans import models
from slotwise.session import cut, dealt

CUTOFF = "2024-01-21"


def taught_rows(spark, n=3000, flags=0, **columns):
    """Rows with all columns of ``model_rows``; named columns replace the defaults."""
    base = {
        "case_id": "CAST(id AS STRING)", "date": "date_add(DATE'2024-01-01', CAST(id % 31 AS INT))", "specialty": "concat('S', id % 4)",
        "diagnosis_group": "concat('D', id % 6)", "procedure_text_id": "concat('text ', id % 9)", "overtime_minutes": "CAST(id % 40 - 20 AS DOUBLE)",
        "patient_prep_min": "CAST(10 * (id % 4) + 6 * (id % 2) + 20 AS DOUBLE)", "actual_inor_min": "CAST(30 * (id % 9) + 60 AS DOUBLE)",
        "actual_prep_min": "CAST(id % 30 AS DOUBLE)", "planned_prep_min": "CAST(id % 2 * 15 AS DOUBLE)", "patient_age": "CAST(id % 90 AS DOUBLE)",
        "is_acute": "CAST(id % 5 = 0 AS DOUBLE)", "has_anesthesia": "CAST(id % 2 AS DOUBLE)", "staff_count": "CAST(id % 7 AS DOUBLE)",
        "resource_count": "CAST(id % 3 AS DOUBLE)", "planned_inor_min": "CAST(120 AS DOUBLE)",
        **{f"resource_{k:03d}": f"(hash(id, {k}) & 1) = 1" for k in range(flags)}, **columns,
    }
    return spark.range(n).selectExpr(*[f"{e} AS {c}" for c, e in base.items()])


def split(rows):
    return models.temporal_split(rows, CUTOFF)


def lines(df, key="model"):
    return {r[key]: r for r in df.collect()}


def test_codes_come_from_the_other_folds(spark):
    rows = [(f"c{i}", pick, y) for i, (pick, y) in enumerate(
        [("a", float(i)) for i in range(40)] + [("b", 100.0 + i) for i in range(9)] + [(None, 5.0), ("only once", 1000.0), ("b", None)])]
    train = spark.createDataFrame(rows, "case_id string, value string, y double").repartition(3)
    test = spark.createDataFrame([("t1", "a"), ("t2", "never"), ("t3", None), ("t4", "only once")], "case_id string, value string")
    coded, unseen = mean_coded(train, test, {"value": "code"}, "y")
    known = [r for r in rows if r[2] is not None]
    mean = sum(y for *_, y in known) / len(known)
    fold = lambda case: zlib.crc32(case.encode()) % 5

    def want(value, skip=None):
        ys = [y for c, v, y in known if v == value and v is not None and fold(c) != skip]
        return (sum(ys) + 10 * mean) / (len(ys) + 10) if ys else mean

    got = {r.case_id: r.code for r in coded.collect()}
    assert len(got) == len(rows) and all(got[c] == pytest.approx(want(v, fold(c))) for c, v, _ in rows)
    assert {r.case_id: pytest.approx(r.code) for r in unseen.collect()} == {
        "t1": want("a"), "t2": mean, "t3": mean, "t4": (1000 + 10 * mean) / 11}
    empty, still = mean_coded(train.limit(0), test, {"value": "code"}, "y")
    assert empty.count() == 0 and still.where("code is null").count() == 4


def test_texts_of_one_row_each_do_not_mislead(spark):
    """A text per row tells nothing; the model must not be worse for it."""
    noise = "CAST(30 * (id % 4) + 60 + pmod(hash(id), 21) AS DOUBLE)"
    r2 = {}
    for name, text in (("own", "concat('text ', id)"), ("same", "'text'")):
        rows = taught_rows(spark, 4000, actual_inor_min=noise, procedure_text_id=text)
        r2[name] = lines(models.inor_regression(*split(rows), trees=10, depth=5))["forest"].r2
    assert r2["same"] > 0.8 and abs(r2["own"] - r2["same"]) < 0.05


def test_stay_model_learns_common_texts(spark):
    got = lines(models.inor_regression(*split(taught_rows(spark)), trees=10, depth=5))
    assert got["forest"].r2 > 0.95 and got["forest"].mae < got["planned slot"].mae


def test_boosted_prep_learns(spark):
    got = lines(models.boosted_prep(*split(taught_rows(spark)), iterations=20))
    assert got["boosted trees"].r2 > 0.95


def test_line_with_interaction_is_the_group_mean(spark):
    uneven = "CAST(10 * (id % 4) + 6 * IF(id % 3 = 0, id % 4, 0) + 20 + pmod(hash(id), 7) AS DOUBLE)"
    train, test = split(taught_rows(spark, patient_prep_min=uneven, has_anesthesia="CAST(id % 3 = 0 AS DOUBLE)"))
    keys = ["specialty", "has_anesthesia"]
    means = train.groupBy(*keys).agg(F.avg("patient_prep_min").alias("p"))
    want = prediction_quality(test.join(means, keys), "patient_prep_min", "p").first()
    got = lines(models.linear_prep(train, test, penalty=0.0))
    assert got["with interaction"].mae == pytest.approx(want.mae, abs=1e-4)
    assert got["with interaction"].r2 == pytest.approx(want.r2, abs=1e-4)
    assert got["specialty + anesthesia"].r2 < got["with interaction"].r2
    assert set(got) == {"specialty + anesthesia", "with interaction", "with age and acute", "with staff and equipment"}


def test_components_carry_what_flags_know(spark):
    """210 flags; the target follows a group of flags that move together, as does the specialty."""
    together = {f"resource_{k:03d}": f"(id % 4) >= 2 AND (hash(id, {k}) & 15) > 0" for k in range(40)}
    rows = taught_rows(spark, 2000, flags=210, specialty="CASE WHEN id % 4 >= 2 THEN 'A' ELSE 'B' END",
                       patient_prep_min="CAST(IF(id % 4 >= 2, 40, 10) + pmod(hash(id), 5) AS DOUBLE)", **together)
    plain = rows.withColumn("specialty", F.lit("one"))
    few = lines(models.component_linear_prep(*split(plain.select(*[c for c in plain.columns if not c.startswith("resource_0")])), k=1))
    many = lines(models.component_linear_prep(*split(plain), k=2))
    assert many["components"].r2 > 0.9 > 0.5 > few["components"].r2
    assert models.components_tell_specialty(*split(rows), k=2).first().accuracy_pct > 95
    packed = lines(models.component_linear_prep(*split(pack_flags(plain)), k=2))
    assert packed["components"].r2 == pytest.approx(many["components"].r2, abs=1e-6)


def test_packed_flags_count_and_come_back(spark, tmp_path):
    rows = taught_rows(spark, 200, flags=210).drop("staff_count", "resource_count").withColumn(
        "resource_063", F.when(F.col("resource_062"), True)).withColumn("staff_x", F.lit(True))
    pack_flags(rows).write.parquet(str(tmp_path / "packed"))
    log = spark.read.parquet(str(tmp_path / "packed"))
    assert [c for c in log.columns if c.startswith(("staff_", "resource_"))] == ["staff_flags", "resource_flags"]
    for prefix in ("staff_", "resource_"):
        want = {r[0]: r[1] for r in rows.select("case_id", flag_count(rows, prefix)).collect()}
        assert {r[0]: r[1] for r in log.select("case_id", flag_count(log, prefix)).collect()} == want
    back = unpack_flags(log)
    assert set(back.columns) == set(rows.columns)
    names = [f"resource_{k:03d}" for k in range(210)]
    want = {r.case_id: [bool(r[n]) for n in names] for r in rows.collect()}
    assert {r.case_id: [r[n] for n in names] for r in back.collect()} == want


def test_tiers_are_the_nearest_centres(spark):
    rows = taught_rows(spark, 900, staff_count="CAST(id % 3 * 10 AS DOUBLE)", resource_count="CAST(id % 3 * 5 AS DOUBLE)",
                       actual_prep_min="CAST(id % 3 * 20 + id % 2 AS DOUBLE)", overtime_minutes="CAST(id % 3 * 30 AS DOUBLE)",
                       specialty="'one'")
    got = sorted(models.complexity_tiers(rows).collect(), key=lambda r: r.mean_staff_count)
    assert [r.n for r in got] == [300, 300, 300]
    assert [r.mean_staff_count for r in got] == [0, 10, 20] and [r.mean_overtime_minutes for r in got] == [0, 30, 60]
    assert got[0].silhouette > 0.95


def test_overrun_tree_learns(spark):
    rows = taught_rows(spark, overtime_minutes="CAST(IF(id % 4 = 1 OR id % 2 = 0, 10, -10) AS DOUBLE)")
    table = {(r.label, r.prediction): r.n for r in models.overrun_classifier(*split(rows)).collect()}
    assert set(table) == {(0.0, 0.0), (1.0, 1.0)}


def test_words_add_to_the_line(spark):
    rows = taught_rows(spark, procedure_text_id="concat('word', id % 9, ' common')", patient_prep_min="CAST(20 + 15 * (id % 9) AS DOUBLE)")
    got = lines(models.text_features(*split(rows)))
    assert got["structured + text"].r2 > 0.98 and got["structured"].r2 < 0.5


def test_procedure_model_beats_the_general_one(spark):
    rows = spark.range(3000).selectExpr(
        "CAST(id AS STRING) AS case_id", "date_add(DATE'2024-01-01', CAST(id % 31 AS INT)) AS date", "concat('P', id % 3) AS procedure_name",
        "id % 7 AS staff_count", "id % 5 AS resource_count", "CAST(id % 2 AS INT) AS has_anesthesia", "1 AS is_first_of_day",
        "0 AS is_last_of_day", "1L AS position", "1L AS total_cases_that_day", "0L AS planned_prep_min",
        "IF(id % 3 = 1, 5 * (id % 7), 40 - 5 * (id % 7)) AS actual_prep_min")
    got = lines(models.procedure_forest(*split(rows), "P1", trees=10, depth=3), "prediction")
    assert set(got) == {"schedule", "general model", "procedure model"} and len({r.n for r in got.values()}) == 1
    assert got["procedure model"].mae < 1 and got["procedure model"].mae <= got["general model"].mae < got["schedule"].mae


def test_both_parts_are_counted_at_once(spark):
    rows = taught_rows(spark, 310)
    assert {r.part: r.n for r in models.split_sizes(rows, CUTOFF).collect()} == {"train": 200, "test": 110}
    assert {r.part: r.n for r in models.split_sizes(rows.limit(0), CUTOFF).collect()} == {"train": 0, "test": 0}


def _read_by_learner(spark, run, monkeypatch):
    """Rows of each partition that learners were given."""
    seen, fit = [], models.Pipeline.fit
    monkeypatch.setattr(models.Pipeline, "fit", lambda self, rows: seen.append(rows) or fit(self, rows))
    run()
    return seen


def test_learners_get_tasks_of_even_size(spark, monkeypatch):
    """Rows that arrive in three tasks are dealt to whole rounds of all cores; few rows stay as they are."""
    rows = taught_rows(spark, 9000).coalesce(3)
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(models, "TREE_ROWS", 500)
    monkeypatch.setattr(models, "EVEN_ROWS", 1000)
    monkeypatch.setattr(dealt, "__defaults__", (500, None))
    given = _read_by_learner(spark, lambda: (models.inor_regression(*split(rows), trees=2, depth=2), models.complexity_tiers(rows)), monkeypatch)
    for df, n in zip(given, (split(rows)[0].count(), 9000), strict=True):
        sizes = df.rdd.glom().map(len).collect()
        assert sum(sizes) == n and len(sizes) % cores == 0 and max(sizes) <= 520
    same = dealt(rows, 5000)
    assert same.rdd.getNumPartitions() == 3 and same.exceptAll(rows).count() == 0 == rows.exceptAll(dealt(rows, 500)).count()


def test_forests_gather_few_nodes_at_a_time(spark, monkeypatch):
    """Sums of a task fit a core's cache, and smaller ones change nothing."""
    trees = []
    monkeypatch.setattr(models, "RandomForestRegressor", lambda f=models.RandomForestRegressor, **kw: trees.append(f(**kw)) or trees[-1])
    train, test = split(taught_rows(spark, 1500))
    first = lines(models.inor_regression(train, test, trees=5, depth=4))["forest"]
    assert trees[0].getMaxMemoryInMB() <= 16
    monkeypatch.setattr(models, "NODE_MB", 256)
    again = lines(models.inor_regression(train, test, trees=5, depth=4))["forest"]
    assert again.mae == pytest.approx(first.mae) and again.r2 == pytest.approx(first.r2)


def test_boosting_reads_each_combination_of_features_once(spark, monkeypatch):
    """Rows of equal features are one weighted row, and the trees are those of all rows."""
    rows = taught_rows(spark, 4000, patient_prep_min="CAST(10 * (id % 4) + pmod(hash(id), 13) AS DOUBLE)", patient_age="CAST(id % 6 AS DOUBLE)")
    train, test = split(rows)
    monkeypatch.setattr(models, "EVEN_ROWS", 1000)
    seen = _read_by_learner(spark, lambda: models.boosted_prep(train, test, iterations=5), monkeypatch)[0]
    features = ["specialty_code", *models.SIX]
    assert seen.count() == seen.select(*features).distinct().count() < train.count() / 2
    assert seen.agg(F.sum("weight")).first()[0] == train.count()
    got = lines(models.boosted_prep(train, test, iterations=5))["boosted trees"]
    plain, unseen = mean_coded(cut(train), test, {"specialty": "specialty_code"}, "patient_prep_min")
    learner = models.GBTRegressor(labelCol="patient_prep_min", maxIter=5, maxBins=128, seed=models.SEED)
    want = models._quality([models.VectorAssembler(inputCols=features, outputCol="features")], learner, cut(plain), unseen, "patient_prep_min", "all")
    assert [got.mae, got.r2, got.bias] == pytest.approx([want.first().mae, want.first().r2, want.first().bias], abs=1e-9)


def test_cells_without_target_are_no_guess(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, None), (3.0, 4.0), (3.0, 8.0)], "x double, y double")
    assert {tuple(r) for r in models.feature_cells(rows, ["x"], "y").collect()} == {(1.0, None, 2.0), (3.0, 6.0, 2.0)}


def test_prep_forest_gets_tasks_of_even_size(spark, monkeypatch):
    rows = spark.range(4000).selectExpr(*[f"id % {k} AS {f}" for k, f in enumerate(models.PREP_FEATURES, 2)], "id % 31 AS actual_prep_min").coalesce(3)
    monkeypatch.setattr(models, "TREE_ROWS", 300)
    monkeypatch.setattr(models, "EVEN_ROWS", 1000)
    given = _read_by_learner(spark, lambda: models.fit_forest(rows, trees=2, depth=2), monkeypatch)[0]
    sizes = given.rdd.glom().map(len).collect()
    assert sum(sizes) == 4000 and len(sizes) % spark.sparkContext.defaultParallelism == 0 and max(sizes) <= 320
