"""Duration models with Spark ML.

Features are columns; fitting, scoring and quality stay distributed. Only fitted
model sizes (importances, coefficients) reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import (
    PCA,
    HashingTF,
    Interaction,
    OneHotEncoder,
    RegexTokenizer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.functions import share, with_measures, within
from slotwise.functions.flags import flag_vector
from slotwise.operators import encode, keep_matching, mean_coded, prediction_quality, top, value_codes
from slotwise.session import cut, dealt

# The features of the published prep model.
PLACE_FEATURES = (
    "staff_count", "resource_count", "has_anesthesia", "is_first_of_day", "is_last_of_day",
    "position", "total_cases_that_day",
)
PREP_FEATURES = ("procedure_code", *PLACE_FEATURES)
PREP_FEATURES_WITH_AGE = (*PREP_FEATURES, "patient_age")
SEED = 42
# MB of sums that a task gathers at a time. Beyond what a core's cache holds every row
# misses it once per tree and feature; the nodes are worked off in more passes with equal results.
NODE_MB = 8
# Trees send sums per task and node, so their tasks are larger than others; from the second number of rows on all are dealt evenly.
TREE_ROWS, EVEN_ROWS = 250_000, 100_000


def temporal_split(rows: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the date, and from it on."""
    day = F.lit(cutoff).cast("date")
    return rows.where(F.col("date") < day), rows.where(F.col("date") >= day)


def split_sizes(rows: DataFrame, cutoff: str) -> DataFrame:
    """Rows of both parts, counted in one pass."""
    day = F.lit(cutoff).cast("date")
    sides = {"train": F.col("date") < day, "test": F.col("date") >= day}
    counted = [F.struct(F.lit(name).alias("part"), F.count_if(side).alias("n")) for name, side in sides.items()]
    return rows.agg(F.array(*counted).alias("parts")).select(F.inline("parts"))


def known_procedure_test(train: DataFrame, test: DataFrame, min_rows: int = 20, k: int = 20) -> DataFrame:
    """Test means of the procedures that training has seen."""
    seen = train.where(F.col("procedure_name").isNotNull()).select("procedure_name").distinct()
    table = (
        keep_matching(test, seen, ["procedure_name"])
        .groupBy("procedure_name")
        .agg(
            F.count("actual_prep_min").alias("n_test"),
            F.avg("actual_prep_min").alias("mean_actual_prep"),
            F.avg("planned_prep_min").alias("mean_planned_prep"),
        )
        .where(F.col("n_test") >= min_rows)
    )
    return top(table, k, "n_test", "procedure_name")


def encode_procedures(
    train: DataFrame, test: DataFrame, encoding: str = "code", target: str = "actual_prep_min"
) -> tuple[DataFrame, DataFrame]:
    """``procedure_code`` on both parts, known from training only.

    ``code`` numbers the names, -1 for unseen ones; the number is arbitrary but
    taken as ordered by trees. ``mean`` uses means of ``target`` instead, as
    :func:`slotwise.operators.mean_coded` does.
    """
    if encoding == "code":
        codes = cut(value_codes(train, "procedure_name", "procedure_code"))
        return tuple(encode(d, codes, "procedure_name", "procedure_code") for d in (train, test))
    return mean_coded(train, test, {"procedure_name": "procedure_code"}, target)


def _features(rows: DataFrame, features: Sequence[str], *more: str) -> DataFrame:
    """Complete rows with every feature as a double."""
    return rows.dropna(subset=[*features, *more]).withColumns({f: F.col(f).cast("double") for f in features})


def fit_forest(
    train: DataFrame,
    features: Sequence[str] = PREP_FEATURES,
    target: str = "actual_prep_min",
    trees: int = 100,
    depth: int = 8,
    seed: int = SEED,
) -> PipelineModel:
    # Trees draw their samples by partition and row order, so the rows are fixed first.
    rows = dealt(_features(train, features, target).select(*features, F.col(target).cast("double")), TREE_ROWS, EVEN_ROWS)
    forest = RandomForestRegressor(
        labelCol=target, featuresCol="features", predictionCol="predicted_prep", numTrees=trees,
        maxDepth=depth, maxBins=128, featureSubsetStrategy="all", seed=seed, maxMemoryInMB=NODE_MB,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, features: Sequence[str] = PREP_FEATURES) -> DataFrame:
    """``rows`` with prediction, remaining gap and absolute error."""
    scored = model.transform(_features(rows, features, "actual_prep_min", "planned_prep_min"))
    gap = F.col("actual_prep_min") - F.col("predicted_prep")
    return scored.drop("features").withColumns({"predicted_gap": gap, "model_error": F.abs(gap)})


def compare_with_schedule(scored: DataFrame) -> DataFrame:
    """Error of the schedule and of the model on the same rows."""
    # Rows are scored once; both lines read the three numbers.
    scored = cut(scored.select("actual_prep_min", "planned_prep_min", "predicted_prep"))
    lines = [
        prediction_quality(scored, "actual_prep_min", c).withColumn("prediction", F.lit(name))
        for name, c in (("schedule", "planned_prep_min"), ("model", "predicted_prep"))
    ]
    return lines[0].unionByName(lines[1])


def compare_by_first(scored: DataFrame) -> DataFrame:
    return scored.groupBy((F.col("is_first_of_day") == 1).alias("is_first")).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("actual_prep_min", "predicted_prep", "planned_prep_min")],
    )


def feature_importance(model: PipelineModel, rows: DataFrame, features: Sequence[str] = PREP_FEATURES) -> DataFrame:
    """One row per feature; ``rows`` only lends its session."""
    weights = model.stages[-1].featureImportances.toArray()
    return rows.sparkSession.createDataFrame(
        [(f, float(w)) for f, w in zip(features, weights)], "feature string, importance double"
    )


def prep_forest(train: DataFrame, test: DataFrame, features: Sequence[str] = PREP_FEATURES, **forest):
    """Fit on the train part, score the test part: model and scored rows."""
    train, test = encode_procedures(train, test)
    model = fit_forest(train, features, **forest)
    return model, score(model, test, features)


def procedure_forest(
    train: DataFrame, test: DataFrame, name: str, min_train: int = 50, **forest
) -> DataFrame:
    """Schedule, general model and a model of one procedure on its test rows.

    Empty where training has fewer than ``min_train`` rows of the procedure.
    """
    own = F.col("procedure_name") == name
    general = cut(prep_forest(train, test, **forest)[1].where(own))
    lines = [("schedule", general, "planned_prep_min"), ("general model", general, "predicted_prep")]
    own_train = train.where(own)
    if own_train.count() < min_train:
        lines = [(n, d.where(F.lit(False)), c) for n, d, c in lines]
    else:
        model = fit_forest(own_train, PLACE_FEATURES, **forest)
        lines.append(("procedure model", score(model, test.where(own), PLACE_FEATURES), "predicted_prep"))
    out = [
        prediction_quality(d, "actual_prep_min", c).withColumn("prediction", F.lit(n)).where(F.col("n") > 0)
        for n, d, c in lines
    ]
    table = out[0]
    for line in out[1:]:
        table = table.unionByName(line)
    return table


# --- patient prep and time in the room --------------------------------------------


def model_rows(
    cases: DataFrame, target: str = "patient_prep_min", bounds: tuple[float, float] = (0, 240), flags: bool = False
) -> DataFrame:
    """Complete rows for the models below, with ``target`` inside its bounds.

    Staff and equipment flags, often hundreds of columns, only with ``flags``.
    """
    rows = with_measures(
        cases, "patient_prep_min", "actual_inor_min", "planned_inor_min", "actual_prep_min",
        "planned_prep_min", "staff_count", "resource_count", "has_anesthesia",
    )
    numeric = ["patient_age", "is_acute", "has_anesthesia", "staff_count", "resource_count", "planned_inor_min"]
    rows = rows.where(within(F.col(target), bounds)).dropna(subset=["specialty", "patient_age", "is_acute", "planned_inor_min"])
    each = [c for c in cases.columns if flags and c.startswith(("staff_", "resource_"))]
    texts = ["case_id", "date", "specialty", "diagnosis_group", "procedure_text_id", "overtime_minutes"]
    measured = ["patient_prep_min", "actual_inor_min", "actual_prep_min", "planned_prep_min"]
    return rows.withColumns({c: F.col(c).cast("double") for c in [*numeric, target]}).select(
        *texts, *measured, *numeric, *each
    )


def _coded(*columns: str) -> list:
    return [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in columns]


def _codes(*columns: str) -> dict[str, str]:
    return {c: f"{c}_code" for c in columns}


def _one_hot(*columns: str) -> list:
    return [
        *_coded(*columns),
        OneHotEncoder(inputCols=[f"{c}_index" for c in columns], outputCols=[f"{c}_hot" for c in columns]),
    ]


def _quality(stages: list, learner, train: DataFrame, test: DataFrame, target: str, name: str) -> DataFrame:
    """Fit and judge. Learners pass over ``train`` many times: give rows made once."""
    model = Pipeline(stages=[*stages, learner]).fit(train)
    scored = model.transform(test)
    return prediction_quality(scored, target, learner.getPredictionCol()).withColumn("model", F.lit(name))


SIX = ("has_anesthesia", "staff_count", "resource_count", "patient_age", "is_acute")


def feature_cells(rows: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Rows with the same features as one, with their mean ``target`` and their number, ``weight``.

    Boosting without subsampling treats such rows alike in every round, and splits
    by squared error compare sums of weights and weighted targets, so the weighted
    means give the trees of the rows, but for exact ties between splits, which the last
    bits decide. A target that is null in a row is null in its cell.
    """
    whole = F.count(target) == F.count("*")
    return rows.groupBy(*features).agg(
        F.when(whole, F.avg(target)).alias(target), F.count("*").cast("double").alias("weight"))


def boosted_prep(train: DataFrame, test: DataFrame, iterations: int = 200, target: str = "patient_prep_min") -> DataFrame:
    """Gradient-boosted trees on specialty, anesthesia, counts, age and acute flag.

    Many rows are fitted as their ``feature_cells``, fewer as they are.
    """
    train, test = mean_coded(cut(train.select("case_id", "specialty", *SIX, target)), test, _codes("specialty"), target)
    features = ["specialty_code", *SIX]
    stages = [VectorAssembler(inputCols=features, outputCol="features")]
    learner = GBTRegressor(labelCol=target, weightCol="weight", maxIter=iterations, maxBins=128, seed=SEED)
    train = cut(train.select(*features, target).withColumn("weight", F.lit(1.0)))
    if train.count() > EVEN_ROWS:
        train = dealt(feature_cells(train, features, target), TREE_ROWS, EVEN_ROWS)
    return _quality(stages, learner, train, test, target, "boosted trees")


def linear_prep(
    train: DataFrame, test: DataFrame, target: str = "patient_prep_min", penalty: float = 1e-6
) -> DataFrame:
    """Linear models with growing feature sets, one row each."""
    hot = _one_hot("specialty")
    crossed = Interaction(inputCols=["specialty_hot", "has_anesthesia"], outputCol="crossed")
    sets = {
        "specialty + anesthesia": ["specialty_hot", "has_anesthesia"],
        "with interaction": ["specialty_hot", "has_anesthesia", "crossed"],
        "with age and acute": ["specialty_hot", "has_anesthesia", "patient_age", "is_acute"],
        "with staff and equipment": ["specialty_hot", "has_anesthesia", "staff_count", "resource_count"],
    }
    train, test = cut(train), cut(test)
    lines = []
    for name, columns in sets.items():
        stages = [*hot, crossed, VectorAssembler(inputCols=columns, outputCol="features")]
        learner = LinearRegression(labelCol=target, regParam=penalty)
        lines.append(_quality(stages, learner, train, test, target, name))
    table = lines[0]
    for line in lines[1:]:
        table = table.unionByName(line)
    return table


def _with_flags(*parts: DataFrame) -> tuple[list[DataFrame], int]:
    """The parts with one vector of all flags, and its length."""
    vector, length = flag_vector(parts[0])
    return [d.withColumn("flags", vector) for d in parts], length


def component_linear_prep(
    train: DataFrame, test: DataFrame, k: int = 50, target: str = "patient_prep_min"
) -> DataFrame:
    """Linear model on specialty, anesthesia, age and components of all flags."""
    (train, test), width = _with_flags(train, test)
    stages = [
        *_one_hot("specialty"),
        PCA(k=min(k, width), inputCol="flags", outputCol="components"),
        VectorAssembler(inputCols=["specialty_hot", "has_anesthesia", "patient_age", "components"], outputCol="features"),
    ]
    return _quality(stages, LinearRegression(labelCol=target, regParam=1e-6), cut(train), test, target, "components")


def components_tell_specialty(train: DataFrame, test: DataFrame, k: int = 20) -> DataFrame:
    """Accuracy of specialty from the components of all flags."""
    (train, test), width = _with_flags(train, test)
    model = Pipeline(stages=[
        StringIndexer(inputCol="specialty", outputCol="label", handleInvalid="keep"),
        PCA(k=min(k, width), inputCol="flags", outputCol="features"),
        LogisticRegression(maxIter=50),
    ]).fit(cut(train))
    hit = F.col("prediction") == F.col("label")
    return model.transform(test).agg(F.count("*").alias("n"), share(hit).alias("accuracy_pct"))


def complexity_tiers(rows: DataFrame, k: int = 3) -> DataFrame:
    """Clusters of cases by staff, equipment, prep, overtime and specialty, and whether
    planned prep follows them."""
    numbers = ["staff_count", "resource_count", "actual_prep_min", "overtime_minutes"]
    known = rows.dropna(subset=numbers).withColumns({c: F.col(c).cast("double") for c in numbers})
    known = dealt(known.select("specialty", "planned_prep_min", *numbers))
    model = Pipeline(stages=[
        *_one_hot("specialty"),
        VectorAssembler(inputCols=[*numbers, "specialty_hot"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        KMeans(k=k, seed=SEED, predictionCol="tier"),
    ]).fit(known)
    tiered = model.transform(known)
    quality = ClusteringEvaluator(predictionCol="tier").evaluate(tiered)
    return tiered.groupBy("tier").agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"mean_{c}") for c in [*numbers, "planned_prep_min"]],
    ).withColumn("silhouette", F.lit(quality))


def overrun_classifier(train: DataFrame, test: DataFrame, depth: int = 4) -> DataFrame:
    """Shallow tree for overtime above zero: counts of each outcome and the tree's size."""
    columns = ["specialty_code", "diagnosis_group_code", *SIX, "planned_inor_min"]
    label = (F.col("overtime_minutes") > 0).cast("double")
    parts = [d.where(F.col("overtime_minutes").isNotNull()).withColumn("label", label) for d in (train, test)]
    parts = mean_coded(cut(parts[0]), parts[1], _codes("specialty", "diagnosis_group"), "label")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=columns, outputCol="features"),
        DecisionTreeClassifier(maxDepth=depth, maxBins=256, seed=SEED),
    ]).fit(cut(parts[0]))
    return model.transform(parts[1]).groupBy("label", "prediction").agg(F.count("*").alias("n"))


def inor_regression(train: DataFrame, test: DataFrame, trees: int = 100, depth: int = 8) -> DataFrame:
    """Total time in the room from everything known before the day, against the slot."""
    target = "actual_inor_min"
    coded = ["procedure_text_id", "specialty", "diagnosis_group"]
    features = [*[f"{c}_code" for c in coded], *SIX]
    stages = [VectorAssembler(inputCols=features, outputCol="features")]
    learner = RandomForestRegressor(
        labelCol=target, numTrees=trees, maxDepth=depth, maxBins=128, seed=SEED, featureSubsetStrategy="all",
        maxMemoryInMB=NODE_MB,
    )
    train, test = (cut(d.select("case_id", *coded, *SIX, "planned_inor_min", target)) for d in (train, test))
    train, test = mean_coded(train, test, _codes(*coded), target)
    train = dealt(train.select(*features, target), TREE_ROWS, EVEN_ROWS)
    fitted = _quality(stages, learner, train, test, target, "forest")
    slot = prediction_quality(test, target, "planned_inor_min").withColumn("model", F.lit("planned slot"))
    return fitted.unionByName(slot)


def text_features(train: DataFrame, test: DataFrame, size: int = 256, target: str = "patient_prep_min") -> DataFrame:
    """Does the wording of the procedure add to the structured features?"""
    words = [
        RegexTokenizer(inputCol="procedure_text_id", outputCol="words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="words", outputCol="word_counts", numFeatures=size),
    ]
    parts = [cut(d.where(F.col("procedure_text_id").isNotNull())) for d in (train, test)]
    base = ["specialty_hot", *SIX]
    lines = []
    for name, more in (("structured", []), ("structured + text", ["word_counts"])):
        stages = [*_one_hot("specialty"), *words, VectorAssembler(inputCols=[*base, *more], outputCol="features")]
        learner = LinearRegression(labelCol=target, regParam=1e-3)
        lines.append(_quality(stages, learner, *parts, target, name))
    return lines[0].unionByName(lines[1])
