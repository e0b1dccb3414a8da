"""Two calibrated forests, one per arm, and the uplift between them.

Everything is fitted by Spark ML on distributed frames. Results resemble those
of a single-machine forest with the same settings but are not bit-equal.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    PCA, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer,
    VarianceThresholdSelector, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlift.functions.expressions import uplift
from cohortlift.operators.binning import assign_bins, quantile_edges_of
from cohortlift.operators.features import CATEGORIES, feature_columns
from cohortlift.operators.forests import Trees, flat_trees, scored_by_all, scored_by_own
from cohortlift.operators.numbering import (
    number_rows, partition_count, use_checkpoint_folder)
from cohortlift.operators.oversampling import oversample
from cohortlift.plans.calibration import fit_sigmoids
from cohortlift.plans.export import SCORE_COLUMNS
from cohortlift.plans.frames import KEYS, split_by_arm

FEATURES = "_features"
# Of a component of unit-variance numbers; below that it is rounding noise.
LEAST_VARIANCE = 1e-9


@dataclass(frozen=True)
class ForestSettings:
    """Forest and calibration parameters.

    ``split_share`` is the least share of the rows a node needs to be split.
    Spark has no such setting; it limits the children instead, to half of it.
    With ``oversampled`` the rarer class is filled up by synthetic rows first.
    ``fit_tasks`` is part of the model: Spark draws a tree's rows partition by
    partition, so the same rows are always dealt to as many partitions, by a
    hash of their ids, whatever their number or the session's settings. Set it
    once for the size of a deployment. ``max_bins`` is the number of values
    that a numeric feature is cut into when splits are searched.
    """
    trees: int = 120
    split_share: float = 0.03
    folds: int = 8
    oversampled: bool = False
    max_depth: int = 30
    seed: int = 1234
    parallel_folds: int = 8
    fit_tasks: int = 8
    max_bins: int = 32


# Fixed values of the two variants in use.
PRODUCTION = ForestSettings()
STAGING = ForestSettings(trees=150, split_share=0.05, folds=5, oversampled=True)


def preparation(columns: list[str]) -> Pipeline:
    """Categories to 0/1 columns, numbers to components, then products of pairs.

    A category not seen in training gets the indexer's extra last slot, which
    the encoder drops, so it becomes all zeros.
    """
    categories = [c for c in columns if c in CATEGORIES]
    numbers = sorted(set(columns) - set(categories))
    indexes, slots = [f"_{c}_index" for c in categories], [f"_{c}_slots" for c in categories]
    return Pipeline(stages=[
        StringIndexer(inputCols=categories, outputCols=indexes, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexes, outputCols=slots, dropLast=True),
        VectorAssembler(inputCols=numbers, outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        PCA(inputCol="_scaled", outputCol="_components", k=len(numbers)),
        VarianceThresholdSelector(featuresCol="_components", outputCol="_varying",
                                  varianceThreshold=LEAST_VARIANCE),
        VectorAssembler(inputCols=slots + ["_varying"], outputCol="_joined"),
        PolynomialExpansion(degree=2, inputCol="_joined", outputCol=FEATURES),
    ])


def forest(settings: ForestSettings, label: str) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES, labelCol=label, numTrees=settings.trees,
        maxDepth=settings.max_depth, maxBins=settings.max_bins, featureSubsetStrategy="sqrt",
        minWeightFractionPerNode=settings.split_share / 2, seed=settings.seed,
        # Only the probability is used; empty names skip the other outputs.
        probabilityCol="_probability", rawPredictionCol="", predictionCol="")


def _raw_score(model: RandomForestClassificationModel, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(
        name, vector_to_array("_probability")[1]).drop("_probability")


@dataclass
class PropensityModel:
    """Feature preparation and one (forest, slope, intercept) per fold.

    ``trees`` holds the forests as arrays, unless they are too large to be sent
    to every task.
    """
    preparation: PipelineModel
    members: list[tuple[RandomForestClassificationModel, float, float]]
    trees: Trees | None = None

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """Add the mean of the calibrated fold probabilities."""
        keep = df.columns
        scored = self.preparation.transform(df).select(*keep, FEATURES)
        if self.trees is not None:
            scored = scored_by_all(scored, vector_to_array(FEATURES), self.trees, "_raws")
            raws = [F.col("_raws")[index] for index in range(len(self.members))]
        else:
            for index, (model, _, _) in enumerate(self.members):
                scored = _raw_score(model, scored, f"_raw{index}")
            raws = [F.col(f"_raw{index}") for index in range(len(self.members))]
        calibrated = [1 / (1 + F.exp(-(raw * slope + intercept)))
                      for raw, (_, slope, intercept) in zip(raws, self.members)]
        mean = sum(calibrated[1:], calibrated[0]) / len(calibrated)
        return scored.select(*keep, mean.alias(name))


def _held_out_scores(dealt: DataFrame, label: str, models: list, trees: Trees | None) -> DataFrame:
    """Each row's raw score by the forest that has not seen it: _fold, label, _raw."""
    if trees is not None:
        return scored_by_own(dealt, vector_to_array(FEATURES), "_fold", trees, "_raw").select("_fold", label, "_raw")
    parts = [_raw_score(model, dealt.filter(F.col("_fold") == fold), "_raw").select("_fold", label, "_raw")
             for fold, model in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def _in_folds(ready: DataFrame, label: str, folds: int, tasks: int, ids: list[str]) -> DataFrame:
    """Deal rows to folds so that each gets its share of both classes.

    Rows are numbered by class and, inside a class, by a hash of their ids;
    taking turns along that order is stratified. They are then dealt to
    ``tasks`` partitions by the same hash, sorted and stored, so that every
    fit sees the same rows in the same order in the same partition.
    """
    shuffled = ready.withColumn("_mix", F.xxhash64(*ids))
    numbered, _ = number_rows(shuffled, label, "_mix", *ids, name="_turn")
    return numbered.select(
        FEATURES, label, "_mix", *ids, (F.col("_turn") % folds).cast("int").alias("_fold")
    ).repartition(tasks, "_mix").sortWithinPartitions("_mix", *ids).select(
        FEATURES, label, "_fold").checkpoint()


def fit_propensity(train: DataFrame, label: str, settings: ForestSettings = PRODUCTION) -> PropensityModel:
    """Fit per fold: a forest on the other folds, a sigmoid on this one.

    The sigmoids of all folds are fitted together, a pass per step.
    """
    use_checkpoint_folder(train.sparkSession)
    columns = feature_columns(train.columns)
    ids = KEYS
    if settings.oversampled:
        numbers = [c for c in columns if c not in CATEGORIES]
        # Synthetic rows have no user; they are numbered once and stored.
        ids = ["_row_id"]
        train = oversample(train, label, numbers, CATEGORIES, seed=settings.seed).withColumn(
            "_row_id", F.monotonically_increasing_id()).checkpoint()
    # Sums behind the preparation are rounded partition by partition as well.
    train = (
        train.repartition(settings.fit_tasks, F.xxhash64(*ids))
        .sortWithinPartitions(*ids).checkpoint()
    )
    prepared = preparation(columns).fit(train)
    ready = prepared.transform(train).select(
        *ids, F.col(FEATURES), F.col(label).cast("double").alias(label))
    dealt = _in_folds(ready, label, settings.folds, settings.fit_tasks, ids)

    sizes = {(r["_fold"], int(r[label])): r["count"]
             for r in dealt.groupBy("_fold", label).count().collect()}
    for value in (0, 1):
        held = sum(n for (_, cls), n in sizes.items() if cls == value)
        if held < settings.folds:
            raise ValueError(f"{held} rows with {label} = {value} for {settings.folds} folds")

    @inheritable_thread_target(train.sparkSession)
    def fit(fold: int):
        return forest(settings, label).fit(dealt.filter(F.col("_fold") != fold))

    with ThreadPool(min(settings.parallel_folds, settings.folds)) as pool:
        models = pool.map(fit, range(settings.folds))
    trees = flat_trees(train.sparkSession, models)
    held_out = _held_out_scores(dealt, label, models, trees).checkpoint()
    sigmoids = fit_sigmoids(held_out, label, "_raw", ["_fold"])
    members = [(model, sigmoids[fold,].slope, sigmoids[fold,].intercept) for fold, model in enumerate(models)]
    return PropensityModel(prepared, members, trees)


def fit_both_arms(labelled: DataFrame, settings: ForestSettings = PRODUCTION):
    """Models of response with the offer (TR) and without it (CR).

    The labelled users are stored first: every stage of the preparation passes
    over them, and none of that should repeat the joins behind them.
    """
    spark = labelled.sparkSession
    use_checkpoint_folder(spark)
    treatment, control = split_by_arm(labelled.checkpoint())
    arms = [(treatment, "experiment_group_TR"), (control, "experiment_group_CR")]

    @inheritable_thread_target(spark)
    def fit(arm):
        return fit_propensity(*arm, settings)

    # A fit is a chain of short jobs; side by side they fill a cluster better.
    with ThreadPool(2) as pool:
        return tuple(pool.map(fit, arms))


def add_uplift(df: DataFrame) -> DataFrame:
    """The two opposite propensities and the uplift score."""
    tr, cr = F.col("propensity_TR"), F.col("propensity_CR")
    return df.withColumns({
        "propensity_TN": 1 - tr, "propensity_CN": 1 - cr, "uplift_score": uplift(tr, cr)})


def score_users(frame: DataFrame, treatment: PropensityModel, control: PropensityModel) -> DataFrame:
    """Propensities and uplift; stored once, since binning reads them often.

    Rows are few bytes but pass through thousands of trees, so partitions sized
    by bytes would hold far too much work. They are spread evenly first.
    """
    spark = frame.sparkSession
    use_checkpoint_folder(spark)
    spread = frame.repartition(partition_count(spark))
    scored = control.score(treatment.score(spread, "propensity_TR"), "propensity_CR")
    return add_uplift(scored).checkpoint()


def bin_scores(scored: DataFrame, columns: list[str] = ("uplift_score",), q: int = 10, *,
               falling: bool = False, duplicates: str = "raise") -> DataFrame:
    """Add ``{column}_bin`` by quantiles, numbered upward unless ``falling``."""
    edges = quantile_edges_of(scored, columns, q, duplicates)
    return scored.withColumns({
        f"{column}_bin": assign_bins(column, edges[column], falling=falling) for column in edges})


def score_table(scored: DataFrame, run_date: dt.date | None = None) -> DataFrame:
    """The columns of the score table; the signup date becomes text."""
    day = F.current_date() if run_date is None else F.lit(run_date)
    return scored.withColumns({
        "signup_date": F.date_format("signup_date", "yyyy-MM-dd"), "run_date": day,
    }).select(*SCORE_COLUMNS)


def grid_search(train: DataFrame, label: str, trees=(200, 400, 600), depths=(6, 8, 10, 12),
                folds: int = 5, settings: ForestSettings = PRODUCTION) -> CrossValidatorModel:
    """Forest size and depth by cross-validated accuracy.

    With one label per row, micro-averaged F1 is the accuracy.
    """
    columns = feature_columns(train.columns)
    classifier = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=label, featureSubsetStrategy="sqrt", seed=settings.seed)
    grid = (ParamGridBuilder().addGrid(classifier.numTrees, list(trees))
            .addGrid(classifier.maxDepth, list(depths)).build())
    prepared = preparation(columns).fit(train)
    ready = prepared.transform(train).select(FEATURES, F.col(label).cast("double").alias(label))
    return CrossValidator(
        estimator=classifier, estimatorParamMaps=grid, numFolds=folds, seed=settings.seed,
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy"),
        parallelism=settings.parallel_folds).fit(ready)
