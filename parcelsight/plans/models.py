"""Preprocessing and tree models on order-grouped splits.

Fitting reads its input several times, so callers stage the feature frame first
(``staged_frame``). What reaches the driver is bounded by the number of columns
(fill constants) or by the model size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from parcelsight.functions.expressions import clip
from parcelsight.operators import impute, quality
from parcelsight.operators.quantiles import bounded_quantile, medians
from parcelsight.operators.splits import with_class_weight, with_split
from parcelsight.plans import boosting, histograms
from parcelsight.plans.features import positive_label
from parcelsight.sources.sinks import stage

SEED = 42


@dataclass(frozen=True)
class TreeSettings:
    """Size and learning settings of one boosted or bagged model."""

    rounds: int
    depth: int
    rate: float = 0.1
    min_rows: int = 1
    column_share: str = "all"
    row_share: float = 1.0


# Settings found for each model.
POST_DELIVERY = TreeSettings(800, 7, 0.014883605700319194, 47, "0.6218455076693483")
ORDER_TIME = TreeSettings(800, 5, 0.011153121252070788, 47, "0.5028265220878869")
BAGGED = TreeSettings(300, 10)
SECOND_BOOSTED = TreeSettings(1000, 7, 0.05, 1)
DELIVERY_DAYS = TreeSettings(700, 6, 0.03, 40)
SCORE_REGRESSION = TreeSettings(1300, 4, 0.03078, 20, "0.60638", 0.8733)


# Rounds without a better validation loss after which boosting ends.
PATIENCE = 30
# Training rows from which trees are fitted on packed rows: Spark's own learner keeps several hundred bytes of each.
PACKED_FROM = 100_000
# Trees of a forest that are fitted together. A learner keeps a count for each of them with every cached row.
TREES_AT_ONCE = 50


def staged_frame(frame: DataFrame, label: str, portable: bool = False) -> DataFrame:
    """The feature frame with binary label and split, written once for all fits."""
    labelled = frame.withColumn("label", positive_label("review_score"))
    return stage(with_split(labelled, portable=portable), label)


# --- preprocessing -----------------------------------------------------------------------

def fill_constants(train: DataFrame, numeric: Sequence[str],
                   categorical: Sequence[str]) -> dict[str, float | str]:
    """Exact medians and modes of the training rows, one scalar per column.

    Whole-number columns (flags, months, day counts) have few distinct values
    and share one plain aggregate; only continuous ones are ranked.
    """
    constants: dict[str, float | str] = {}
    whole = [c for c in numeric if isinstance(train.schema[c].dataType, T.IntegerType)]
    continuous = [c for c in numeric if c not in whole]
    if whole:
        constants.update(train.agg(
            *[bounded_quantile(c, 0.5).alias(c) for c in whole]).first().asDict())
    if continuous:
        constants.update(medians(train, continuous).first().asDict())
    if categorical:
        long = train.select(*categorical).unpivot([], list(categorical), "column", "value")
        constants.update({r["column"]: r["value"]
                          for r in impute.modes(long, ["column"], "value").collect()})
    return {c: v for c, v in constants.items() if v is not None}


def _filling(constants: dict, numeric: Sequence[str], categorical: Sequence[str]) -> SQLTransformer:
    """Fill constants as a pipeline stage, so that they are saved with the model."""
    def literal(value) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(
            value, str) else repr(float(value)) + "D"

    parts = [f"coalesce(CAST(`{c}` AS DOUBLE), {literal(constants.get(c, 0.0))}) AS `{c}__filled`"
             for c in numeric]
    parts += [f"coalesce(`{c}`, {literal(constants.get(c, ''))}) AS `{c}__filled`"
              for c in categorical]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_preprocessing(train: DataFrame, features: Sequence[str], scale: bool = False,
                      drop_first: bool = False) -> PipelineModel:
    """Median and mode filling, one-hot coding, one sparse ``features`` vector.

    Categories unseen in training get an all-zero code. With ``drop_first`` the
    first level also has no slot of its own (dummy coding).
    """
    numeric, categorical = quality.split_by_type(train.select(*features))
    stages = [_filling(fill_constants(train, numeric, categorical), numeric, categorical)]
    filled = lambda names: [f"{c}__filled" for c in names]
    inputs = filled(numeric)
    if scale and numeric:
        stages += [VectorAssembler(inputCols=inputs, outputCol="numeric__vector"),
                   StandardScaler(inputCol="numeric__vector", outputCol="numeric__scaled",
                                  withMean=True)]
        inputs = ["numeric__scaled"]
    if categorical:
        indexed = [f"{c}__index" for c in categorical]
        coded = [f"{c}__code" for c in categorical]
        # 'keep' adds a last slot for unseen values, and dropLast removes exactly it;
        # without 'keep' in dummy coding, descending order makes the first level last
        stages += [
            StringIndexer(inputCols=filled(categorical), outputCols=indexed,
                          handleInvalid="error" if drop_first else "keep",
                          stringOrderType="alphabetDesc" if drop_first else "alphabetAsc"),
            OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True)]
        inputs = inputs + coded
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return Pipeline(stages=stages).fit(train)


def encoded(preprocessing: PipelineModel, frame: DataFrame) -> DataFrame:
    """The frame with its feature vector and without the intermediate columns."""
    return preprocessing.transform(frame).select(*frame.columns, "features")


# --- models ------------------------------------------------------------------------------

def boosted_classifier(settings: TreeSettings, **extra) -> GBTClassifier:
    return GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=settings.rounds,
        maxDepth=settings.depth, stepSize=settings.rate, minInstancesPerNode=settings.min_rows,
        featureSubsetStrategy=settings.column_share, seed=SEED, checkpointInterval=20, **extra)


def forest_classifier(settings: TreeSettings, label: str = "label",
                      weight: str | None = "weight") -> RandomForestClassifier:
    model = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=settings.rounds, maxDepth=settings.depth,
        minInstancesPerNode=settings.min_rows, featureSubsetStrategy="sqrt", seed=SEED)
    return model.setWeightCol(weight) if weight else model


def with_probability(model, frame: DataFrame, out: str = "probability_positive") -> DataFrame:
    """The probability of class 1 from a fitted classifier."""
    raw = model.transform(frame)
    return raw.withColumn(out, vector_to_array("probability")[1]).drop(
        "rawPrediction", "probability", "prediction")


def fit_classifier(train: DataFrame, estimator):
    """Fit on encoded training rows with balanced class weights."""
    weighted = with_class_weight(train)
    if isinstance(estimator, RandomForestClassifier):
        return fit_forest(estimator, weighted)
    return estimator.fit(weighted)


@dataclass(frozen=True)
class Boosted:
    """A boosted model, the round that the validation rows chose, and their loss after each round."""

    model: object
    rounds: int
    losses: list[float]


def fit_patient(train: DataFrame, valid: DataFrame, settings: TreeSettings, target: str | None = None,
                patience: int = PATIENCE) -> Boosted:
    """Boosting with the declared settings that ends once the validation loss says so.

    Every round is fitted once, to the gradients at a staged margin, until ``patience`` rounds have passed without a
    better loss or the declared number is reached; the trees up to the best round are the model. Without ``target`` it is a
    classifier of ``label`` with a class-balanced loss, with it a regressor of that column by squared error.
    With ``PACKED_FROM`` training rows or more it is fitted on packed rows (``plans/histograms.py``).
    """
    size = dict(rounds=settings.rounds, depth=settings.depth, rate=settings.rate, min_rows=settings.min_rows,
                column_share=settings.column_share, row_share=settings.row_share, seed=SEED, patience=patience)
    if target is None and train.where("label IN (0, 1)").count() >= PACKED_FROM:
        found = histograms.boost(train, valid, **size)
        return Boosted(boosting.as_classifier(found), len(found.trees), found.losses)
    if target is None:
        train, valid = with_class_weight(train), with_class_weight(valid)
    else:
        train, valid = (x.select("features", F.col(target).alias("label"), F.lit(1.0).alias("weight")).na.drop()
                        for x in (train, valid))
        if train.count() >= PACKED_FROM:
            found = histograms.boost(train, valid, **size, aim="squared")
            return Boosted(boosting.as_regressor(found), len(found.trees), found.losses)
    found = boosting.boost(train, valid, boosting.LOGISTIC if target is None else boosting.SQUARED, **size)
    model = boosting.as_classifier(found) if target is None else boosting.as_regressor(found)
    return Boosted(model, found.rounds, found.losses)


def learning_curve(model, train: DataFrame, valid: DataFrame) -> DataFrame:
    """Class-balanced loss after each boosting round on both sides."""
    losses = zip(model.evaluateEachIteration(with_class_weight(train)),
                 model.evaluateEachIteration(with_class_weight(valid)))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(losses, 1)]
    return train.sparkSession.createDataFrame(
        rows, "iteration int, train_loss double, valid_loss double")


def fit_forest(estimator, train: DataFrame, at_once: int = TREES_AT_ONCE):
    """A forest of any size, fitted some trees at a time with seeds of their own on all rows of ``train``.

    Fitted at once, its cached rows would grow with the number of trees and leave memory. With ``PACKED_FROM`` rows or more
    it is fitted on packed rows.
    """
    packed = packed_forest(estimator, train)
    if packed is not None:
        packed.rows.unpersist()
        return packed.model
    total = estimator.getNumTrees()
    groups = max(1, -(-total // at_once))
    if groups == 1:
        return estimator.fit(train)
    sizes = [total // groups + (i < total % groups) for i in range(groups)]
    parts = [estimator.copy({estimator.numTrees: n, estimator.seed: estimator.getSeed() + i}).fit(train)
             for i, n in enumerate(sizes)]
    return boosting.joined_forest(estimator, parts)


def packed_forest(estimator, train: DataFrame) -> histograms.Forest | None:
    """The forest fitted on packed rows, which its caller lets go; None where Spark's own learner is to fit it.

    That is so for few rows, for settings other than the size of the forest, the rows of a leaf and the columns of a split,
    and for weights that are not those of classes.
    """
    label, classes = F.col(estimator.getLabelCol()), None
    weight = estimator.getWeightCol() if estimator.isSet("weightCol") else None
    plain = {estimator.impurity: estimator.getImpurity() in ("gini", "variance"), estimator.bootstrap: estimator.getBootstrap(),
             estimator.subsamplingRate: estimator.getSubsamplingRate() == 1, estimator.minInfoGain: estimator.getMinInfoGain() == 0,
             estimator.minWeightFractionPerNode: estimator.getMinWeightFractionPerNode() == 0,
             estimator.maxBins: estimator.getMaxBins() == histograms.BINS}
    classifier = isinstance(estimator, RandomForestClassifier)
    if not all(plain.values()) or estimator.getMaxDepth() > 12 or weight and not classifier or train.count() < PACKED_FROM:
        return None
    if classifier:
        weights = F.col(weight) if weight else F.lit(1.0)
        found = train.groupBy(label.cast("double").alias("label")).agg(
            F.min(weights).alias("low"), F.max(weights).alias("high"), F.count("*").alias("n")).limit(33).collect()
        known = {r["label"]: r["low"] for r in found}
        if len(found) > 32 or any(r["label"] is None or r["label"] < 0 or r["label"] % 1 or r["low"] is None or r["low"] != r["high"]
                                  for r in found) or max(known) > 15:
            return None
        classes, rows = [known.get(float(k), 0.0) for k in range(int(max(known)) + 1)], sum(r["n"] for r in found)
    else:
        rows, missing = train.agg(F.count("*"), F.count_if(label.isNull())).first()
        if missing:
            return None
    return histograms.forest(train, estimator, rows, classes)


def feature_names(frame: DataFrame) -> list[str]:
    """Names of the slots of the feature vector, from its metadata."""
    groups = frame.schema["features"].metadata["ml_attr"]["attrs"].values()
    slots = sorted((a["idx"], a["name"]) for group in groups for a in group)
    return [name.replace("__filled", "").replace("__code", "") for _, name in slots]


def slot_means(frame: DataFrame) -> DataFrame:
    """Number of rows and mean of every slot of the feature vector; no row is multiplied by the slots."""
    summary = frame.select(Summarizer.metrics("count", "mean").summary(F.col("features")).alias("_s"))
    names = F.array(*map(F.lit, feature_names(frame)))
    return summary.select(F.col("_s.count").alias("rows"), F.posexplode(vector_to_array("_s.mean")).alias(
        "slot", "mean")).select("slot", "rows", "mean", F.element_at(names, F.col("slot") + 1).alias("feature"))


def feature_importance(model, frame: DataFrame) -> DataFrame:
    """Ranked importances with names."""
    weights = model.featureImportances.toArray()
    ranked = sorted(zip(feature_names(frame), map(float, weights)), key=lambda p: (-p[1], p[0]))
    rows = [(i, name, value) for i, (name, value) in enumerate(ranked, 1)]
    return frame.sparkSession.createDataFrame(
        rows, "rank int, feature string, importance double")


def score_forest(settings: TreeSettings) -> RandomForestRegressor:
    """The bagged regressor of the review score itself."""
    return RandomForestRegressor(
        featuresCol="features", labelCol="review_score", numTrees=settings.rounds,
        maxDepth=settings.depth, minInstancesPerNode=settings.min_rows, seed=SEED)


def clipped_prediction(model, frame: DataFrame) -> DataFrame:
    """Predicted score limited to the scale of 1 to 5."""
    return model.transform(frame).withColumn("prediction", clip("prediction", 1.0, 5.0))
