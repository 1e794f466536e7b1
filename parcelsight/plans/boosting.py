"""Boosting that goes on from a staged margin.

The rows carry the sum of the trees so far as a column, the margin. A round fits one Spark tree to the
gradients at this margin, whatever came before, so that boosting can end, or go on, after any round without
a fit that starts anew. Rounds come in blocks: within a block each margin is kept until the next one is made of
it, so that every pass of a fit applies no tree and every round applies one; at its end the margin is staged and the
validation loss after each round of the block is known.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import SparkContext, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.operators.metrics import pinball_loss
from parcelsight.sources.sinks import release, stage, stage_at

#: Rounds between two stagings of the margin, and rounds that one fit of Spark's own boosting opens with.
BLOCK_ROUNDS, OPENING_ROUNDS = 10, 50
#: Parts of a unit that leaf quantiles are rounded to, so that residuals have a bounded number of values.
GRID = 256


@dataclass(frozen=True)
class Loss:
    """What a booster minimises, as expressions of label and margin.

    target: what a tree is fitted to; value: the loss of a row. start: the first margin of all rows, or None where the
    first tree is fitted to the labels themselves and counts in full. quantile: leaves become this quantile of
    their residuals; without it they keep the tree's mean. own: Spark's estimator for this loss.
    """

    target: Callable[[Column, Column], Column]
    value: Callable[[Column, Column], Column]
    first: Callable[[Column], Column] | None = None
    quantile: float | None = None
    own: type | None = None


def _sign(y: Column) -> Column:
    return 2 * y - 1


def _logistic(y: Column, m: Column) -> Column:
    """2 log(1 + exp(-2 y m)), also where the exponent is large."""
    x = -2 * _sign(y) * m
    return 2 * (F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))))


#: Twice the log-likelihood of labels 0 and 1; squared error; both as Spark's own boosting has them.
LOGISTIC = Loss(lambda y, m: 4 * _sign(y) / (1 + F.exp(2 * _sign(y) * m)), _logistic, _sign, own=GBTClassifier)
SQUARED = Loss(lambda y, m: 2 * (y - m), lambda y, m: (y - m) * (y - m), lambda y: y, own=GBTRegressor)


def pinball(q: float) -> Loss:
    """Quantile loss: a tree is fitted to its sign gradients, its leaves are quantiles of the residuals."""
    return Loss(lambda y, m: F.when(y > m, q).otherwise(q - 1), lambda y, m: pinball_loss(m, y, q), quantile=q)


@dataclass
class Boosting:
    """Trees in the order they were fitted, the start, each tree's factor or leaf values, and the losses.

    ``losses`` has the validation loss after each round that was fitted, ``rounds`` the best one; trees
    beyond it are dropped.
    """

    trees: list[RandomForestRegressionModel] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    leaves: list[list[float]] = field(default_factory=list)
    start: float = 0.0
    losses: list[float] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        return min(range(len(self.losses)), key=self.losses.__getitem__) + 1

    def cut(self, rounds: int) -> Boosting:
        return Boosting(self.trees[:rounds], self.weights[:rounds], self.leaves[:rounds], self.start, self.losses)


def _java_trees(trees: Sequence[RandomForestRegressionModel]):
    """The single trees of forests as an array of the session's JVM."""
    context = SparkContext._active_spark_context  # also in threads that have no session of their own
    out = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        out[i] = tree._java_obj.trees()[0] if isinstance(tree, RandomForestRegressionModel) else tree._java_obj
    return out


def _java_weights(weights: Sequence[float]):
    context = SparkContext._active_spark_context
    out = context._gateway.new_array(context._jvm.double, len(weights))
    for i, weight in enumerate(weights):
        out[i] = float(weight)
    return out


def as_classifier(boosting: Boosting) -> GBTClassificationModel:
    """A fitted logistic boosting as Spark's own model: scores, importances, saving and loading."""
    made = SparkContext._active_spark_context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        f"boosting_{uuid.uuid4().hex[:12]}", _java_trees(boosting.trees), _java_weights(boosting.weights),
        boosting.trees[0].numFeatures, 2)
    model = GBTClassificationModel(made)
    model._resetUid(made.uid())
    return model


def as_regressor(boosting: Boosting) -> GBTRegressionModel:
    """A fitted squared-error boosting as Spark's own model."""
    made = SparkContext._active_spark_context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(
        f"boosting_{uuid.uuid4().hex[:12]}", _java_trees(boosting.trees), _java_weights(boosting.weights),
        boosting.trees[0].numFeatures)
    model = GBTRegressionModel(made)
    model._resetUid(made.uid())
    return model


def as_forest(trees: Sequence[RandomForestRegressionModel]) -> RandomForestRegressionModel:
    """Trees side by side: one pass gives the leaf of each."""
    made = SparkContext._active_spark_context._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(
        f"trees_{uuid.uuid4().hex[:12]}", _java_trees(trees), trees[0].numFeatures)
    model = RandomForestRegressionModel(made)
    model._resetUid(made.uid())
    return model


def joined_forest(estimator, parts: Sequence):
    """Fitted forests of one estimator as a single model with the trees of all."""
    java = [part._java_obj for part in parts]
    kind = type(estimator).__name__.replace("RandomForest", "").replace("ifier", "ification").replace("ssor", "ssion")
    context = SparkContext._active_spark_context
    package = getattr(context._jvm.org.apache.spark.ml, kind.lower())
    trees = [tree for part in java for tree in part.trees()]
    array = context._gateway.new_array(getattr(package, f"DecisionTree{kind}Model"), len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    classes = [java[0].numClasses()] if kind == "Classification" else []
    made = getattr(package, f"RandomForest{kind}Model")(
        f"forest_{uuid.uuid4().hex[:12]}", array, java[0].numFeatures(), *classes)
    model = estimator._create_model(made)
    model._resetUid(made.uid())
    model = estimator._copyValues(model)
    model._transfer_params_to_java()  # its own number of trees among them
    return model


def _with_leaf(tree: RandomForestRegressionModel, frame: DataFrame, out: str) -> DataFrame:
    """The number of the leaf that a row falls into, without the tree's own prediction."""
    only_leaf = tree.copy().setPredictionCol("").setLeafCol("__leaves")
    return only_leaf.transform(frame).withColumn(out, vector_to_array("__leaves")[0].cast("int")).drop("__leaves")


def _with_step(frame: DataFrame, boosting: Boosting, i: int, out: str) -> DataFrame:
    """What tree ``i`` adds to the margin."""
    tree = boosting.trees[i]
    if boosting.leaves:
        values = F.array(*(F.lit(v) for v in boosting.leaves[i]))
        return _with_leaf(tree, frame, out).withColumn(out, F.get(values, F.col(out)))
    scored = tree.copy().setPredictionCol(out).transform(frame)
    return scored.withColumn(out, F.col(out) * boosting.weights[i])


def _leaf_values(frame: DataFrame, tree: RandomForestRegressionModel, q: float, rate: float) -> list[float]:
    """For each leaf the quantile of its rows' residuals, shortened by the rate, on the grid.

    Residuals are whole numbers of grid parts, so that a leaf's table of counts has a bounded number of rows
    whatever the number of orders.
    """
    residual = F.round((F.col("label") - F.col("margin")) * GRID).cast("long")
    counts = _with_leaf(tree, frame, "leaf").groupBy("leaf", residual.alias("residual")).agg(F.count("*").alias("n"))
    rows = counts.groupBy("leaf").agg(F.percentile("residual", q, F.col("n")).alias("value")).collect()
    values = [0.0] * (max((r["leaf"] for r in rows), default=-1) + 1)
    for r in rows:
        values[r["leaf"]] = round(rate * r["value"]) / GRID
    return values


def boost(train: DataFrame, valid: DataFrame, loss: Loss, *, rounds: int, depth: int, rate: float, min_rows: int = 1,
          column_share: str = "all", row_share: float = 1.0, seed: int = 42, patience: int | None = 30,
          block: int = BLOCK_ROUNDS, opening: int = OPENING_ROUNDS) -> Boosting:
    """Boost on rows of (features, label, weight) until ``patience`` rounds brought no better validation loss.

    Without patience all rounds are fitted. Whether to go on is asked after the opening, which is one fit of Spark's own
    where it has the loss, and then after each block of rounds. No round is fitted twice.
    """
    spark = train.sparkSession
    columns = ["features", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight")]
    rows = train.select(*columns, F.lit(True).alias("fit")).unionByName(valid.select(*columns, F.lit(False).alias("fit")))
    out = Boosting()
    if loss.quantile is not None:
        out.start = round(train.agg(F.percentile(F.col("label"), loss.quantile)).first()[0] * GRID) / GRID
    if loss.own is not None and opening:
        _opening(out, train.select(*columns), valid.select(*columns), loss, min(opening, rounds), maxDepth=depth, stepSize=rate,
                 minInstancesPerNode=min_rows, featureSubsetStrategy=column_share, subsamplingRate=row_share, seed=seed)
        if len(out.trees) == rounds or patience is not None and len(out.losses) - out.rounds >= patience:
            return out.cut(out.rounds) if patience is not None else out
    rows = rows.withColumn("margin", F.lit(out.start)) if not out.trees else as_regressor(out).setPredictionCol(
        "margin").transform(rows)
    base, path = stage_at(rows, "boosting")
    done, margins, before = len(out.trees), base.withColumn("path", F.array().cast("array<double>")), None
    while len(out.trees) < rounds:
        at = len(out.trees)
        margins = margins.persist(StorageLevel.MEMORY_AND_DISK)
        fit = margins.where("fit")
        aim = loss.first(F.col("label")) if at == 0 and loss.first else loss.target(F.col("label"), F.col("margin"))
        tree = RandomForestRegressor(
            featuresCol="features", labelCol="__aim", weightCol="weight", numTrees=1, bootstrap=False, maxDepth=depth,
            minInstancesPerNode=min_rows, featureSubsetStrategy=column_share, subsamplingRate=row_share, seed=seed + at,
        ).fit(fit.select("features", "weight", aim.alias("__aim")))
        out.trees.append(tree)
        out.weights.append(1.0 if at == 0 and loss.first else rate)
        if loss.quantile is not None:
            out.leaves.append(_leaf_values(fit, tree, loss.quantile, rate))
        if before is not None:
            before.unpersist()  # the fit has read this round's margins in full
        before = margins
        # the margin after each round of the block is the path
        margins = _with_step(margins, out, at, "__step")
        margins = margins.select("features", "label", "weight", "fit", (F.col("margin") + F.col("__step")).alias("margin"),
                                 F.when(~F.col("fit"), F.array_append("path", F.col("margin") + F.col("__step"))).alias("path"))
        if len(out.trees) - done == block or len(out.trees) == rounds:
            staged, new = stage_at(margins, "boosting")
            means = [F.sum(F.col("weight") * loss.value(F.col("label"), F.col("path")[i])) / F.sum("weight")
                     for i in range(len(out.trees) - done)]
            out.losses += [float("nan") if x is None else float(x) for x in staged.where("NOT fit").agg(*means).first()]
            before.unpersist()
            before = None
            release(spark, path)
            path, done = new, len(out.trees)
            margins = staged.withColumn("path", F.array().cast("array<double>"))
            if patience is not None and len(out.losses) - out.rounds >= patience:
                break
    release(spark, path)
    return out.cut(out.rounds) if patience is not None else out


def _opening(out: Boosting, train: DataFrame, valid: DataFrame, loss: Loss, rounds: int, **size) -> None:
    """The first rounds by one fit of Spark's own boosting, which keeps its rows in memory meanwhile."""
    model = loss.own(featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, **size).fit(train)
    out.trees += list(model.trees)
    out.weights += list(model.treeWeights)
    each = model.evaluateEachIteration(valid) if loss is LOGISTIC else model.evaluateEachIteration(valid, "squared")
    out.losses += [float(x) for x in each]


@dataclass
class QuantileBoosting:
    """Boosted trees for one quantile of the delivery days."""

    quantile: float
    forest: RandomForestRegressionModel
    leaves: list[list[float]]
    start: float
    rounds: int
    loss: float

    @classmethod
    def fit(cls, train: DataFrame, valid: DataFrame, quantile: float, settings, target: str = "delivery_days",
            patience: int = 30, seed: int = 42) -> QuantileBoosting:
        ready = lambda df: df.select("features", F.col(target).cast("double").alias("label"),
                                     F.lit(1.0).alias("weight")).na.drop()
        from parcelsight.plans import histograms, models  # these build on this module

        size = dict(rounds=settings.rounds, depth=settings.depth, rate=settings.rate, min_rows=settings.min_rows,
                    column_share=settings.column_share, patience=patience, seed=seed)
        fit, held = ready(train), ready(valid)
        found = histograms.boost(fit, held, **size, aim="quantile", loss=pinball(quantile)) if fit.count() >= models.PACKED_FROM \
            else boost(fit, held, pinball(quantile), **size)
        return cls(quantile, as_forest(found.trees), found.leaves, found.start, found.rounds, min(found.losses))

    def predict(self, frame: DataFrame, out: str = "prediction") -> DataFrame:
        """The predicted days: the start and the values of the leaves that a row falls into."""
        table = np.zeros((len(self.leaves), max(map(len, self.leaves))))
        for tree, values in enumerate(self.leaves):
            table[tree, :len(values)] = values
        start, trees = self.start, np.arange(len(table))

        def total(leaves: pd.Series) -> pd.Series:
            if not len(leaves):
                return pd.Series([], dtype=float)
            return pd.Series(start + table[trees, np.stack(leaves.to_list()).astype(np.int64)].sum(1))

        only_leaves = self.forest.copy().setPredictionCol("").setLeafCol("__leaves")
        return only_leaves.transform(frame).withColumn(
            out, F.pandas_udf(total, "double")(vector_to_array("__leaves"))).drop("__leaves")
