"""Hyper-parameter search over folds that keep the items of an order together."""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from parcelsight.operators import metrics
from parcelsight.operators.splits import stratified_folds, with_class_weight
from parcelsight.plans import boosting, histograms, models
from parcelsight.sources.sinks import stage


class MacroF1(Evaluator):
    """Macro F1 of P(class 1) at a threshold, from one aggregate."""

    def __init__(self, threshold: float = 0.5, label: str = "label"):
        super().__init__()
        self.threshold, self.label = threshold, label

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(self.label, vector_to_array("probability")[1].alias("p"))
        counts = metrics.confusion(scored, "p", self.label, self.threshold)
        return float(metrics.with_scores(counts).first()["macro_f1"])

    def isLargerBetter(self) -> bool:
        return True


def with_folds(rows: DataFrame, folds: int = 3, seed: int = 42) -> DataFrame:
    """Item rows with the stratified fold of their order."""
    assigned = stratified_folds(rows, "label", folds=folds, seed=seed).select("order_id", "fold")
    return rows.join(assigned, "order_id")


def parameter_sets(space: dict, estimator: Estimator, sample: int | None = None,
                   seed: int = 42) -> list[dict]:
    """All combinations of a grid, or a seeded sample of them (random search)."""
    names = sorted(space)
    combinations = [dict(zip(names, values))
                    for values in itertools.product(*(space[n] for n in names))]
    if sample is not None and sample < len(combinations):
        combinations = random.Random(seed).sample(combinations, sample)
    return [{estimator.getParam(n): v for n, v in c.items()} for c in combinations]


@dataclass(frozen=True)
class LogUniform:
    """Draws whose logarithm is uniform, for rates and penalties."""

    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return math.exp(rng.uniform(math.log(self.low), math.log(self.high)))


@dataclass(frozen=True)
class Whole:
    """Whole numbers from low to high."""

    low: int
    high: int

    def draw(self, rng: random.Random) -> int:
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


def random_draws(space: dict, draws: int, seed: int = 42) -> list[dict]:
    """Seeded settings from distributions; a list in the space is drawn from evenly."""
    rng = random.Random(seed)
    return [{n: rng.choice(space[n]) if isinstance(space[n], Sequence) else space[n].draw(rng) for n in sorted(space)}
            for _ in range(draws)]


def staged_search(rows: DataFrame, settings: Sequence[dict], rounds: int, folds: int = 3, patience: int | None = 30,
                  block: int = 10) -> DataFrame:
    """Mean validation loss of boosting settings over folds, each at the round where the folds' mean is least.

    A setting is fitted once on each fold, and its loss is known after every round, so that the number of rounds is no
    dimension of the search. Settings name depth, rate, min_rows and column_share, as far as they differ from boosting's
    own. ``rows`` carry order_id, label and features and should be staged. Returns settings, best_rounds, cv_loss; the best first.
    """
    folded = stage(with_class_weight(with_folds(rows, folds)), "search_folds")
    out = []
    for setting in settings:
        losses = []
        for fold in range(folds):
            fit, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
            losses.append(boosting.boost(fit, held, boosting.LOGISTIC, rounds=rounds, patience=patience, block=block,
                                         **({"depth": 5, "rate": 0.1} | setting)).losses)
        known = min(map(len, losses))
        means = [sum(x[i] for x in losses) / folds for i in range(known)]
        best = min(range(known), key=means.__getitem__)
        out.append((", ".join(f"{k}={v}" for k, v in sorted(setting.items())), best + 1, float(means[best])))
    return rows.sparkSession.createDataFrame(out, "settings string, best_rounds int, cv_loss double").orderBy("cv_loss", "settings")


def cross_validated_search(rows: DataFrame, estimator: Estimator, space: dict,
                           sample: int | None = None, folds: int = 3, parallelism: int = 2,
                           evaluator: Evaluator | None = None):
    """Search result table and the fitted best model.

    ``rows`` carry ``order_id``, ``label`` and ``features`` and should be staged.
    """
    sets = parameter_sets(space, estimator, sample)
    # every fit and every score reads the rows again; none repeats the fold's windows and join
    folded = stage(with_class_weight(with_folds(rows, folds)).select("features", "label", "weight", "fold"), "search_rows")
    if _fits_packed(estimator, sets) and folded.count() >= models.PACKED_FROM:
        scores, best_model = _packed_search(folded, estimator, sets, folds, evaluator or MacroF1())
    else:
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=sets, evaluator=evaluator or MacroF1(),
            numFolds=folds, foldCol="fold", parallelism=parallelism, seed=42)
        model = search.fit(folded)
        scores, best_model = model.avgMetrics, model.bestModel
    described = [", ".join(f"{p.name}={v}" for p, v in sorted(
        s.items(), key=lambda pair: pair[0].name)) for s in sets]
    table = rows.sparkSession.createDataFrame(
        [(d, float(score)) for d, score in zip(described, scores)],
        "params string, cv_macro_f1 double").orderBy(F.desc("cv_macro_f1"), "params")
    return table, best_model


#: Settings of a boosting that packed rows know.
PACKED_SETTINGS = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "minInstancesPerNode": "min_rows",
                   "featureSubsetStrategy": "column_share", "subsamplingRate": "row_share", "seed": "seed"}


def _fits_packed(estimator: Estimator, sets: Sequence[dict]) -> bool:
    """Whether a search differs from plain boosting only in settings that packed rows know."""
    if not isinstance(estimator, GBTClassifier) or any(p.name not in PACKED_SETTINGS for s in sets for p in s):
        return False
    plain = (estimator.getMinInfoGain() == 0, estimator.getMinWeightFractionPerNode() == 0, estimator.getMaxDepth() <= 12,
             estimator.getMaxBins() == histograms.BINS, not estimator.isSet("validationIndicatorCol"),
             estimator.isSet("weightCol") and estimator.getWeightCol() == "weight", estimator.getLabelCol() == "label")
    return all(plain)


def _packed_search(folded: DataFrame, estimator: GBTClassifier, sets: Sequence[dict], folds: int,
                   evaluator: Evaluator) -> tuple[list[float], object]:
    """Mean score of each setting over the folds, and the best one fitted on all rows.

    The fits read the staged folds and keep their packed rows alone; no fold is cached with its vectors.
    """
    weights = {r["label"]: r["weight"] for r in folded.groupBy("label").agg(F.max("weight").alias("weight")).collect()}
    classes = [weights.get(k, 0.0) for k in (0, 1)]

    def fit(setting: dict, rows: DataFrame, held: DataFrame):
        one = estimator.copy(setting)
        size = {name: one.getOrDefault(p) for p, name in PACKED_SETTINGS.items()}
        found = histograms.boost(rows, held, **size, patience=None, classes=classes)
        return boosting.as_classifier(found)

    scores = []
    for setting in sets:
        each = []
        for fold in range(folds):
            held = folded.where(F.col("fold") == fold)
            each.append(evaluator.evaluate(fit(setting, folded.where(F.col("fold") != fold), held).transform(held)))
        scores.append(sum(each) / folds)
    best = max if evaluator.isLargerBetter() else min
    return scores, fit(sets[scores.index(best(scores))], folded, folded.where("fold = 0"))


def polynomial_search(frame: DataFrame, inputs: Sequence[str], target: str,
                      degrees: Sequence[int] = (1, 2, 3), folds: int = 5) -> DataFrame:
    """Cross-validated R2 of scaled polynomial regression per degree.

    Folds follow the order hash, so an order is never on both sides.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from parcelsight.operators.splits import mixed_key

    rows = frame.na.drop(subset=[*inputs, target]).withColumn(
        "fold", (mixed_key("order_id") % folds).cast("int"))
    expand = PolynomialExpansion(inputCol="scaled", outputCol="features")
    steps = Pipeline(stages=[
        VectorAssembler(inputCols=list(inputs), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
        expand,
        LinearRegression(featuresCol="features", labelCol=target, regParam=0.0),
    ])
    sets = [{expand.degree: degree} for degree in degrees]
    search = CrossValidator(
        estimator=steps, estimatorParamMaps=sets, numFolds=folds, foldCol="fold",
        evaluator=RegressionEvaluator(labelCol=target, metricName="r2"), parallelism=2)
    scores = search.fit(rows).avgMetrics
    return frame.sparkSession.createDataFrame(
        [(int(d), float(s)) for d, s in zip(degrees, scores)], "degree int, cv_r2 double")
