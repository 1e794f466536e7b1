"""Model plans on a small separable data set."""

import random
import re

import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from parcelsight.functions.bands import RISK_LEVELS
from parcelsight.operators import metrics
from parcelsight.plans import boosting, console, evaluation, histograms, models, scoring, search
from parcelsight.plans.features import ORDER_TIME_FEATURES
from parcelsight.plans.quantile_forest import QuantileForest
from parcelsight.sources.sinks import stage
from parcelsight.streaming import scoring as stream_scoring

WEEKDAYS = ["monday", "tuesday", "friday"]


@pytest.fixture(scope="module")
def frame(spark):
    """Far orders are slow and badly reviewed, near ones fast and well reviewed."""
    rng, data = random.Random(2), []
    for i in range(900):
        far = rng.random() < 0.5
        days = rng.randrange(20, 40) if far else rng.randrange(2, 8)
        score = (1 if far else 5) if rng.random() < 0.95 else 3
        data.append((
            f"o{i // 2}", score, days, 1 + i % 2, 50.0 + rng.random(), 5.0, 0.1,
            None if i % 50 == 0 else 55.0, 100.0, 10.0, 10.0, 10.0, rng.choice(WEEKDAYS),
            1 + i % 12, 15, "Others", None if i % 40 == 0 else "Automotive",
            900.0 + rng.random() if far else 20.0 + rng.random(),
            "Long-Haul" if far else "Urban/Last-Mile", int(far), 0, 0, 0, 0, 0))
    kinds = {c: "double" for c in ORDER_TIME_FEATURES}
    for c in ("order_purchase_dayofweek", "main_category", "sub_category", "distance_cat"):
        kinds[c] = "string"
    for c in ("order_item_id", "order_purchase_month", "expected_delivery_days", "cross_state",
              "is_sp_customer", "is_sp_seller", "sp_route_type", "sp_route_type_customer",
              "sp_route_type_seller"):
        kinds[c] = "int"
    schema = "order_id string, review_score int, delivery_days int, " + ", ".join(
        f"{c} {kinds[c]}" for c in ORDER_TIME_FEATURES)
    return models.staged_frame(spark.createDataFrame(data, schema), "test_frame")


@pytest.fixture(scope="module")
def fitted_and_scored(frame):
    fitted, scored = console.hold_out_console(
        frame, models.TreeSettings(6, 3, 0.3), models.TreeSettings(4, 6, 0.1, 5))
    return fitted, stage(scored, "test_scored")


def test_fill_constants_are_exact(frame):
    constants = models.fill_constants(frame, ["total_price", "order_item_id"], ["sub_category"])
    assert constants == {"total_price": 55.0, "order_item_id": 1.5, "sub_category": "Automotive"}


def test_unknown_category_is_coded_as_zero(spark, frame):
    from pyspark.ml.functions import vector_to_array

    fitted = models.fit_preprocessing(frame, ["order_purchase_dayofweek"])
    odd = frame.limit(1).withColumn("order_purchase_dayofweek", F.lit("someday"))
    row = models.encoded(fitted, odd).select(vector_to_array("features")).first()[0]
    assert row == [0.0, 0.0, 0.0]
    known = models.encoded(fitted, frame).select(vector_to_array("features").alias("v"))
    assert known.where(F.aggregate("v", F.lit(0.0), lambda a, b: a + b) != 1.0).count() == 0


def test_dummy_coding_drops_the_first_level(frame):
    from pyspark.ml.functions import vector_to_array

    fitted = models.fit_preprocessing(frame, ["order_purchase_dayofweek"], drop_first=True)
    coded = models.encoded(fitted, frame).select(
        "order_purchase_dayofweek", vector_to_array("features").alias("v")).distinct().collect()
    by_day = {r[0]: sum(r[1]) for r in coded}
    assert by_day == {"friday": 0.0, "monday": 1.0, "tuesday": 1.0}


def test_risk_beats_the_majority_baseline(frame, fitted_and_scored):
    _, scored = fitted_and_scored
    scores = console.evaluate_risk(scored).first()
    base = evaluation.majority_baseline(
        frame.where("split != 'test'"), frame.where("split = 'test'")).first()
    assert base["balanced_acc"] == 0.5
    assert scores["balanced_acc"] > 0.8


def test_quantiles_never_cross_and_beat_a_constant(frame, fitted_and_scored):
    fitted, _ = fitted_and_scored
    rows = models.encoded(fitted.preprocessing, frame)
    predicted = fitted.days.predict(rows)
    crossing = predicted.where(~F.expr(
        "forall(sequence(0, size(predicted_days) - 2), i -> predicted_days[i] <= predicted_days[i+1])"))
    assert crossing.count() == 0
    flat = float(frame.agg(F.percentile("delivery_days", 0.9)).first()[0])
    loss = predicted.agg(
        F.avg(metrics.pinball_loss(F.col("predicted_days")[2], "delivery_days", 0.9)),
        F.avg(metrics.pinball_loss(F.lit(flat), "delivery_days", 0.9))).first()
    assert loss[0] < loss[1]


def test_decisions_follow_from_the_scores(fitted_and_scored):
    _, scored = fitted_and_scored
    rows = scored.collect()
    assert rows and all(r["recommended_expected_days"] >= r["expected_delivery_days"] for r in rows)
    assert all((r["risk_level"] == RISK_LEVELS[0]) == r["is_track_c_target"] for r in rows)
    listed = scoring.high_risk_orders(scored).collect()
    assert len({r["order_id"] for r in listed}) == len(listed)
    risks = [r["review_risk_probability"] for r in listed]
    assert risks == sorted(risks, reverse=True)
    assert scoring.first_item_rows(scored).count() == len({r["order_id"] for r in rows})


def test_late_rate_falls_with_the_quantile(frame, fitted_and_scored):
    fitted, _ = fitted_and_scored
    rows = console.evaluate_quantiles(
        fitted.preprocessing, fitted.days, frame.where("split = 'test'")).collect()
    assert all(r["delivered_share"] >= r["quantile"] - 0.1 for r in rows)
    rates = [r["recommended_any_delay_rate"] for r in rows]
    assert rates == sorted(rates, reverse=True)
    assert rows[0]["current_any_delay_rate"] >= rates[0]


def test_save_and_load_score_alike(spark, frame, fitted_and_scored, tmp_path):
    fitted, scored = fitted_and_scored
    fitted.save(spark, str(tmp_path / "models"))
    again = console.OrderTimeModels.load(spark, str(tmp_path / "models"))
    columns = ["order_id", "order_item_id", "review_risk_probability", "recommended_expected_days"]
    one = {tuple(r) for r in scored.select(*columns).collect()}
    two = {tuple(r) for r in console.score_orders(
        again, frame.where("split = 'test'")).select(*columns).collect()}
    assert one == two


def test_stream_scores_like_the_batch(spark, frame, fitted_and_scored, tmp_path):
    fitted, scored = fitted_and_scored
    landing = str(tmp_path / "landing")
    frame.where("split = 'test'").repartition(3).write.parquet(landing)
    stream = stream_scoring.arriving_rows(spark, landing, frame.schema, files_per_batch=1)
    columns = ["order_id", "order_item_id", "review_risk_probability", "risk_level"]
    out = stream_scoring.drain(stream_scoring.scored_stream(fitted, stream).select(*columns),
                               str(tmp_path / "out"), str(tmp_path / "state"))
    assert {tuple(r) for r in out.collect()} == {
        tuple(r) for r in scored.select(*columns).collect()}


def test_alerts_of_a_scored_stream_are_the_batch_list(spark, frame, fitted_and_scored, tmp_path):
    """The same alerts, with the same row of each order, for any number of files in a batch."""
    fitted, _ = fitted_and_scored
    rows = frame.withColumn("order_id", F.concat(F.lit("x"), F.substring("order_id", 1, 3)))  # orders of many rows
    rows = rows.unionByName(rows.limit(5).withColumn("order_item_id", F.lit(None).cast("int")))
    landing = str(tmp_path / "landing")
    rows.repartition(5).write.parquet(landing)
    scored = stream_scoring.risk_stream(fitted.preprocessing, fitted.risk, spark.read.parquet(landing))
    columns = stream_scoring.ALERT_COLUMNS
    want = {tuple(r) for r in scoring.high_risk_orders(scored).select(*columns).collect()}
    assert len(want) > 20 and len(want) == len({r[0] for r in want})
    revisions = set()
    for files in (1, 2, None):
        stream = stream_scoring.arriving_rows(spark, landing, rows.schema, files_per_batch=files)
        log = stream_scoring.drain(stream_scoring.alert_log(
            stream_scoring.risk_stream(fitted.preprocessing, fitted.risk, stream)),
            str(tmp_path / f"log{files}"), str(tmp_path / f"state{files}"))
        got = stream_scoring.current_alerts(log)
        assert got.columns == columns and {tuple(r) for r in got.collect()} == want
        revisions.add(log.agg(F.max("revision")).first()[0])
    assert min(revisions) == 1 and max(revisions) > 1


def test_replayed_alerts_come_out_once(spark, tmp_path):
    """The same alerts for any number of files in a batch, also for an order that is days late."""
    day = "timestamp'2024-01-10 00:00:00'"
    landing = str(tmp_path / "alerts")
    batch = spark.range(20).selectExpr("id AS order_id", f"{day} + make_interval(0,0,0,0,id) AS ts")
    for _ in range(2):
        batch.coalesce(1).write.mode("append").parquet(landing)
    late = spark.range(30, 31).selectExpr("id AS order_id", f"{day} - make_interval(0,0,0,5) AS ts")
    late.coalesce(1).write.mode("append").parquet(landing)
    for files in (1, 2, None):
        stream = stream_scoring.arriving_rows(spark, landing, batch.schema, files_per_batch=files)
        out = stream_scoring.drain_alerts(stream, str(tmp_path / f"out{files}"), str(tmp_path / f"state{files}"))
        assert sorted(r["order_id"] for r in out.collect()) == [*range(20), 30]
    # a batch that is written once more changes nothing
    stream_scoring.write_new_alerts(batch.where("order_id < 5"), 0, str(tmp_path / "again"))
    for _ in range(2):
        stream_scoring.write_new_alerts(batch, 1, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again")).count() == 20


def test_boosting_ends_by_the_validation_loss(frame):
    rows = stage(models.encoded(models.fit_preprocessing(frame, ["distance_km"]), frame), "test_patience")
    fit = models.fit_patient(rows.where("split = 'train'"), rows.where("split = 'valid'"),
                             models.TreeSettings(40, 3, 0.5), patience=4)  # all in the opening
    assert fit.rounds == min(range(len(fit.losses)), key=fit.losses.__getitem__) + 1
    assert fit.model.getNumTrees == fit.rounds
    assert len(fit.losses) == 40 or len(fit.losses) - fit.rounds >= 4


@pytest.fixture(scope="module")
def numbers(spark):
    """Rows whose days depend on two of three features, with skewed noise; the label is whether they are many."""
    rng = random.Random(5)
    data = []
    for i in range(1500):
        a, b, c = (rng.randrange(12) / 11 for _ in range(3))  # few values, so that no two splits are nearly alike
        days = 5 + 20 * (a > 0.5) + 6 * b + rng.expovariate(0.5 if a > 0.5 else 1.0)
        data.append((Vectors.dense(a, b, c), round(days, 2), int(days > 14), 1.0 + (i % 3 == 0), i % 5 == 0))
    rows = spark.createDataFrame(data, ["features", "days", "label", "weight", "held"])
    return stage(rows.coalesce(1), "test_numbers")


def test_rounds_go_on_from_a_margin_like_one_long_fit(numbers):
    fit, held = numbers.where("NOT held"), numbers.where("held")
    size = dict(rounds=7, depth=3, rate=0.3, min_rows=5, patience=None)
    found = boosting.boost(fit, held, boosting.LOGISTIC, **size, block=3, opening=0)
    long = models.boosted_classifier(models.TreeSettings(7, 3, 0.3, 5)).fit(fit)
    own = boosting.as_classifier(found)
    text = lambda model: "".join(t.toDebugString.split("\n", 1)[1] for t in model.trees)
    number = re.compile(r"-?\d+\.\d+(?:E-?\d+)?")

    def same_trees(one, other):
        a, b = (number.findall(text(x)) for x in (one, other))
        return number.sub("", text(one)) == number.sub("", text(other)) and list(map(float, a)) == pytest.approx(
            list(map(float, b)), abs=1e-9)

    assert same_trees(own, long) and own.treeWeights == long.treeWeights
    assert own.numFeatures == 3 and own.featureImportances.toArray() == pytest.approx(long.featureImportances.toArray())
    losses = [float(x) for x in long.evaluateEachIteration(held)]
    assert found.losses == pytest.approx(losses)
    p = lambda model: [r[0][1] for r in model.transform(held).select("probability").collect()]
    assert p(own) == pytest.approx(p(long))
    opened = boosting.boost(fit, held, boosting.LOGISTIC, **size, block=2, opening=4)
    assert same_trees(boosting.as_classifier(opened), long) and opened.losses == pytest.approx(losses)
    square = boosting.as_regressor(boosting.boost(
        fit.withColumn("label", F.col("days")), held.withColumn("label", F.col("days")), boosting.SQUARED, **size, block=4,
        opening=2))
    regressor = GBTRegressor(labelCol="days", weightCol="weight", maxIter=7, maxDepth=3, stepSize=0.3, minInstancesPerNode=5,
                             seed=models.SEED).fit(fit)
    assert same_trees(square, regressor)


def test_each_round_is_fitted_once_and_the_end_comes_after_patience(numbers, monkeypatch):
    fits = []
    real = boosting.RandomForestRegressor
    monkeypatch.setattr(boosting, "RandomForestRegressor", lambda **k: fits.append(k["seed"]) or real(**k))
    fit, held = numbers.where("NOT held"), numbers.where("held")
    found = boosting.boost(fit, held, boosting.LOGISTIC, rounds=60, depth=6, rate=0.8, patience=4, block=3, opening=2)
    assert fits == list(range(models.SEED + 2, models.SEED + len(found.losses)))
    assert len(found.trees) == found.rounds and 4 <= len(found.losses) - found.rounds < 4 + 3


def test_quantile_boosting(spark, numbers):
    fit, held = numbers.where("NOT held"), numbers.where("held")
    forest = QuantileForest.fit(fit, models.TreeSettings(30, 4, 0.1, 20), "days", (0.8,))
    settings = models.TreeSettings(80, 3, 0.2, 20)
    own = boosting.QuantileBoosting.fit(fit, held, 0.8, settings, "days")
    assert own.rounds == len(own.leaves) == len(own.forest.trees)
    scored = forest.predict(own.predict(held))
    loss = lambda c: metrics.pinball_loss(c, "days", 0.8)
    row = scored.agg(F.avg(loss(F.col("prediction"))).alias("own"), F.avg(loss(F.col("predicted_days")[0])).alias("forest"),
                     F.avg((F.col("days") <= F.col("prediction")).cast("double")).alias("share")).first()
    assert row["own"] == pytest.approx(own.loss) and row["own"] < row["forest"]
    assert abs(row["share"] - 0.8) < 0.05
    assert own.predict(held.where("false")).count() == 0


def test_learners_get_enough_tasks(spark, frame):
    from parcelsight.plans.catalog.modelling import encoded_rows

    frame = stage(frame.coalesce(1), "test_few_tasks")
    assert frame.rdd.getNumPartitions() == 1
    assert encoded_rows(frame, ["distance_km"]).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert console.prepare_training(frame)[1].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_staged_search(frame):
    rows = stage(models.encoded(models.fit_preprocessing(frame, ["distance_km"]), frame), "test_staged_search")
    space = {"depth": search.Whole(1, 3), "rate": search.LogUniform(0.05, 0.5), "min_rows": [1, 5]}
    drawn = search.random_draws(space, 200, seed=3)
    assert drawn == search.random_draws(space, 200, seed=3) and {d["depth"] for d in drawn} == {1, 2, 3}
    assert {d["min_rows"] for d in drawn} == {1, 5} and all(0.05 <= d["rate"] <= 0.5 for d in drawn)
    assert 0.35 < sum(d["rate"] < 0.158 for d in drawn) / 200 < 0.65  # the middle of the logarithms
    found = search.staged_search(rows, drawn[:2], rounds=4, folds=2, patience=None, block=4).collect()
    assert len(found) == 2 and found[0]["cv_loss"] <= found[1]["cv_loss"] and 1 <= found[0]["best_rounds"] <= 4


def test_leaf_table_is_in_no_row(frame, fitted_and_scored):
    fitted, _ = fitted_and_scored
    plan = fitted.days.predict(models.encoded(fitted.preprocessing, frame))._jdf.queryExecution().toString()
    assert "array<array<array<double>>>" not in plan and "scalar" not in plan


def test_search_and_importance(frame):
    preprocessing = models.fit_preprocessing(frame, ["distance_km", "order_purchase_month"])
    rows = stage(models.encoded(preprocessing, frame), "test_search")
    estimator = models.boosted_classifier(models.TreeSettings(2, 2, 0.3))
    table, best = search.cross_validated_search(
        rows, estimator, {"maxDepth": [1, 2], "stepSize": [0.3]})
    assert table.count() == 2 and table.first()["cv_macro_f1"] > 0.8
    ranked = models.feature_importance(best, rows).collect()
    assert ranked[0]["feature"] == "distance_km"
    again = search.parameter_sets({"maxDepth": [1, 2, 3], "stepSize": [0.1, 0.2]}, estimator, 2)
    assert len(again) == 2 and again == search.parameter_sets(
        {"maxDepth": [1, 2, 3], "stepSize": [0.1, 0.2]}, estimator, 2)


def test_forests_are_fitted_some_trees_at_a_time(numbers, tmp_path, monkeypatch):
    """No fit keeps counts of more than ``TREES_AT_ONCE`` trees with its rows, and the parts are one model."""
    sizes = []
    for kind in (RandomForestRegressor, RandomForestClassifier):
        real = kind._fit
        monkeypatch.setattr(kind, "_fit", lambda self, rows, real=real: sizes.append(self.getNumTrees()) or real(self, rows))
    fit, held = numbers.where("NOT held"), numbers.where("held")
    days = QuantileForest.fit(fit, models.TreeSettings(101, 2, min_rows=20), "days", (0.8,))
    assert sizes == [34, 34, 33] and days.forest.getNumTrees == 101 and len(days.table) == 101
    assert len({t.toDebugString.split("\n", 1)[1] for t in days.forest.trees}) > 34  # each part draws its own rows
    assert days.predict(held).where("predicted_days[0] > 0").count() == held.count()
    del sizes[:]
    two = models.fit_forest(models.forest_classifier(models.TreeSettings(12, 3)), fit, at_once=5)
    assert sizes == [4, 4, 4] and two.getNumTrees == 12 and two.numClasses == 2
    shares = lambda model: [r[0][1] for r in model.transform(held).select("probability").collect()]
    two.write().overwrite().save(str(tmp_path / "forest"))
    again = RandomForestClassificationModel.load(str(tmp_path / "forest"))
    assert shares(again) == pytest.approx(shares(two)) and len(set(shares(two))) > 2
    single = [models.forest_classifier(models.TreeSettings(4, 3)).setSeed(models.SEED + i).fit(fit) for i in range(3)]
    mean = [sum(x) / 3 for x in zip(*map(shares, single))]
    assert shares(two) == pytest.approx(mean)


def test_slot_means_multiply_no_row(frame):
    coded = models.encoded(models.fit_preprocessing(frame, ["distance_km", "main_category"]), frame)
    found = models.slot_means(coded)
    rows = [r.asDict() for r in found.collect()]
    vectors = [r[0].toArray() for r in coded.select("features").collect()]
    assert [r["slot"] for r in rows] == list(range(len(vectors[0]))) and {r["rows"] for r in rows} == {len(vectors)}
    assert [r["mean"] for r in rows] == pytest.approx([sum(x) / len(vectors) for x in zip(*vectors)])
    assert [r["feature"] for r in rows] == models.feature_names(coded)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("ObjectHashAggregate")  # the slots come apart after the aggregate


def test_search_reads_staged_folds(frame, monkeypatch):
    """No fit of the search repeats the numbering and the join of the folds."""
    rows = stage(models.encoded(models.fit_preprocessing(frame, ["distance_km"]), frame), "test_staged_folds")
    plans, real = [], search.CrossValidator._fit
    monkeypatch.setattr(search.CrossValidator, "_fit", lambda self, df: plans.append(
        df._jdf.queryExecution().optimizedPlan().toString()) or real(self, df))
    search.cross_validated_search(rows, models.boosted_classifier(models.TreeSettings(1, 1)), {"maxDepth": [1]}, folds=2)
    assert len(plans) == 1 and "Join" not in plans[0] and "Window" not in plans[0]


def test_a_round_applies_one_tree_and_leaves_nothing_cached(spark, numbers, monkeypatch):
    """The rows of a fit come from kept margins, however many rounds of the block there are, and are let go."""
    cached, real = [], boosting.RandomForestRegressor._fit
    monkeypatch.setattr(boosting.RandomForestRegressor, "_fit", lambda self, rows: cached.append(
        "InMemoryRelation" in rows._jdf.queryExecution().withCachedData().toString()) or real(self, rows))
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held()
    fit, valid = numbers.where("NOT held"), numbers.where("held")
    boosting.boost(fit, valid, boosting.LOGISTIC, rounds=5, depth=2, rate=0.3, patience=None, block=3, opening=0)
    assert cached == [True] * 5 and held() == before


def test_packed_rows_give_the_trees_of_one_long_fit(spark, numbers):
    """Rows of one byte a column, exact sums, the smaller sibling counted: the same splits, leaves and losses."""
    fit, held = numbers.where("NOT held"), numbers.where("held")
    size = dict(rounds=7, depth=3, rate=0.3, min_rows=5, patience=None)
    found = boosting.as_classifier(histograms.boost(fit, held, **size))
    long = models.boosted_classifier(models.TreeSettings(7, 3, 0.3, 5)).fit(models.with_class_weight(fit))
    # what a row gets from each tree, as Spark merges leaves of equal value
    leaves = lambda model: [[t.predict(v) for t in model.trees] for v, in numbers.select("features").collect()]
    for one, other in zip(leaves(found), leaves(long)):
        assert one == pytest.approx(other, abs=1e-6)
    assert found.treeWeights == long.treeWeights and found.numFeatures == 3
    assert found.featureImportances.toArray() == pytest.approx(long.featureImportances.toArray(), abs=1e-6)
    losses = histograms.boost(fit, held, **size).losses
    assert losses == pytest.approx([float(x) for x in long.evaluateEachIteration(models.with_class_weight(held))], abs=1e-6)


def test_packed_boosting_depends_on_no_dealing_and_ends_by_patience(spark, frame, monkeypatch):
    """One-hot slots share a column; draws of columns and sums are the same however the rows lie; the query takes this path."""
    columns = ["distance_km", "order_purchase_dayofweek", "main_category", "order_purchase_month"]
    rows = stage(models.encoded(models.fit_preprocessing(frame, columns), frame), "test_packed")
    train, valid = rows.where("split = 'train'"), rows.where("split = 'valid'")
    packed = histograms.fit_columns(train, train.count(), 1)
    assert sorted(map(len, packed.slots)) == [1, 1, 1, 3] and sum(t is None for t in packed.limits) == 2
    monkeypatch.setattr(models, "PACKED_FROM", 1)
    monkeypatch.setattr(boosting, "boost", None)
    held = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before, settings = held(), models.TreeSettings(40, 3, 0.5, 5, "0.6")
    one = models.fit_patient(train, valid, settings, patience=4)
    monkeypatch.setattr(histograms, "BLOCK_ROWS", 50)
    two = models.fit_patient(train.repartition(3), valid.coalesce(1), settings, patience=4)
    text = lambda fit: [t.toDebugString.split("\n", 1)[1] for t in fit.model.trees]
    assert text(one) == text(two) and one.losses == two.losses
    assert one.rounds == min(range(len(one.losses)), key=one.losses.__getitem__) + 1 == one.model.getNumTrees
    assert len(one.losses) == 40 or 4 <= len(one.losses) - one.rounds < 4 + histograms.LOOK_ROUNDS
    assert held() == before and models.feature_importance(one.model, rows).first()["feature"] == "distance_km"
    assert metrics.with_scores(metrics.confusion(models.with_probability(one.model, valid), "probability_positive", "label",
                                                 0.5)).first()["balanced_acc"] > 0.8
    # rounds go on over stagings of the margin as Spark's own would score them
    more = models.fit_patient(train, valid, models.TreeSettings(23, 2, 0.05, 5, "0.6"), patience=30)
    scored = more.model.transform(models.with_class_weight(valid)).withColumn("margin", vector_to_array("rawPrediction")[1])
    loss = boosting.LOGISTIC.value(F.col("label"), F.col("margin"))
    own = scored.agg(F.sum(F.col("weight") * loss) / F.sum("weight")).first()[0]
    assert len(more.losses) == 23 and more.losses[more.rounds - 1] == pytest.approx(own, abs=1e-6)


def test_packed_squared_and_quantile_boosting(spark, numbers, monkeypatch):
    """A squared error gives the trees of one long fit, a quantile the losses that its own predictions have."""
    monkeypatch.setattr(models, "PACKED_FROM", 1)
    monkeypatch.setattr(boosting, "boost", None)
    held_rdds = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held_rdds()
    rows = numbers.withColumn("weight", F.lit(1.0))
    fit, held = rows.where("NOT held"), rows.where("held")
    own = models.fit_patient(fit, held, models.TreeSettings(7, 3, 0.3, 5), "days")
    long = GBTRegressor(labelCol="days", maxIter=7, maxDepth=3, stepSize=0.3, minInstancesPerNode=5, seed=models.SEED).fit(fit)
    one, other = ([[t.predict(v) for t in model.trees[:own.rounds]] for v, in held.select("features").collect()]
                  for model in (own.model, long))
    for a, b in zip(one, other):
        assert a == pytest.approx(b, abs=1e-3)
    assert own.losses == pytest.approx([float(x) for x in long.evaluateEachIteration(held, "squared")], abs=1e-3)
    drawn = models.fit_patient(fit, held, models.TreeSettings(25, 3, 0.3, 5, "all", 0.7), "days")  # over a staging of the margin
    square = drawn.model.transform(held).agg(F.avg((F.col("prediction") - F.col("days")) ** 2)).first()[0]
    assert drawn.losses[drawn.rounds - 1] == pytest.approx(square, rel=1e-4) and square < own.losses[0]
    days = boosting.QuantileBoosting.fit(fit, held, 0.8, models.TreeSettings(40, 3, 0.2, 20), "days")
    row = days.predict(held).agg(F.avg(metrics.pinball_loss("prediction", "days", 0.8)),
                                 F.avg((F.col("days") <= F.col("prediction")).cast("double"))).first()
    assert days.rounds == len(days.leaves) and row[0] == pytest.approx(days.loss, abs=1e-5) and abs(row[1] - 0.8) < 0.06
    assert held_rdds() == before


def test_packed_forests(spark, numbers, tmp_path, monkeypatch):
    """Whole forests on packed rows: as good as Spark's, with the leaves numbered and counted as Spark does, and nothing kept."""
    fit, held = numbers.where("NOT held").withColumn("days", F.round("days")), numbers.where("held")
    settings = models.TreeSettings(60, 4, 0.1, 5)
    plain = QuantileForest.fit(fit, settings, "days", (0.5, 0.9))
    two = models.forest_classifier(models.TreeSettings(60, 4)).setMinInstancesPerNode(5)
    balanced = models.with_class_weight(fit.drop("weight"))
    spark_two = models.fit_forest(two, balanced)
    monkeypatch.setattr(models, "PACKED_FROM", 1)
    for kind in (RandomForestRegressor, RandomForestClassifier):
        monkeypatch.setattr(kind, "_fit", None)
    monkeypatch.setattr(histograms, "FOREST_TREES", 25)
    held_rdds = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = held_rdds()
    packed = QuantileForest.fit(fit, settings, "days", (0.5, 0.9))
    assert packed.forest.getNumTrees == 60 == len(packed.table) and packed.forest.getMaxDepth() == 4
    # every leaf's percentiles are those of the rows that Spark puts into it
    from parcelsight.plans.quantile_forest import leaf_quantiles

    counted = {(r["tree"], r["leaf"]): r["days"] for r in leaf_quantiles(packed.forest, fit, "days", (0.5, 0.9)).collect()}
    assert counted == {(t, i): days for t, leaves in enumerate(packed.table) for i, days in enumerate(leaves) if days}
    assert len({t.toDebugString.split("\n", 1)[1] for t in packed.forest.trees}) > 50  # rows and slots are drawn for each tree
    loss = lambda model: model.predict(held).agg(F.avg(metrics.pinball_loss(F.col("predicted_days")[1], "days", 0.9))).first()[0]
    assert loss(packed) < 1.05 * loss(plain)
    own = models.fit_forest(two, balanced)
    assert own.getNumTrees == 60 and own.numClasses == 2
    score = lambda model: [r[0][1] for r in model.transform(held).select("probability").collect()]
    assert max(abs(a - b) for a, b in zip(score(own), score(spark_two))) < 0.15
    importances = lambda model: model.featureImportances.toArray()
    assert importances(own) == pytest.approx(importances(spark_two), abs=0.1)
    own.write().overwrite().save(str(tmp_path / "packed"))
    assert score(RandomForestClassificationModel.load(str(tmp_path / "packed"))) == score(own)
    assert held_rdds() == before


def test_leaf_percentiles_are_sparks(spark):
    values = [(1, 3), (2, 1), (7, 2), (20, 5)]
    table = [v for v, _ in values], [n for _, n in values]
    frame = spark.createDataFrame(values, "v int, n int")
    for q in (0.0, 0.25, 0.5, 0.77, 0.9, 1.0):
        assert histograms._percentiles(table, [q])[0] == pytest.approx(frame.agg(F.percentile("v", q, F.col("n"))).first()[0])


def test_packed_search_caches_no_fold(frame, monkeypatch):
    """Above the limit the search keeps packed rows only; scores and the best setting are those of the cross-validator."""
    rows = stage(models.encoded(models.fit_preprocessing(frame, ["distance_km", "order_purchase_month"]), frame), "test_packed_search")
    estimator, space = models.boosted_classifier(models.TreeSettings(3, 3, 0.3)), {"maxDepth": [1, 3], "minInstancesPerNode": [20]}
    before = {r["params"]: r["cv_macro_f1"] for r in search.cross_validated_search(rows, estimator, space)[0].collect()}
    monkeypatch.setattr(models, "PACKED_FROM", 1)
    monkeypatch.setattr(search.CrossValidator, "_fit", None)
    table, best = search.cross_validated_search(rows, estimator, space)
    after = {r["params"]: r["cv_macro_f1"] for r in table.collect()}
    assert after.keys() == before.keys() and all(abs(after[k] - before[k]) < 0.02 for k in after)
    assert best.getNumTrees == 3 and models.feature_importance(best, rows).first()["feature"] == "distance_km"
