"""Registered queries: model jobs over the whole analysis table, with the declared settings."""

from pyspark.sql import DataFrame, functions as F

from parcelsight.functions.bands import HIGH_RISK_LIMIT
from parcelsight.operators import metrics
from parcelsight.plans import console, evaluation, features, models, scoring, search
from parcelsight.plans.catalog.registry import Inputs, register
from parcelsight.plans.features import AFTER_DELIVERY_FEATURES, ORDER_TIME_FEATURES
from parcelsight.sources.sinks import spread, stage

def order_time_rows(q: Inputs) -> DataFrame:
    frame = features.order_time_frame(q.items(*features.ORDER_TIME_SOURCE), q.hub)
    return models.staged_frame(frame, "order_time", portable=True)


def after_delivery_rows(q: Inputs) -> DataFrame:
    frame = features.after_delivery_frame(q.items(*features.AFTER_DELIVERY_SOURCE), q.hub)
    return models.staged_frame(frame, "after_delivery", portable=True)


def encoded_rows(rows: DataFrame, columns: list[str], **options) -> DataFrame:
    """Staged rows with a feature vector whose coding was fitted on train."""
    preprocessing = models.fit_preprocessing(rows.where("split = 'train'"), columns, **options)
    return stage(spread(models.encoded(preprocessing, rows).select(
        "order_id", "label", "split", "review_score", "features"), "order_id"), "encoded")


def part(rows: DataFrame, split: str) -> DataFrame:
    return rows.where(F.col("split") == split)


def boosted(rows: DataFrame, settings: models.TreeSettings) -> models.Boosted:
    """A boosted classifier of the train rows; the valid rows end it."""
    return models.fit_patient(part(rows, "train"), part(rows, "valid"), settings)


def tuned_scores(model, rows: DataFrame, name: str) -> DataFrame:
    """Threshold chosen on valid, scores reported on test."""
    valid = models.with_probability(model, part(rows, "valid"))
    best = metrics.balanced_threshold(
        metrics.threshold_sweep(valid, "probability_positive", "label"))
    limit = float(best.first()["threshold"])
    test = models.with_probability(model, part(rows, "test"))
    return metrics.with_scores(metrics.confusion(
        test, "probability_positive", "label", limit)).select(
        F.lit(name).alias("model"), F.lit(limit).alias("best_threshold"), "neg_recall",
        "balanced_acc", "macro_f1", "accuracy")


@register("m1_i4_i5_preprocessing")
def _(q: Inputs):
    rows = order_time_rows(q)
    preprocessing = models.fit_preprocessing(part(rows, "train"), ORDER_TIME_FEATURES)
    return models.slot_means(models.encoded(preprocessing, rows))


@register("m5_m12_post_delivery_importance")
def _(q: Inputs):
    rows = encoded_rows(after_delivery_rows(q), AFTER_DELIVERY_FEATURES)
    return models.feature_importance(boosted(rows, models.POST_DELIVERY).model, rows)


@register("m8_m9_m10_model_comparison")
def _(q: Inputs):
    rows = encoded_rows(after_delivery_rows(q), AFTER_DELIVERY_FEATURES)
    forest = models.fit_classifier(part(rows, "train"), models.forest_classifier(models.BAGGED))
    first, second = boosted(rows, models.POST_DELIVERY), boosted(rows, models.SECOND_BOOSTED)
    entries = (("boosted trees", first.model, first.rounds),
               ("random forest", forest, models.BAGGED.rounds),
               ("second boosted trees", second.model, second.rounds))
    tables = [tuned_scores(m, rows, name).withColumn("rounds", F.lit(n)) for name, m, n in entries]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@register("m11_learning_curve")
def _(q: Inputs):
    rows = encoded_rows(order_time_rows(q), ORDER_TIME_FEATURES)
    model = boosted(rows, models.ORDER_TIME).model
    return models.learning_curve(model, part(rows, "train"), part(rows, "valid"))


@register("v6_track_comparison")
def _(q: Inputs):
    entries, base = [], None
    for name, rows, columns, settings in (
        ("after delivery", after_delivery_rows(q), AFTER_DELIVERY_FEATURES, models.POST_DELIVERY),
        ("order time", order_time_rows(q), ORDER_TIME_FEATURES, models.ORDER_TIME),
    ):
        coded = encoded_rows(rows, columns)
        model = boosted(coded, settings).model
        entries.append((name, len(columns), tuned_scores(model, coded, name)))
        base = coded
    majority = evaluation.majority_baseline(part(base, "train"), part(base, "test"))
    return evaluation.comparison_table([*entries, ("majority baseline", 0, majority)])


@register("m14_random_search")
def _(q: Inputs):
    rows = encoded_rows(order_time_rows(q), ORDER_TIME_FEATURES)
    estimator = models.boosted_classifier(models.TreeSettings(5, 5))
    space = {"maxDepth": [3, 4], "stepSize": [0.1, 0.3], "minInstancesPerNode": [20, 47]}
    return search.cross_validated_search(part(rows, "train"), estimator, space, sample=2)[0]


@register("m15_v7_score_regression")
def _(q: Inputs):
    rows = encoded_rows(after_delivery_rows(q), AFTER_DELIVERY_FEATURES)
    out = None
    fits = {
        "boosted": lambda: models.fit_patient(part(rows, "train"), part(rows, "valid"),
                                              models.SCORE_REGRESSION, "review_score").model,
        "forest": lambda: models.fit_forest(
            models.score_forest(models.SCORE_REGRESSION), part(rows, "train")),
    }
    for name, fit in fits.items():
        model = fit()
        errors = evaluation.overfit_table(
            models.clipped_prediction(model, rows), "prediction", "review_score")
        row = errors.select(F.lit(name).alias("model"), *errors.columns)
        out = row if out is None else out.unionByName(row)
    return out


@register("m16_polynomial_regression")
def _(q: Inputs):
    frame = stage(q.orders.select("order_id", "review_score", "is_delayed", "delivery_days",
                                  "dispatch_days", "approved_days"), "polynomial")
    return search.polynomial_search(
        frame, ["is_delayed", "delivery_days", "dispatch_days", "approved_days"], "review_score")


@register("m17_dummy_coding")
def _(q: Inputs):
    rows = order_time_rows(q)
    coded = models.encoded(models.fit_preprocessing(
        rows, ["distance_cat", "main_category"], drop_first=True), rows)
    from pyspark.ml.functions import vector_to_array
    return coded.groupBy("distance_cat", "main_category").agg(
        F.min(F.size(F.filter(vector_to_array("features"), lambda v: v > 0))).alias("ones"),
        F.min(F.size(vector_to_array("features"))).alias("slots"), F.count("*").alias("rows"),
    ).orderBy("distance_cat", "main_category")


@register("m18_scaled_forests")
def _(q: Inputs):
    rows = after_delivery_rows(q)
    columns = ["approved_days", "dispatch_days", "delivery_days", "expected_delivery_days",
               "delay_days", "main_category", "sub_category"]
    coded = encoded_rows(rows, columns, scale=True)
    settings = models.BAGGED
    two = models.fit_classifier(part(coded, "train"), models.forest_classifier(settings))
    graded = coded.withColumn("label3", features.three_class_label("review_score"))
    three = models.fit_forest(
        models.forest_classifier(settings, label="label3", weight=None), part(graded, "train"))
    accuracy = lambda model, label: model.transform(part(graded, "test")).agg(
        F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))
    return accuracy(two, "label").select(F.lit("two classes").alias("model"), "accuracy").unionByName(
        accuracy(three, "label3").select(F.lit("three classes").alias("model"), "accuracy"))


@register("m6_v9_order_time_hold_out")
def _(q: Inputs):
    rows = order_time_rows(q)
    preprocessing, train = console.prepare_training(rows.where("split != 'test'"))
    risk = console.train_risk(train)
    scored = models.with_probability(
        risk.model, models.encoded(preprocessing, part(rows, "test")), "positive_probability")
    return console.evaluate_risk(scored).withColumn("rounds", F.lit(risk.rounds))


@register("m7_v10_quantile_tradeoff")
def _(q: Inputs):
    rows = order_time_rows(q)
    preprocessing, train = console.prepare_training(rows.where("split != 'test'"))
    return console.evaluate_quantiles(preprocessing, console.train_days(train), part(rows, "test"))


@register("m7_quantile_boosting")
def _(q: Inputs):
    rows = order_time_rows(q)
    preprocessing, train = console.prepare_training(rows.where("split != 'test'"))
    fitted = console.train_quantile_boosting(train, (0.80, 0.90, 0.95))
    return console.evaluate_boosted_quantiles(fitted, preprocessing, part(rows, "test"))


@register("p5_p10_scored_hold_out")
def _(q: Inputs):
    _, scored = console.hold_out_console(order_time_rows(q))
    return scoring.first_item_rows(scored).select(
        "order_id", "review_risk_probability", "predicted_delivery_days_quantile",
        "recommended_expected_days", "adjustment_days", "risk_level", "is_track_c_target",
        F.array_join("actions", "|").alias("actions"))


@register("p7_p8_risky_orders_and_examples")
def _(q: Inputs):
    _, scored = console.hold_out_console(order_time_rows(q))
    rows = stage(scored.drop("actions"), "scored")
    ranked = scoring.high_risk_orders(rows, 50)
    examples = scoring.top_rows(rows, 20)
    columns = ["order_id", "order_item_id", "review_risk_probability", "expected_delivery_days",
               "predicted_delivery_days_quantile", "recommended_expected_days", "adjustment_days",
               "risk_level"]
    name = lambda df, kind: df.select(F.lit(kind).alias("list"), *columns)
    return name(ranked, "orders").unionByName(name(examples, "examples"))


@register("p9_what_if_scores")
def _(q: Inputs):
    """Mean risk as ordered, and had every promise been a week longer."""
    items = stage(q.items(*features.ORDER_TIME_SOURCE), "what_if")
    rows = models.staged_frame(features.order_time_frame(items, q.hub), "what_if_rows",
                               portable=True)
    fitted = console.train_models(rows.where("split != 'test'"))
    longer = features.with_overrides(
        items, expected_delivery_days=F.col("expected_delivery_days") + 7)
    out = None
    for name, source in (("as ordered", items), ("promised a week later", longer)):
        scored = console.score_orders(fitted, features.order_time_frame(source, q.hub))
        row = scored.agg(
            F.avg("review_risk_probability").alias("mean_risk"),
            F.avg((F.col("review_risk_probability") > HIGH_RISK_LIMIT).cast("double"))
            .alias("high_risk_share"), F.avg("adjustment_days").alias("mean_adjustment"))
        row = row.select(F.lit(name).alias("scenario"), *row.columns)
        out = row if out is None else out.unionByName(row)
    return out
