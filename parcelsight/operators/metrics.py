"""Classification, threshold and regression metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelsight.functions.expressions import col

# The swept thresholds, in percent.
SWEEP_PERCENT = range(10, 91)


def confusion(df: DataFrame, probability: str, label: str, threshold: float,
              by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp when "positive" means probability at or above the threshold."""
    said_yes, is_yes = F.col(probability) >= threshold, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(~said_yes & ~is_yes).alias("tn"), F.count_if(said_yes & ~is_yes).alias("fp"),
        F.count_if(~said_yes & is_yes).alias("fn"), F.count_if(said_yes & is_yes).alias("tp"))


def _ratio(a: Column, b: Column) -> Column:
    """Quotient with 0/0 read as 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(hit: Column, missed: Column, wrong: Column) -> Column:
    return _ratio(2 * hit, 2 * hit + missed + wrong)


def with_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy, negative recall, macro and weighted F1."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zeros, ones = tn + fp, fn + tp
    f1_zero, f1_one = _f1(tn, fp, fn), _f1(tp, fn, fp)
    return counts.withColumns({
        "accuracy": _ratio(tn + tp, zeros + ones),
        "balanced_acc": (_ratio(tn, zeros) + _ratio(tp, ones)) / 2.0,
        "neg_recall": _ratio(tn, zeros),
        "macro_f1": (f1_zero + f1_one) / 2.0,
        "weighted_f1": _ratio(f1_zero * zeros + f1_one * ones, zeros + ones),
    })


def probability_step(probability: str | Column) -> Column:
    """Largest whole percent k with k/100 <= p, exact also where p*100 rounds down."""
    p = col(probability)
    guess = F.floor(p * 100.0)
    return (F.when((guess + 1) / 100.0 <= p, guess + 1).when(guess / 100.0 > p, guess - 1)
            .otherwise(guess).cast("int"))


def threshold_sweep(df: DataFrame, probability: str, label: str) -> DataFrame:
    """All metrics at each swept threshold, from one pass over the data.

    The pass builds a histogram of at most 101 rows; running sums over it give
    the confusion counts of every threshold.
    """
    steps = df.groupBy(probability_step(probability).alias("percent")).agg(
        F.count_if(F.col(label) == 1).alias("ones"), F.count_if(F.col(label) != 1).alias("zeros"))
    grid = df.sparkSession.range(0, 101).select(F.col("id").cast("int").alias("percent"))
    below = Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = grid.join(steps, "percent", "left").na.fill(0, ["ones", "zeros"])
    summed = filled.select(
        "percent",
        F.coalesce(F.sum("zeros").over(below), F.lit(0)).alias("tn"),
        F.coalesce(F.sum("ones").over(below), F.lit(0)).alias("fn"),
        F.sum("zeros").over(everything).alias("_zeros"),
        F.sum("ones").over(everything).alias("_ones"),
    )
    counts = summed.where(
        F.col("percent").between(SWEEP_PERCENT.start, SWEEP_PERCENT.stop - 1)
    ).select(
        (F.col("percent") / 100.0).alias("threshold"), "tn",
        (F.col("_zeros") - F.col("tn")).alias("fp"), "fn",
        (F.col("_ones") - F.col("fn")).alias("tp"),
    )
    return with_scores(counts).orderBy("threshold")


def balanced_threshold(sweep: DataFrame) -> DataFrame:
    """The row where negative recall and balanced accuracy are closest; first on ties.

    The gap is compared to nine decimals so that rounding noise cannot break a tie.
    """
    gap = F.abs(F.col("neg_recall") - F.col("balanced_acc"))
    row = F.min_by(F.struct(*sweep.columns, gap.alias("gap")),
                   F.struct(F.round(gap, 9), F.col("threshold")))
    return sweep.agg(row.alias("_best")).select("_best.*")


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, with both averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(name: str, hit: Column, missed: Column, wrong: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), _ratio(hit, hit + wrong).alias("precision"),
            _ratio(hit, hit + missed).alias("recall"), _f1(hit, missed, wrong).alias("f1"),
            (hit + missed).alias("support"))

    per_class = counts.select(F.inline(F.array(line("0", tn, fp, fn), line("1", tp, fn, fp))))
    measures = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(m).alias(m) for m in measures], F.sum("support").alias("support"))
    weighted = per_class.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in measures],
        F.sum("support").alias("support"))
    name = lambda df, label: df.select(F.lit(label).alias("class"), *measures, "support")
    return per_class.unionByName(name(macro, "macro avg")).unionByName(
        name(weighted, "weighted avg"))


def regression_metrics(df: DataFrame, prediction: str, target: str,
                       by: Sequence[str] = ()) -> DataFrame:
    """n, RMSE, MAE and R2 in one pass."""
    error = F.col(target) - F.col(prediction)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (1.0 - F.try_divide(F.avg(error * error), F.var_pop(target))).alias("r2"),
    )


def pinball_loss(prediction: str | Column, target: str | Column, q: float) -> Column:
    error = col(target) - col(prediction)
    return F.greatest(error * q, error * (q - 1.0))


def promise_tradeoff(df: DataFrame, prediction: str, q: float, actual: str = "delivery_days",
                     promised: str = "expected_delivery_days", slack_days: int = 0) -> DataFrame:
    """What a recommended promise would have changed, one row for one quantile."""
    from parcelsight.plans.scoring import recommended_days

    recommended = recommended_days(promised, prediction, slack_days)
    rows = df.select(
        (F.col(actual) - F.col(promised)).alias("now"),
        (F.col(actual) - recommended).alias("then"),
        (recommended - F.col(promised)).alias("adjustment"),
        F.abs(F.col(actual) - F.col(prediction)).alias("error"),
    )
    share = lambda cond: F.avg(cond.cast("double"))
    return rows.agg(
        F.lit(float(q)).alias("quantile"),
        F.avg("error").alias("mae_against_actual_delivery_days"),
        share(F.col("now") > 0).alias("current_any_delay_rate"),
        share(F.col("then") > 0).alias("recommended_any_delay_rate"),
        share(F.col("now") > 3).alias("current_over_3_delay_rate"),
        share(F.col("then") > 3).alias("recommended_over_3_delay_rate"),
        F.avg("adjustment").alias("avg_adjustment_days"),
        # whole days, so the median's state is a few hundred counters
        F.median("adjustment").alias("median_adjustment_days"),
        share(F.col("adjustment") > 0).alias("share_orders_adjusted"),
    )
