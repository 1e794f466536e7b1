"""The delay-threshold test: summary, rank test and effect size in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelsight.functions import bands
from parcelsight.operators import rank_tests
from parcelsight.plans.reports import group_summary


def delayed_groups(orders: DataFrame) -> DataFrame:
    """Delayed orders labelled short or long delay."""
    return orders.where(F.col("delay_days") > 0).withColumn(
        "group", bands.delayed_split("delay_days"))


def threshold_test(orders: DataFrame) -> DataFrame:
    """Score summary of short against long delays with U, z, p, r and its label.

    ``orders`` has one row per order.
    """
    short, long = bands.DELAYED_SPLIT
    groups = delayed_groups(orders.na.drop(subset=["order_id", "review_score", "delay_days"]))
    # scores have few values
    test = rank_tests.mann_whitney(groups, "review_score", "group", short, long, bounded=True)
    packed = test.select(F.struct("u1", "z_abs", "rank_biserial_r", "p_two_sided")).scalar()
    summary = group_summary(groups, "group", "review_score")
    means = summary.agg(
        F.max(F.when(F.col("group") == short, F.col("mean")))
        - F.max(F.when(F.col("group") == long, F.col("mean"))))
    # fixed values: the names of the summary's columns
    return summary.withColumn("_t", packed).select(
        "group", "count", "mean", "median", "std",
        means.scalar().alias("mean_diff_1_3_minus_4_plus"),
        F.col("_t.u1").alias("mannwhitney_u"),
        F.col("_t.z_abs").alias("z_abs"), F.col("_t.p_two_sided").alias("p_value"),
        F.col("_t.rank_biserial_r").alias("rank_biserial_r"),
        bands.effect_label("_t.rank_biserial_r").alias("effect_size_label"),
    ).orderBy("group")


def threshold_test_with_p(orders: DataFrame) -> DataFrame:
    """``threshold_test`` with the p-value in place of z."""
    return threshold_test(orders).drop("z_abs")
