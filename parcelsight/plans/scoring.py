"""From model outputs to a risk level, a promised date and a work list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.functions import bands
from parcelsight.functions.expressions import col
from parcelsight.operators import dedup

# Columns shown in the high-risk list.
HIGH_RISK_VIEW = [
    "order_id", "review_risk_probability", "expected_delivery_days",
    "predicted_delivery_days_quantile", "recommended_expected_days", "adjustment_days", "price",
    "freight_value", "main_category", "sub_category", "distance_km", "customer_state",
    "seller_state",
]
# Items of one order may repeat an item number, so ranking needs more columns.
TIE_COLUMNS = ["order_id", "order_item_id", "price", "freight_value"]


def risk_probability(positive: str | Column) -> Column:
    return F.lit(1.0) - col(positive)


def recommended_days(promised: str | Column, predicted: str | Column,
                     slack_days: int = 0) -> Column:
    """The promise, raised to the predicted day when that is later.

    ``slack_days`` lowers the prediction first, for a policy that tolerates a
    short delay.
    """
    needed = F.ceil(col(predicted) - float(slack_days)).cast("double")
    return F.greatest(col(promised).cast("double"), needed)


def with_decision(df: DataFrame, risk: str = "review_risk_probability",
                  predicted: str = "predicted_delivery_days_quantile",
                  promised: str = "expected_delivery_days",
                  high: float = bands.HIGH_RISK_LIMIT, caution: float = bands.CAUTION_LIMIT,
                  slack_days: int = 0) -> DataFrame:
    """Recommended days, adjustment, risk level and target flag.

    Moving a limit only relabels: the models behind the scores stay as they are.
    """
    return df.withColumn(
        "recommended_expected_days", recommended_days(promised, predicted, slack_days)
    ).withColumns({
        "adjustment_days": F.col("recommended_expected_days") - F.col(promised),
        "risk_level": bands.risk_level(risk, high, caution),
        "is_track_c_target": F.col(risk) > high,
    })


def riskiest_row_per_order(scored: DataFrame) -> DataFrame:
    ties = [c for c in TIE_COLUMNS if c in scored.columns]
    return dedup.best_row(
        scored, "order_id", [-F.col("review_risk_probability"), *[F.col(c) for c in ties]])


def high_risk_orders(scored: DataFrame, n: int | None = None) -> DataFrame:
    """Orders at high risk, one row each, riskiest first; ``n`` makes it a top list."""
    at_risk = scored.where(F.col("risk_level") == bands.RISK_LEVELS[0])
    ranked = riskiest_row_per_order(at_risk).orderBy(
        F.desc("review_risk_probability"), "order_id")
    return ranked if n is None else ranked.limit(n)


def first_item_rows(scored: DataFrame) -> DataFrame:
    """One row per order: its first item."""
    ties = [c for c in TIE_COLUMNS if c in scored.columns and c != "order_id"]
    return dedup.best_row(scored, "order_id", [F.col(c) for c in ties])


def top_rows(scored: DataFrame, n: int, high_risk_only: bool = True) -> DataFrame:
    """The n riskiest item rows; an order may appear several times."""
    rows = scored.where(F.col("risk_level") == bands.RISK_LEVELS[0]) if high_risk_only else scored
    ties = [c for c in TIE_COLUMNS if c in scored.columns]
    return rows.orderBy(F.desc("review_risk_probability"), *ties).limit(n)
