"""Grouped reports over the analysis table.

Item-grain reports take the item table, order-grain reports the order table;
a review belongs to an order, so score tests and averages that must not count
an order several times use the latter. Missing group keys are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelsight.functions import bands, expressions as X
from parcelsight.operators import impute
from parcelsight.operators.quantiles import bounded_quantile, histogram, quantile_cut

COUNT_MEASURE = "n"


def _present(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def _percent(flag: str) -> Column:
    return F.avg(flag) * 100.0


def mean_with_interval(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean per group with a 95% normal interval."""
    stats = _present(df, *by).groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    half = 1.96 * F.col("_sd") / F.sqrt("n")
    return stats.select(
        *by, "n", "mean", (F.col("mean") - half).alias("ci_low"),
        (F.col("mean") + half).alias("ci_high")).orderBy(*by)


def group_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, median and sample standard deviation of a bounded-domain value."""
    return _present(df, by).groupBy(by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def in_label_order(df: DataFrame, label: str, labels: list[str]) -> DataFrame:
    """Every label in display order; a label without rows has NULL measures."""
    return bands.ordered_labels(df.sparkSession, labels, label).join(df, label, "left").orderBy(
        f"{label}_order")


def score_distribution(items: DataFrame) -> DataFrame:
    return _present(items, "review_score").groupBy("review_score").agg(
        F.count("*").alias("n")).orderBy("review_score")


def delivery_histogram(items: DataFrame, bins: int = 25) -> DataFrame:
    return histogram(quantile_cut(items, "delivery_days", 0.95, strict=True), "delivery_days", bins)


def delay_histogram(items: DataFrame, bins: int = 25) -> DataFrame:
    late = quantile_cut(items, "delay_days", 0.95, strict=True, scope=F.col("delay_days") > 0)
    return histogram(late, "delay_days", bins)


def delay_by_distance(items: DataFrame) -> DataFrame:
    """Mean score per delay band (rows) and distance band (columns)."""
    matrix = _present(items, "delay_days_cat").groupBy("delay_days_cat").pivot(
        "distance_cat", bands.DISTANCE_BANDS).agg(F.avg("review_score"))
    return in_label_order(matrix, "delay_days_cat", bands.DELAY_BANDS)


def ranked_categories(items: DataFrame) -> DataFrame:
    """Order count and rank of each sub category within its customer state."""
    counts = _present(items, "customer_state", "sub_category").groupBy(
        "customer_state", "sub_category").agg(F.count("order_id").alias("order_count"))
    place = Window.partitionBy("customer_state").orderBy(F.desc("order_count"), "sub_category")
    return counts.withColumn("rank", F.row_number().over(place))


def top_categories_by_state(items: DataFrame) -> DataFrame:
    """Three best selling sub categories of each state, next to the state's total."""
    ranked = ranked_categories(items)
    label = X.count_label("sub_category", "order_count")
    best = ranked.where("rank <= 3").groupBy("customer_state").pivot("rank", [1, 2, 3]).agg(
        F.first(label)).withColumnsRenamed({"1": "first", "2": "second", "3": "third"})
    totals = ranked.groupBy("customer_state").agg(F.sum("order_count").alias("total_orders"))
    return totals.join(best, "customer_state", "inner").select(
        "customer_state", "total_orders", "first", "second", "third",
    ).orderBy(F.desc("total_orders"), "customer_state")


def largest_groups(df: DataFrame, key: str, n: int, smallest: bool = False) -> DataFrame:
    """Top (or bottom) n groups by rows."""
    counts = _present(df, key).groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.asc("n") if smallest else F.desc("n"), key).limit(n)


def category_rank_shares(items: DataFrame, top_states: int = 5) -> DataFrame:
    """Share of the first, second, third and remaining sub categories in the top states.

    Counts are taken once for all states; the top states are picked from them.
    """
    counts = ranked_categories(items)
    best = counts.groupBy("customer_state").agg(F.sum("order_count").alias("total_orders")).orderBy(
        F.desc("total_orders"), "customer_state").limit(top_states)
    grouped = (
        counts.withColumn("rank_group", bands.rank_band("rank"))
        .groupBy("customer_state", "rank_group")
        .agg(F.sum("order_count").alias("order_count"),
             impute.sole_or_other("sub_category").alias("category_name")))
    whole = Window.partitionBy("customer_state")
    return grouped.join(best, "customer_state").select(
        "customer_state", "total_orders", "rank_group", "category_name", "order_count",
        (100.0 * F.col("order_count") / F.sum("order_count").over(whole)).alias("share"),
    ).orderBy(F.desc("total_orders"), "customer_state", "rank_group")


def calendar_means(items: DataFrame, by: str, measures: Sequence[str]) -> DataFrame:
    """Mean of each measure per month or per weekday, in calendar order."""
    out = _present(items, by).groupBy(by).agg(
        *[F.avg(m).alias(m) for m in measures])
    return out.orderBy(X.weekday_order(by) if by.endswith("dayofweek") else F.col(by))


def calendar_volume(items: DataFrame, by: str) -> DataFrame:
    out = _present(items, by).groupBy(by).agg(F.count("*").alias("n"))
    return out.orderBy(X.weekday_order(by) if by.endswith("dayofweek") else F.col(by))


def score_by_day_count(items: DataFrame, day_column: str) -> DataFrame:
    """Mean score with interval per day count, without the extreme 5% of days.

    Delays are cut on both sides, other day counts above only and at zero.
    """
    if day_column == "delay_days_int":
        kept = quantile_cut(items, day_column, 0.95, lower=0.05)
    else:
        kept = quantile_cut(items, day_column, 0.95).where(F.col(day_column) >= 0)
    return mean_with_interval(kept, [day_column], "review_score")


def mean_score_by(df: DataFrame, day_column: str, low: int, high: int) -> DataFrame:
    """Mean score per day count within a closed range."""
    return df.where(F.col(day_column).between(low, high)).groupBy(day_column).agg(
        F.count("*").alias("n"), F.avg("review_score").alias("avg_review_score")
    ).orderBy(day_column)


def delayed_gap(orders: DataFrame, value: str = "review_score") -> DataFrame:
    """n and mean of on-time and delayed rows, and mean difference delayed minus on-time."""
    late = F.col("is_delayed") == 1
    return orders.agg(
        F.count(F.when(~late, F.col(value))).alias("n_on_time"),
        F.count(F.when(late, F.col(value))).alias("n_delayed"),
        F.avg(F.when(~late, F.col(value))).alias("mean_on_time"),
        F.avg(F.when(late, F.col(value))).alias("mean_delayed"),
    ).withColumn("difference", F.col("mean_delayed") - F.col("mean_on_time"))


def with_speed_group(df: DataFrame) -> DataFrame:
    """Delayed, or on time and fast or slow against the on-time median duration."""
    limit = df.where(F.col("delay_days") <= 0).agg(
        bounded_quantile("delivery_days", 0.5).alias("m")).scalar()
    fast, slow, late = bands.SPEED_GROUPS
    return df.withColumn(
        "speed_group",
        F.when(F.col("delay_days") > 0, late)
        .when((F.col("delay_days") <= 0) & (F.col("delivery_days") <= limit), fast)
        .when(F.col("delay_days") <= 0, slow))


def speed_group_scores(df: DataFrame) -> DataFrame:
    scores = _present(with_speed_group(df), "speed_group").groupBy("speed_group").agg(
        F.count("review_score").alias("n"), F.avg("review_score").alias("avg_review_score"))
    return in_label_order(scores, "speed_group", bands.SPEED_GROUPS)


def score_by_days_and_status(items: DataFrame) -> DataFrame:
    kept = quantile_cut(items, "delivery_days", 0.95).withColumn(
        "status", X.relabel("is_delayed", bands.DELIVERY_STATUS, keep_unknown=False))
    return mean_with_interval(kept, ["delivery_days", "status"], "review_score")


def score_by_expected_days(items: DataFrame) -> DataFrame:
    kept = quantile_cut(items, "expected_delivery_days", 0.95)
    return mean_with_interval(kept, ["expected_delivery_days"], "review_score")


def score_by_delay_band(items: DataFrame) -> DataFrame:
    scores = _present(items, "delay_days_cat").groupBy("delay_days_cat").agg(
        F.count("*").alias("n"), F.avg("review_score").alias("avg_review_score"))
    return in_label_order(scores, "delay_days_cat", bands.DELAY_BANDS)


def score_by_threshold_band(orders: DataFrame) -> DataFrame:
    banded = orders.withColumn("threshold_band", bands.threshold_band("delay_days"))
    scores = _present(banded, "threshold_band").groupBy("threshold_band").agg(
        F.count("*").alias("n"), F.avg("review_score").alias("avg_review_score"))
    return in_label_order(scores, "threshold_band", bands.THRESHOLD_BANDS)


def delay_rate_by_dispatch(rows: DataFrame) -> DataFrame:
    """Share of delayed rows per dispatch-speed band."""
    banded = rows.withColumn("dispatch_speed", bands.dispatch_band("dispatch_days"))
    rates = _present(banded, "dispatch_speed").groupBy("dispatch_speed").agg(
        F.count("*").alias("n"), _percent("is_delayed").alias("delay_rate"))
    return in_label_order(rates, "dispatch_speed", bands.DISPATCH_BANDS)


def leg_days_by_score(items: DataFrame) -> DataFrame:
    """Mean dispatch leg and carrier leg per review score."""
    legs = items.withColumn("carrier_days", F.col("delivery_days") - F.col("dispatch_days"))
    return _present(legs, "review_score").groupBy("review_score").agg(
        F.avg("dispatch_days").alias("dispatch_days"), F.avg("carrier_days").alias("carrier_days"),
    ).orderBy("review_score")


def state_statistics(items: DataFrame, state: str, more_than: int = 100) -> DataFrame:
    """Rows, delay rate and mean score per state, with the overall values as baselines.

    The baselines are combined from the per-state sums, so the rows are read once.
    """
    per_state = items.groupBy(state).agg(
        F.count("order_item_id").alias("total_orders"), F.count("is_delayed").alias("_rows"),
        F.sum("is_delayed").alias("_late"), F.sum("review_score").alias("_score"))
    overall = Window.partitionBy()
    return (
        per_state.withColumns({
            "delay_rate": F.col("_late") * 100.0 / F.col("_rows"),
            "avg_review_score": F.col("_score") / F.col("_rows"),
            "overall_delay_rate": F.sum("_late").over(overall) * 100.0 / F.sum("_rows").over(overall),
            "overall_review_score": F.sum("_score").over(overall) / F.sum("_rows").over(overall),
        })
        .where(F.col(state).isNotNull() & (F.col("total_orders") > more_than))
        .drop("_rows", "_late", "_score")
        .orderBy(F.desc("delay_rate"), state))


def sub_category_quadrants(items: DataFrame) -> DataFrame:
    """Mean days, delay rate and score per sub category, split at the means over groups."""
    stats = _present(items, "sub_category").groupBy("sub_category").agg(
        F.avg("delivery_days").alias("delivery_days"), _percent("is_delayed").alias("delay_rate"),
        F.avg("review_score").alias("review_score"))
    everything = Window.partitionBy()
    slow = F.col("delivery_days") > F.avg("delivery_days").over(everything)
    late = F.col("delay_rate") > F.avg("delay_rate").over(everything)
    quadrant = (F.when(slow & late, "slow_late").when(slow, "slow_punctual")
                .when(late, "fast_late").otherwise("fast_punctual"))
    return stats.withColumn("quadrant", quadrant).orderBy("sub_category")


def sub_category_scores(items: DataFrame, worst: int | None = None) -> DataFrame:
    """Sub categories by mean score, best first; ``worst`` keeps the last few."""
    scores = _present(items, "sub_category").groupBy("sub_category").agg(
        F.avg("review_score").alias("avg_review_score"))
    if worst is None:
        return scores.orderBy(F.desc("avg_review_score"), "sub_category")
    return scores.orderBy("avg_review_score", F.desc("sub_category")).limit(worst)


def _category_counts(items: DataFrame) -> DataFrame:
    return _present(items, "seller_state", "main_category").groupBy(
        "seller_state", "main_category").agg(
        F.count("*").alias("orders"), _percent("is_delayed").alias("delay_rate"))


def state_category_shares(items: DataFrame, categories: list[str], top: int = 10) -> DataFrame:
    """Share of each main category in the sales of the largest seller states."""
    counts = _category_counts(items)
    state = Window.partitionBy("seller_state")
    shares = counts.withColumn("total_orders", F.sum("orders").over(state)).withColumn(
        "share", X.round_half_even(F.col("orders") / F.col("total_orders"), 4) * 100.0)
    return shares.groupBy("seller_state", "total_orders").pivot("main_category", categories).agg(
        F.first("share")).na.fill(0.0, categories).orderBy(
        F.desc("total_orders"), "seller_state").limit(top)


def state_category_counts(items: DataFrame, categories: list[str]) -> DataFrame:
    return _category_counts(items).groupBy("seller_state").pivot("main_category", categories).agg(
        F.first("orders")).na.fill(0, categories).orderBy("seller_state")


def state_category_delay(items: DataFrame, categories: list[str], top: int = 7) -> DataFrame:
    """Delay rate of each main category in the largest seller states."""
    counts = _category_counts(items).withColumn(
        "total_orders", F.sum("orders").over(Window.partitionBy("seller_state")))
    return counts.groupBy("seller_state", "total_orders").pivot("main_category", categories).agg(
        F.first("delay_rate")).orderBy(F.desc("total_orders"), "seller_state").limit(top)


def split_balance(frame: DataFrame) -> DataFrame:
    """Rows, orders and positive rate per split; orders are counted by a pre-aggregate."""
    per_order = frame.groupBy("split", "order_id").agg(
        F.count("*").alias("_n"), F.sum("label").alias("_ones"))
    return per_order.groupBy("split").agg(
        F.sum("_n").alias("rows"), F.count("*").alias("orders"),
        (F.sum("_ones") / F.sum("_n")).alias("positive_rate")).orderBy("split")


def late_rows(orders: DataFrame) -> DataFrame:
    """Orders that arrived after the promised timestamp."""
    return orders.where(
        F.col("order_delivered_customer_date") > F.col("order_estimated_delivery_date"))
