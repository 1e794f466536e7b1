"""Registered queries: splits, folds, weights, threshold metrics on a known score.

The score is derived from the quantity of a line, so every metric can be checked
without a model.
"""

from pyspark.sql import DataFrame, functions as F

from parcelsight.functions.expressions import holds
from parcelsight.operators import metrics, splits
from parcelsight.plans import features, reports
from parcelsight.plans.catalog.registry import Inputs, register

# One Lehmer step on the order key: the portable form of the order split.
_HASH = "(({key} + 42) % 2147483647) * 48271 % 2147483647"
_POSITION = f"({_HASH.format(key='order_id')}) % 1000"
_SPLIT = (f"CASE WHEN {_POSITION} < 200 THEN 'test' WHEN {_POSITION} < 360 THEN 'valid' "
          "ELSE 'train' END")


def labelled_items(q: Inputs) -> DataFrame:
    """Item rows with a binary label and the portable split of their order."""
    rows = q.items("order_id", "order_item_id", "product_id", "review_score", "delivery_days",
                   "expected_delivery_days", "delay_days")
    return splits.with_split(
        rows.withColumn("label", features.positive_label("review_score")), portable=True)


def scored_lines(q: Inputs) -> DataFrame:
    """(order, label, probability) per line; probability comes from the quantity."""
    lines = q.spark.read.parquet(f"{q.sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("order_id"),
        ((F.col("l_quantity") - 1) / 49.0).alias("probability"))
    reviews = q.orders.select("order_id", features.positive_label("review_score").alias("label"),
                              "delivery_days", "expected_delivery_days")
    return lines.join(reviews, "order_id")


_SCORED = """
, scored AS (SELECT l_orderkey AS order_id, (l_quantity - 1) / 49.0::DOUBLE AS p,
    (review_score >= 4)::INTEGER AS y, delivery_days, expected_delivery_days
  FROM lineitem JOIN final_orders ON l_orderkey = order_id)"""


def _counts(threshold: str) -> str:
    return (f"count(*) FILTER (WHERE p < {threshold} AND y = 0)::DOUBLE AS tn, "
            f"count(*) FILTER (WHERE p >= {threshold} AND y = 0)::DOUBLE AS fp, "
            f"count(*) FILTER (WHERE p < {threshold} AND y = 1)::DOUBLE AS fn, "
            f"count(*) FILTER (WHERE p >= {threshold} AND y = 1)::DOUBLE AS tp")


_SCORES = """(tn + tp) / (tn + fp + fn + tp) AS accuracy,
  (tn / (tn + fp) + tp / (fn + tp)) / 2 AS balanced_acc, tn / (tn + fp) AS neg_recall,
  (2 * tn / (2 * tn + fp + fn) + 2 * tp / (2 * tp + fp + fn)) / 2 AS macro_f1,
  (2 * tn / (2 * tn + fp + fn) * (tn + fp) + 2 * tp / (2 * tp + fp + fn) * (fn + tp))
    / (tn + fp + fn + tp) AS weighted_f1"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in (
    "accuracy", "balanced_acc", "neg_recall", "macro_f1", "weighted_f1"))
_WHOLE = ", ".join(f"{c}::BIGINT AS {c}" for c in ("tn", "fp", "fn", "tp"))


@register("g1_order_split", f"SELECT order_id, {_SPLIT} AS split FROM final_orders")
def _(q: Inputs):
    return splits.with_split(q.orders, portable=True).select("order_id", "split")


@register("g1_order_split_any_key")
def _(q: Inputs):
    # hash of any key type; the counts per split follow from the whole table
    return splits.with_split(q.orders).groupBy("split").agg(F.count("*").alias("orders"))


@register("g2_stratified_folds", f"""
SELECT order_id, y AS stratum, ((row_number() OVER (PARTITION BY y
    ORDER BY {_HASH.format(key='order_id')}, order_id) - 1) % 3)::INTEGER AS fold
FROM (SELECT order_id, (review_score >= 4)::INTEGER AS y FROM final_orders)""")
def _(q: Inputs):
    return splits.stratified_folds(labelled_items(q), "label", portable=True)


@register("g3_stratified_row_sample")
def _(q: Inputs):
    rows = splits.stratified_row_sample(labelled_items(q), "label", 0.8, [0, 1])
    return rows.groupBy("label").agg(F.count("*").alias("rows")).orderBy("label")


@register("g4_leak_report", f"""
SELECT 'by order' AS split_kind, count(*) AS orders, 0::BIGINT AS overlapping_orders
FROM final_orders UNION ALL
SELECT 'by row', count(*), count(*) FILTER (WHERE a <> b) FROM (
  SELECT order_id, min(s) AS a, max(s) AS b FROM (
    SELECT order_id, CASE WHEN ({_HASH.format(key="coalesce(product_id, 0)")}) % 1000 < 200
      THEN 'test' ELSE 'train' END AS s FROM sale_items) GROUP BY 1)""")
def _(q: Inputs):
    rows = labelled_items(q)
    # a split that looks at the row and not at the order
    product = F.coalesce("product_id", F.lit(0))
    by_row = rows.withColumn("split", F.when(
        splits.order_share(product, portable=True) < 200, "test").otherwise("train"))
    name = lambda df, kind: df.select(F.lit(kind).alias("split_kind"), "orders",
                                      "overlapping_orders")
    return name(splits.split_overlap(rows), "by order").unionByName(
        name(splits.split_overlap(by_row), "by row"))


@register("j7_l6_split_intersection", f"""
, s AS (SELECT order_id, {_SPLIT} AS split FROM sale_items)
SELECT count(*) AS shared_orders FROM (SELECT order_id FROM s WHERE split = 'train'
  INTERSECT SELECT order_id FROM s WHERE split = 'test')""")
def _(q: Inputs):
    rows = labelled_items(q)
    side = lambda name: rows.where(holds(F.col("split") == name)).select("order_id")
    return side("train").intersect(side("test")).agg(F.count("*").alias("shared_orders"))


@register("r27_split_balance", f"""
SELECT split, count(*) AS rows, count(DISTINCT order_id) AS orders,
  round(avg(label), 6) AS positive_rate FROM (
  SELECT order_id, {_SPLIT} AS split, (review_score >= 4)::INTEGER AS label FROM sale_items)
GROUP BY 1""")
def _(q: Inputs):
    return reports.split_balance(labelled_items(q))


@register("m4_class_weights", """
SELECT label, n, round((SELECT count(*) FROM sale_items) / (2.0 * n), 6) AS weight FROM (
  SELECT (review_score >= 4)::INTEGER AS label, count(*) AS n FROM sale_items GROUP BY 1)""")
def _(q: Inputs):
    return splits.class_weights(labelled_items(q))


@register("m13_majority_baseline", f"""
, t AS (SELECT (review_score >= 4)::INTEGER AS y, {_SPLIT} AS split FROM sale_items),
m AS (SELECT y AS major FROM t WHERE split <> 'test' GROUP BY 1 ORDER BY count(*) DESC, 1
  LIMIT 1),
c AS (SELECT count(*) FILTER (WHERE major = 0 AND y = 0)::DOUBLE AS tn,
  count(*) FILTER (WHERE major = 1 AND y = 0)::DOUBLE AS fp,
  count(*) FILTER (WHERE major = 0 AND y = 1)::DOUBLE AS fn,
  count(*) FILTER (WHERE major = 1 AND y = 1)::DOUBLE AS tp FROM t, m WHERE split = 'test')
SELECT {_WHOLE}, round((tn + tp) / (tn + fp + fn + tp), 6) AS accuracy,
  round((tn / (tn + fp) + tp / (fn + tp)) / 2, 6) AS balanced_acc,
  round(tn / (tn + fp), 6) AS neg_recall,
  round((coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)
    + coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) / 2, 6) AS macro_f1,
  round((2 * tn / (2 * tn + fp + fn) * (tn + fp) + 2 * tp / (2 * tp + fp + fn) * (fn + tp))
    / (tn + fp + fn + tp), 6) AS weighted_f1 FROM c""")
def _(q: Inputs):
    from parcelsight.plans.evaluation import majority_baseline

    rows = labelled_items(q)
    return majority_baseline(rows.where("split != 'test'"), rows.where("split = 'test'"))


@register("v1_v2_scores_at_threshold", _SCORED + f"""
, c AS (SELECT {_counts('0.53')} FROM scored), m AS (SELECT *, {_SCORES} FROM c)
SELECT {_WHOLE}, {_ROUNDED} FROM m""")
def _(q: Inputs):
    return metrics.with_scores(metrics.confusion(scored_lines(q), "probability", "label", 0.53))


_SWEEP = _SCORED + f"""
, t AS (SELECT k / 100.0::DOUBLE AS threshold FROM range(10, 91) AS g(k)),
c AS (SELECT threshold, {_counts('threshold')} FROM scored, t GROUP BY 1),
m AS (SELECT *, {_SCORES} FROM c)"""


@register("v3_w6_threshold_sweep", _SWEEP + f"""
SELECT threshold, {_WHOLE}, {_ROUNDED} FROM m""")
def _(q: Inputs):
    return metrics.threshold_sweep(scored_lines(q), "probability", "label")


@register("v4_l5_balanced_threshold", _SWEEP + f"""
SELECT threshold, {_WHOLE}, {_ROUNDED}, round(abs(neg_recall - balanced_acc), 6) AS gap FROM m
ORDER BY round(abs(neg_recall - balanced_acc), 9), threshold LIMIT 1""")
def _(q: Inputs):
    return metrics.balanced_threshold(
        metrics.threshold_sweep(scored_lines(q), "probability", "label"))


@register("v5_class_report", _SCORED + f"""
, c AS (SELECT {_counts('0.53')} FROM scored),
l AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r,
    2 * tn / (2 * tn + fp + fn) AS f, tn + fp AS s FROM c
  UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), fn + tp
  FROM c),
a AS (SELECT * FROM l UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(s) FROM l
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s),
    sum(f * s) / sum(s), sum(s) FROM l)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  s::BIGINT AS support FROM a""")
def _(q: Inputs):
    return metrics.class_report(metrics.confusion(scored_lines(q), "probability", "label", 0.53))


@register("v7_regression_metrics", _SCORED + """
SELECT count(*) AS n, round(sqrt(avg(pow(delivery_days - p * 50, 2))), 6) AS rmse,
  round(avg(abs(delivery_days - p * 50)), 6) AS mae,
  round(1 - avg(pow(delivery_days - p * 50, 2)) / var_pop(delivery_days), 6) AS r2 FROM scored""")
def _(q: Inputs):
    rows = scored_lines(q).withColumn("prediction", F.col("probability") * 50.0)
    return metrics.regression_metrics(rows, "prediction", "delivery_days")


@register("v8_overfit_table", _SCORED + f"""
, m AS (SELECT {_SPLIT} AS split, sqrt(avg(pow(delivery_days - p * 50, 2))) AS rmse,
  avg(abs(delivery_days - p * 50)) AS mae FROM scored GROUP BY 1)
SELECT round(max(rmse) FILTER (WHERE split = 'train'), 6) AS train_rmse,
  round(max(rmse) FILTER (WHERE split = 'valid'), 6) AS valid_rmse,
  round(max(rmse) FILTER (WHERE split = 'train')
    - max(rmse) FILTER (WHERE split = 'valid'), 6) AS rmse_gap,
  round(max(mae) FILTER (WHERE split = 'train')
    - max(mae) FILTER (WHERE split = 'valid'), 6) AS mae_gap FROM m""")
def _(q: Inputs):
    from parcelsight.plans.evaluation import overfit_table

    rows = splits.with_split(scored_lines(q), portable=True).withColumn(
        "prediction", F.col("probability") * 50.0)
    return overfit_table(rows, "prediction", "delivery_days")


@register("v10_promise_tradeoff", _SCORED + """
, q AS (SELECT unnest([0.8, 0.9, 0.95])::DOUBLE AS q),
s AS (SELECT q, delivery_days AS d, expected_delivery_days AS e, p * 50 * q AS pred,
  greatest(expected_delivery_days::DOUBLE, ceil(p * 50 * q)) AS rec FROM scored, q)
SELECT q AS quantile, round(avg(abs(d - pred)), 6) AS mae_against_actual_delivery_days,
  round(avg((d - e > 0)::INTEGER), 6) AS current_any_delay_rate,
  round(avg((d - rec > 0)::INTEGER), 6) AS recommended_any_delay_rate,
  round(avg((d - e > 3)::INTEGER), 6) AS current_over_3_delay_rate,
  round(avg((d - rec > 3)::INTEGER), 6) AS recommended_over_3_delay_rate,
  round(avg(rec - e), 6) AS avg_adjustment_days,
  round(quantile_cont(rec - e, 0.5), 6) AS median_adjustment_days,
  round(avg((rec - e > 0)::INTEGER), 6) AS share_orders_adjusted FROM s GROUP BY 1""")
def _(q: Inputs):
    rows, out = scored_lines(q), None
    for level in (0.8, 0.9, 0.95):
        predicted = rows.withColumn("prediction", F.col("probability") * 50 * level)
        row = metrics.promise_tradeoff(predicted, "prediction", level)
        out = row if out is None else out.unionByName(row)
    return out
