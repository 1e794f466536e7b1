"""Registered queries: the grouped reports."""

from pyspark.sql import functions as F

from parcelsight.plans import reports
from parcelsight.plans.catalog.aggregates import _MAIN, _SQL_HISTOGRAM
from parcelsight.plans.catalog.registry import Inputs, register

_CI = """count(review_score) AS n, round(avg(review_score), 6) AS mean,
  round(avg(review_score) - 1.96 * stddev_samp(review_score) / sqrt(count(review_score)), 6)
    AS ci_low,
  round(avg(review_score) + 1.96 * stddev_samp(review_score) / sqrt(count(review_score)), 6)
    AS ci_high"""


@register("r1_score_distribution",
          "SELECT review_score, count(*) AS n FROM sale_items GROUP BY 1 ORDER BY 1")
def _(q: Inputs):
    return reports.score_distribution(q.items("review_score"))


@register("r2_delivery_days_histogram", _SQL_HISTOGRAM.format(bins=25).replace(
    "SELECT delay_days::DOUBLE AS x FROM final_orders",
    "SELECT delivery_days::DOUBLE AS x FROM sale_items WHERE delivery_days < "
    "(SELECT quantile_cont(delivery_days, 0.95) FROM sale_items)"))
def _(q: Inputs):
    return reports.delivery_histogram(q.items("delivery_days"))


@register("r3_delay_days_histogram", _SQL_HISTOGRAM.format(bins=25).replace(
    "SELECT delay_days::DOUBLE AS x FROM final_orders",
    "SELECT delay_days::DOUBLE AS x FROM sale_items WHERE delay_days > 0 AND delay_days < "
    "(SELECT quantile_cont(delay_days, 0.95) FROM sale_items WHERE delay_days > 0)"))
def _(q: Inputs):
    return reports.delay_histogram(q.items("delay_days"))


_DELAY_LABELS = """(VALUES ('조기', 1), ('정시', 2), ('1-3일 지연', 3), ('4-6일 지연', 4),
  ('7-9일 지연', 5), ('10일 이상 지연', 6)) AS t(delay_days_cat, delay_days_cat_order)"""
_DISTANCES = ["Urban/Last-Mile", "Short-Haul", "Mid-Haul", "Long-Haul", "Continental"]


@register("r4_delay_by_distance", "SELECT t.delay_days_cat, t.delay_days_cat_order, " + ", ".join(
    f"round(avg(review_score) FILTER (WHERE distance_cat = '{d}'), 6) AS \"{d}\""
    for d in _DISTANCES) + f""" FROM {_DELAY_LABELS}
LEFT JOIN final_items i ON i.delay_days_cat = t.delay_days_cat GROUP BY 1, 2""")
def _(q: Inputs):
    return reports.delay_by_distance(q.items("delay_days_cat", "distance_cat", "review_score"))


@register("r5_top_categories_by_state", """
, s AS (SELECT customer_state, sub_category || ' (' || count(*)::VARCHAR || '건)' AS label,
    count(*) AS k, row_number() OVER (PARTITION BY customer_state
      ORDER BY count(order_id) DESC, sub_category) AS rn
  FROM sale_items WHERE customer_state IS NOT NULL GROUP BY customer_state, sub_category)
SELECT customer_state, sum(k)::BIGINT AS total_orders, max(label) FILTER (WHERE rn = 1) AS first,
  max(label) FILTER (WHERE rn = 2) AS second, max(label) FILTER (WHERE rn = 3) AS third
FROM s GROUP BY 1""")
def _(q: Inputs):
    return reports.top_categories_by_state(q.items("order_id", "customer_state", "sub_category"))


@register("r6_category_rank_shares", """
, s AS (SELECT customer_state, sub_category, count(*) AS k, row_number() OVER (
    PARTITION BY customer_state ORDER BY count(*) DESC, sub_category) AS rn
  FROM sale_items WHERE customer_state IS NOT NULL GROUP BY 1, 2),
t AS (SELECT customer_state, sum(k)::BIGINT AS total_orders FROM s GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 5),
g AS (SELECT customer_state, CASE rn WHEN 1 THEN '1위' WHEN 2 THEN '2위' WHEN 3 THEN '3위'
    ELSE 'etc' END AS rank_group, sum(k)::BIGINT AS order_count,
    CASE WHEN count(*) = 1 THEN min(sub_category) ELSE 'etc' END AS category_name
  FROM s GROUP BY 1, 2)
SELECT customer_state, total_orders, rank_group, category_name, order_count,
  round(100.0 * order_count / total_orders, 6) AS share FROM g JOIN t USING (customer_state)""")
def _(q: Inputs):
    return reports.category_rank_shares(q.items("order_id", "customer_state", "sub_category"))


_DAYS = ["delivery_days", "dispatch_days", "approved_days", "expected_delivery_days", "delay_days"]
for _key, _by in (("r7_mean_days_by_month", "order_purchase_month"),
                  ("r7_mean_days_by_weekday", "order_purchase_dayofweek")):
    @register(_key, f"SELECT {_by}, " + ", ".join(f"round(avg({d}), 6) AS {d}" for d in _DAYS)
              + " FROM sale_items GROUP BY 1")
    def _(q: Inputs, by=_by):
        return reports.calendar_means(q.items(by, *_DAYS), by, _DAYS)

for _key, _by in (("r8_volume_by_month", "order_purchase_month"),
                  ("r8_volume_by_weekday", "order_purchase_dayofweek")):
    @register(_key, f"SELECT {_by}, count(*) AS n FROM sale_items GROUP BY 1")
    def _(q: Inputs, by=_by):
        return reports.calendar_volume(q.items(by), by)


@register("r9_score_by_month",
          f"SELECT order_purchase_month, {_CI} FROM sale_items GROUP BY 1")
def _(q: Inputs):
    return reports.mean_with_interval(
        q.items("order_purchase_month", "review_score"), ["order_purchase_month"], "review_score")


for _day in ("delivery_days", "dispatch_days", "expected_delivery_days", "delay_days_int"):
    _low = ("(SELECT quantile_cont(delay_days_int, 0.05) FROM sale_items)"
            if _day == "delay_days_int" else "0")

    @register(f"r10_score_by_{_day}", f"""
SELECT {_day}, {_CI} FROM sale_items WHERE {_day} >= {_low}
  AND {_day} <= (SELECT quantile_cont({_day}, 0.95) FROM sale_items) GROUP BY 1""")
    def _(q: Inputs, day=_day):
        return reports.score_by_day_count(q.items(day, "review_score"), day)


@register("r11_score_by_short_delay", """
SELECT delay_days_int, count(*) AS n, round(avg(review_score), 6) AS avg_review_score
FROM sale_items WHERE delay_days_int BETWEEN 1 AND 10 GROUP BY 1""")
def _(q: Inputs):
    return reports.mean_score_by(q.items("delay_days_int", "review_score"), "delay_days_int", 1, 10)


@register("r12_score_gap_of_delayed_orders", """
SELECT count(*) FILTER (WHERE is_delayed = 0) AS n_on_time,
  count(*) FILTER (WHERE is_delayed = 1) AS n_delayed,
  round(avg(review_score) FILTER (WHERE is_delayed = 0), 6) AS mean_on_time,
  round(avg(review_score) FILTER (WHERE is_delayed = 1), 6) AS mean_delayed,
  round(avg(review_score) FILTER (WHERE is_delayed = 1)
    - avg(review_score) FILTER (WHERE is_delayed = 0), 6) AS difference FROM final_orders""")
def _(q: Inputs):
    return reports.delayed_gap(q.orders)


_SPEED = """
, m AS (SELECT quantile_cont(delivery_days, 0.5) AS m FROM sale_items WHERE delay_days <= 0),
g AS (SELECT CASE WHEN delay_days > 0 THEN 'delayed' WHEN delivery_days <= m THEN 'ontime_fast'
  ELSE 'ontime_slow' END AS speed_group, review_score FROM sale_items, m)"""


@register("r13_speed_groups", _SPEED + """
SELECT speed_group, speed_group_order, n, avg_review_score FROM (VALUES ('ontime_fast', 1),
  ('ontime_slow', 2), ('delayed', 3)) AS t(speed_group, speed_group_order) LEFT JOIN (
  SELECT speed_group, count(*) AS n, round(avg(review_score), 6) AS avg_review_score
  FROM g GROUP BY 1) USING (speed_group)""")
def _(q: Inputs):
    return reports.speed_group_scores(q.items("delay_days", "delivery_days", "review_score"))


@register("r14_score_by_days_and_status", f"""
SELECT delivery_days, CASE is_delayed WHEN 1 THEN 'Delayed' ELSE 'On-time' END AS status, {_CI}
FROM sale_items WHERE delivery_days <= (SELECT quantile_cont(delivery_days, 0.95) FROM sale_items)
GROUP BY 1, 2""")
def _(q: Inputs):
    return reports.score_by_days_and_status(q.items("delivery_days", "is_delayed", "review_score"))


@register("r15_score_by_expected_days", f"""
SELECT expected_delivery_days, {_CI} FROM sale_items WHERE expected_delivery_days <=
  (SELECT quantile_cont(expected_delivery_days, 0.95) FROM sale_items) GROUP BY 1""")
def _(q: Inputs):
    return reports.score_by_expected_days(q.items("expected_delivery_days", "review_score"))


@register("r16_score_by_delay_band", f"""
SELECT t.delay_days_cat, delay_days_cat_order, n, avg_review_score FROM {_DELAY_LABELS}
LEFT JOIN (SELECT delay_days_cat, count(*) AS n, round(avg(review_score), 6) AS avg_review_score
  FROM sale_items GROUP BY 1) s ON s.delay_days_cat = t.delay_days_cat""")
def _(q: Inputs):
    return reports.score_by_delay_band(q.items("delay_days_cat", "review_score"))


@register("r17_score_by_threshold_band", """
SELECT threshold_band, threshold_band_order, n, avg_review_score FROM (VALUES ('조기', 1),
  ('정시', 2), ('1-3일 지연', 3), ('4일 이상 지연', 4)) AS t(threshold_band, threshold_band_order)
LEFT JOIN (SELECT CASE WHEN delay_days < 0 THEN '조기' WHEN delay_days = 0 THEN '정시'
    WHEN delay_days <= 3 THEN '1-3일 지연' ELSE '4일 이상 지연' END AS threshold_band,
  count(*) AS n, round(avg(review_score), 6) AS avg_review_score FROM final_orders GROUP BY 1)
USING (threshold_band)""")
def _(q: Inputs):
    return reports.score_by_threshold_band(q.orders)


_DISPATCH = """
SELECT dispatch_speed, dispatch_speed_order, n, delay_rate FROM (VALUES ('당일-1일', 1),
  ('2-3일', 2), ('4-5일', 3), ('6일 이상', 4)) AS t(dispatch_speed, dispatch_speed_order)
LEFT JOIN (SELECT CASE WHEN dispatch_days <= 1 THEN '당일-1일' WHEN dispatch_days <= 3
    THEN '2-3일' WHEN dispatch_days <= 5 THEN '4-5일' ELSE '6일 이상' END AS dispatch_speed,
  count(*) AS n, round(avg(is_delayed) * 100, 6) AS delay_rate FROM {source} GROUP BY 1)
USING (dispatch_speed)"""


@register("r18_delay_rate_by_dispatch_speed", _DISPATCH.format(source="final_orders"))
def _(q: Inputs):
    return reports.delay_rate_by_dispatch(q.orders)


@register("r18_delay_rate_by_dispatch_speed_items", _DISPATCH.format(source="sale_items"))
def _(q: Inputs):
    return reports.delay_rate_by_dispatch(q.items("dispatch_days", "is_delayed"))


@register("r19_score_by_dispatch_days", """
SELECT dispatch_days, count(*) AS n, round(avg(review_score), 6) AS avg_review_score
FROM sale_items WHERE dispatch_days BETWEEN 0 AND 10 GROUP BY 1""")
def _(q: Inputs):
    return reports.mean_score_by(q.items("dispatch_days", "review_score"), "dispatch_days", 0, 10)


@register("r20_leg_days_by_score", """
SELECT review_score, round(avg(dispatch_days), 6) AS dispatch_days,
  round(avg(delivery_days - dispatch_days), 6) AS carrier_days FROM sale_items GROUP BY 1""")
def _(q: Inputs):
    return reports.leg_days_by_score(q.items("review_score", "delivery_days", "dispatch_days"))


for _key, _state in (("r21_customer_state_statistics", "customer_state"),
                     ("r24_seller_state_statistics", "seller_state")):
    @register(_key, f"""
SELECT {_state}, count(order_item_id) AS total_orders, round(avg(is_delayed) * 100, 6)
  AS delay_rate, round(avg(review_score), 6) AS avg_review_score,
  (SELECT round(avg(is_delayed) * 100, 6) FROM sale_items) AS overall_delay_rate,
  (SELECT round(avg(review_score), 6) FROM sale_items) AS overall_review_score
FROM sale_items WHERE {_state} IS NOT NULL GROUP BY 1 HAVING count(order_item_id) > 100""")
    def _(q: Inputs, state=_state):
        return reports.state_statistics(
            q.items(state, "order_item_id", "is_delayed", "review_score"), state)


@register("r22_sub_category_quadrants", """
, s AS (SELECT sub_category, avg(delivery_days) AS d, avg(is_delayed) * 100 AS l,
  avg(review_score) AS r FROM sale_items GROUP BY 1)
SELECT sub_category, round(d, 6) AS delivery_days, round(l, 6) AS delay_rate,
  round(r, 6) AS review_score, CASE WHEN d > (SELECT avg(d) FROM s) THEN
    CASE WHEN l > (SELECT avg(l) FROM s) THEN 'slow_late' ELSE 'slow_punctual' END ELSE
    CASE WHEN l > (SELECT avg(l) FROM s) THEN 'fast_late' ELSE 'fast_punctual' END END AS quadrant
FROM s""")
def _(q: Inputs):
    return reports.sub_category_quadrants(
        q.items("sub_category", "delivery_days", "is_delayed", "review_score"))


@register("r23_worst_sub_categories", """
SELECT sub_category, round(avg(review_score), 6) AS avg_review_score FROM sale_items GROUP BY 1
ORDER BY avg(review_score), sub_category DESC LIMIT 6""")
def _(q: Inputs):
    return reports.sub_category_scores(q.items("sub_category", "review_score"), worst=6)


_STATE_CATEGORY = """
, k AS (SELECT seller_state, main_category, count(*) AS orders, avg(is_delayed) * 100 AS rate
  FROM sale_items WHERE seller_state IS NOT NULL GROUP BY 1, 2),
t AS (SELECT seller_state, sum(orders)::BIGINT AS total_orders FROM k GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT {top})
SELECT seller_state, total_orders, """


@register("r25_state_category_shares", _STATE_CATEGORY.format(top=10) + ", ".join(
    f"coalesce(round(max(round_even(orders / total_orders, 4) * 100) FILTER "
    f"(WHERE main_category = '{c}'), 6), 0) AS \"{c}\"" for c in _MAIN)
    + " FROM k JOIN t USING (seller_state) GROUP BY 1, 2")
def _(q: Inputs):
    return reports.state_category_shares(
        q.items("seller_state", "main_category", "is_delayed"), _MAIN)


@register("r26_state_category_delay", _STATE_CATEGORY.format(top=7) + ", ".join(
    f"round(max(rate) FILTER (WHERE main_category = '{c}'), 6) AS \"{c}\"" for c in _MAIN)
    + " FROM k JOIN t USING (seller_state) GROUP BY 1, 2")
def _(q: Inputs):
    return reports.state_category_delay(
        q.items("seller_state", "main_category", "is_delayed"), _MAIN)


@register("r28_dispatch_gap_of_delayed_items", """
SELECT count(*) FILTER (WHERE is_delayed = 0) AS n_on_time,
  count(*) FILTER (WHERE is_delayed = 1) AS n_delayed,
  round(avg(dispatch_days) FILTER (WHERE is_delayed = 0), 6) AS mean_on_time,
  round(avg(dispatch_days) FILTER (WHERE is_delayed = 1), 6) AS mean_delayed,
  round(avg(dispatch_days) FILTER (WHERE is_delayed = 1)
    - avg(dispatch_days) FILTER (WHERE is_delayed = 0), 6) AS difference FROM sale_items""")
def _(q: Inputs):
    return reports.delayed_gap(q.items("is_delayed", "dispatch_days"), "dispatch_days")


for _key, _group in (("r29_states_by_orders", "customer_state"),
                     ("r29_cities_by_orders", "customer_city")):
    @register(_key, f"""
, c AS (SELECT {_group} AS name, count(*) AS n FROM sale_items WHERE {_group} IS NOT NULL
  GROUP BY 1)
SELECT 'top' AS side, * FROM (SELECT * FROM c ORDER BY n DESC, name LIMIT 5)
UNION ALL SELECT 'bottom', * FROM (SELECT * FROM c ORDER BY n, name LIMIT 5)""")
    def _(q: Inputs, group=_group):
        items = q.items(group)
        side = lambda df, name: df.select(
            F.lit(name).alias("side"), F.col(group).alias("name"), "n")
        return side(reports.largest_groups(items, group, 5), "top").unionByName(
            side(reports.largest_groups(items, group, 5, smallest=True), "bottom"))


@register("r30_late_deliveries", """
SELECT order_id, order_status FROM raw_orders
WHERE order_delivered_customer_date > order_estimated_delivery_date""")
def _(q: Inputs):
    return reports.late_rows(q.tables.orders).select("order_id", "order_status")
