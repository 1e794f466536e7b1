"""Registered queries: derived columns, labels, model frames."""

from pyspark.sql import functions as F

from parcelsight.functions import bands, categories, expressions as X
from parcelsight.plans import features, prepare
from parcelsight.plans.catalog.registry import Inputs, register

_KEYS = ["order_id", "order_item_id", "product_id"]


@register("c1_c3_calendar", """
SELECT order_id, lower(dayname(order_purchase_timestamp)) AS weekday,
  isodow(order_purchase_timestamp)::INTEGER AS weekday_order,
  month(order_purchase_timestamp)::INTEGER AS month,
  year(order_purchase_timestamp)::INTEGER AS year,
  (isodow(order_purchase_timestamp) >= 6)::INTEGER AS is_weekend FROM raw_orders""")
def _(q: Inputs):
    ts = "order_purchase_timestamp"
    day = X.weekday_name(ts)
    return q.tables.orders.select(
        "order_id", day.alias("weekday"), X.weekday_order(day).alias("weekday_order"),
        F.month(ts).alias("month"), F.year(ts).alias("year"), X.is_weekend(day).alias("is_weekend"))


@register("c4_elapsed_days", """
SELECT order_id, approved_days, dispatch_days, delivery_days, expected_delivery_days
FROM reviewed_orders""")
def _(q: Inputs):
    return prepare.reviewed_orders(q.tables).select("order_id", *prepare.DAY_COLUMNS)


@register("c5_c7_delay", """
SELECT order_id, delay_days, delay_days_int, is_delayed FROM final_orders""")
def _(q: Inputs):
    return q.orders.select("order_id", "delay_days", "delay_days_int", "is_delayed")


@register("c8_delay_band", "SELECT order_id, delay_days_cat FROM final_orders")
def _(q: Inputs):
    return q.orders.select("order_id", "delay_days_cat")


@register("c9_c11_bands", """
SELECT order_id, CASE WHEN delay_days < 0 THEN '조기' WHEN delay_days = 0 THEN '정시'
    WHEN delay_days <= 3 THEN '1-3일 지연' ELSE '4일 이상 지연' END AS threshold_band,
  CASE WHEN delay_days > 0 THEN CASE WHEN delay_days <= 3 THEN '1-3일 지연'
    ELSE '4일 이상 지연' END END AS delayed_split,
  CASE WHEN dispatch_days <= 1 THEN '당일-1일' WHEN dispatch_days <= 3 THEN '2-3일'
    WHEN dispatch_days <= 5 THEN '4-5일' ELSE '6일 이상' END AS dispatch_speed
FROM final_orders""")
def _(q: Inputs):
    return q.orders.select(
        "order_id", bands.threshold_band("delay_days").alias("threshold_band"),
        F.when(F.col("delay_days") > 0, bands.delayed_split("delay_days")).alias("delayed_split"),
        bands.dispatch_band("dispatch_days").alias("dispatch_speed"))


@register("c12_c14_category_groups", """
SELECT product_id, category, coalesce(main_category, 'Others') AS main_category,
  coalesce(sub_category, 'Others') AS sub_category, old_group AS category_group
FROM raw_products LEFT JOIN category_map USING (product_category_name)""")
def _(q: Inputs):
    return prepare.categorised_products(q.tables).select(
        "product_id", "category", "main_category", "sub_category",
        categories.historical_group("category").alias("category_group"))


@register("c15_c16_distance", """
SELECT order_id, order_item_id, product_id, round(distance_km, 6) AS distance_km, distance_cat,
  CASE WHEN distance_km <= 50 THEN 0 WHEN distance_km <= 250 THEN 1 WHEN distance_km <= 750
    THEN 2 WHEN distance_km <= 1500 THEN 3 ELSE 4 END AS distance_code FROM final_items""")
def _(q: Inputs):
    return q.items(*_KEYS, "distance_km", "distance_cat").withColumn(
        "distance_code", bands.distance_code("distance_km"))


@register("c17_cross_state", """
SELECT order_id, order_item_id, product_id,
  coalesce((customer_state <> seller_state)::INTEGER, 1) AS cross_state FROM sale_items""")
def _(q: Inputs):
    return q.items(*_KEYS, "cross_state")


@register("c18_price_features", """
SELECT order_id, order_item_id, product_id,
  CASE WHEN price <> 0 THEN round(freight_value / price, 6) END AS freight_ratio,
  round(price + freight_value, 6) AS total_price FROM sale_items""")
def _(q: Inputs):
    priced = features.with_price_features(q.items(*_KEYS, "price", "freight_value"))
    return priced.drop("price", "freight_value")


@register("c19_c20_route", """
, f AS (SELECT *, coalesce((customer_state = 'NATION_0')::INTEGER, 0) AS c,
    coalesce((seller_state = 'NATION_0')::INTEGER, 0) AS s FROM sale_items)
SELECT order_id, order_item_id, product_id, c AS is_sp_customer, s AS is_sp_seller,
  CASE WHEN c = 1 AND s = 1 THEN 2 WHEN c = 1 OR s = 1 THEN 1 ELSE 0 END AS sp_route_type,
  CASE WHEN c = 1 AND s = 1 THEN 2 WHEN c = 1 THEN 1 ELSE 0 END AS sp_route_type_customer,
  CASE WHEN c = 1 AND s = 1 THEN 2 WHEN s = 1 THEN 1 ELSE 0 END AS sp_route_type_seller FROM f""")
def _(q: Inputs):
    items = q.items(*_KEYS, "customer_state", "seller_state")
    return features.with_route_features(items, q.hub).drop("customer_state", "seller_state")


@register("c21_c22_delivery_features", """
SELECT order_id, order_item_id, product_id,
  CASE WHEN delivery_days <> 0 THEN round(distance_km / delivery_days, 6) END AS delivery_speed,
  CASE WHEN distance_km <> 0 THEN round(delivery_days / distance_km, 6) END AS day_per_km,
  CASE WHEN expected_delivery_days <> 0
    THEN round(delivery_days / expected_delivery_days, 6) END AS delivery_ratio,
  round(delivery_days * distance_km, 6) AS delivery_distance,
  round(delivery_days * price, 6) AS delivery_price FROM final_items""")
def _(q: Inputs):
    source = ["distance_km", "delivery_days", "expected_delivery_days", "price"]
    return features.with_delivery_features(q.items(*_KEYS, *source)).drop(*source)


@register("c23_carrier_days", """
SELECT order_id, delivery_days - dispatch_days AS carrier_days,
  expected_delivery_days - delivery_days AS error_days FROM final_orders""")
def _(q: Inputs):
    # the error days (promised minus actual) have the opposite sign of a delay
    return q.orders.select(
        "order_id", (F.col("delivery_days") - F.col("dispatch_days")).alias("carrier_days"),
        (F.col("expected_delivery_days") - F.col("delivery_days")).alias("error_days"))


@register("c24_penalty_features", """
SELECT order_id, order_item_id, product_id, round(freight_value * delay_days, 6) + 0.0::DOUBLE AS
  freight_delay_penalty, round(price * delay_days, 6) + 0.0::DOUBLE AS price_delay_penalty,
  round((price + freight_value) * delay_days, 6) + 0.0::DOUBLE AS total_delay_penalty,
  round(freight_value * distance_km, 2) + 0.0::DOUBLE AS freight_distance_interaction,
  round(delivery_days * freight_value, 6) + 0.0::DOUBLE AS delivery_freight_cost,
  (order_purchase_dayofweek IN ('saturday', 'sunday'))::INTEGER AS is_weekend_purchase
FROM final_items""")
def _(q: Inputs):
    source = ["freight_value", "price", "delay_days", "distance_km", "delivery_days",
              "order_purchase_dayofweek"]
    out = features.with_penalty_features(q.items(*_KEYS, *source)).drop(*source)
    return out.withColumn("freight_distance_interaction",
                          F.round("freight_distance_interaction", 2))


@register("c25_count_label", """
SELECT sub_category || ' (' || count(*)::VARCHAR || '건)' AS label, count(*) AS n
FROM sale_items GROUP BY sub_category""")
def _(q: Inputs):
    counts = q.items("sub_category").groupBy("sub_category").agg(F.count("*").alias("n"))
    return counts.select(X.count_label("sub_category", "n").alias("label"), "n")


@register("c26_value_map", """
SELECT order_id, CASE is_delayed WHEN 1 THEN 'Delayed' WHEN 0 THEN 'On-time' END AS status,
  CASE customer_state WHEN 'NATION_0' THEN 'hub' WHEN 'NATION_1' THEN 'second'
    ELSE customer_state END AS state_name
FROM final_orders LEFT JOIN raw_customers USING (customer_id)""")
def _(q: Inputs):
    rows = q.orders.join(q.tables.customers, "customer_id", "left")
    return rows.select(
        "order_id",
        X.relabel("is_delayed", bands.DELIVERY_STATUS, keep_unknown=False).alias("status"),
        X.relabel("customer_state", {q.hub: "hub", "NATION_1": "second"}).alias("state_name"))


@register("c27_replace_whole_value", """
SELECT customer_id, CASE WHEN customer_city = 'C1' THEN 'C01' ELSE customer_city END AS city
FROM raw_customers""")
def _(q: Inputs):
    # only a value that equals the key is replaced, never a part of a longer one
    return q.tables.customers.select(
        "customer_id", X.relabel("customer_city", {"C1": "C01"}).alias("city"))


@register("c28_c29_targets", """
SELECT order_id, (review_score >= 4)::INTEGER AS label,
  CASE WHEN review_score >= 4 THEN 2 WHEN review_score = 3 THEN 1 ELSE 0 END AS label3
FROM final_orders""")
def _(q: Inputs):
    return q.orders.select(
        "order_id", features.positive_label("review_score").alias("label"),
        features.three_class_label("review_score").alias("label3"))


@register("c30_c31_effect_labels", """
, r AS (SELECT order_purchase_month, corr(dispatch_days, delivery_days) AS rho
  FROM final_orders GROUP BY 1)
SELECT order_purchase_month, CASE WHEN abs(rho) < 0.1 THEN 'Negligible'
    WHEN abs(rho) < 0.3 THEN 'Small' WHEN abs(rho) < 0.5 THEN 'Medium' ELSE 'Large' END AS level,
  CASE WHEN abs(rho) >= 0.5 THEN '큰 효과' WHEN abs(rho) >= 0.3 THEN '중간 효과'
    WHEN abs(rho) >= 0.1 THEN '작은 효과' ELSE '매우 작은 효과' END AS label,
  CASE WHEN abs(rho) > 0.5 THEN '강한' WHEN abs(rho) > 0.3 THEN '중간' ELSE '약한' END AS strength,
  CASE WHEN rho < 0 THEN '음' ELSE '양' END AS sign FROM r""")
def _(q: Inputs):
    per_month = q.orders.groupBy("order_purchase_month").agg(
        F.corr("dispatch_days", "delivery_days").alias("rho"))
    return per_month.select(
        "order_purchase_month", bands.effect_level("rho").alias("level"),
        bands.effect_label("rho").alias("label"),
        bands.correlation_strength("rho").alias("strength"),
        bands.correlation_sign("rho").alias("sign"))


_SQL_ORDER_TIME = """
, f AS (SELECT *, coalesce((customer_state = 'NATION_0')::INTEGER, 0) AS c,
    coalesce((seller_state = 'NATION_0')::INTEGER, 0) AS s FROM final_items)
SELECT order_id, review_score, delivery_days, order_item_id, round(price, 6) AS price,
  round(freight_value, 6) AS freight_value,
  CASE WHEN price <> 0 THEN round(freight_value / price, 6) END AS freight_ratio,
  round(price + freight_value, 6) AS total_price, product_weight_g, product_length_cm,
  product_height_cm, product_width_cm, order_purchase_dayofweek, order_purchase_month,
  expected_delivery_days, main_category, sub_category, round(distance_km, 6) AS distance_km,
  distance_cat, cross_state, c AS is_sp_customer, s AS is_sp_seller, c + s AS sp_route_type,
  CASE WHEN c = 1 THEN 1 + s ELSE 0 END AS sp_route_type_customer,
  CASE WHEN s = 1 THEN 1 + c ELSE 0 END AS sp_route_type_seller
"""


@register("m2_order_time_frame", _SQL_ORDER_TIME + " FROM f WHERE delivery_days IS NOT NULL")
def _(q: Inputs):
    return features.order_time_frame(q.items(*features.ORDER_TIME_SOURCE), q.hub)


@register("m3_after_delivery_frame", _SQL_ORDER_TIME.replace("SELECT order_id,", """
SELECT approved_days, dispatch_days, trunc(delay_days)::INTEGER AS delay_days, is_delayed,
  delay_days_cat,
  CASE WHEN delivery_days <> 0 THEN round(distance_km / delivery_days, 6) END AS delivery_speed,
  CASE WHEN distance_km <> 0 THEN round(delivery_days / distance_km, 6) END AS day_per_km,
  CASE WHEN expected_delivery_days <> 0
    THEN round(delivery_days / expected_delivery_days, 6) END AS delivery_ratio,
  round(delivery_days * distance_km, 6) AS delivery_distance,
  round(delivery_days * price, 6) AS delivery_price, order_id,""") + " FROM f")
def _(q: Inputs):
    return features.after_delivery_frame(q.items(*features.AFTER_DELIVERY_SOURCE), q.hub)


@register("s3_model_table", """
SELECT order_id, order_item_id, price, main_category, trunc(delay_days)::INTEGER AS delay_days,
  is_delayed, review_score FROM sale_items""")
def _(q: Inputs):
    items = q.items("order_id", "customer_id", "seller_id", "order_item_id", "price", "category",
                    "main_category", "delay_days", "delay_days_int", "is_delayed", "review_score")
    return features.model_table(items)
