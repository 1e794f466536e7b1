"""Registered queries: filters, de-duplication, joins, imputation, the analysis table."""

from pyspark.sql import functions as F

from parcelsight.functions import expressions as X
from parcelsight.operators import dedup, impute, quality
from parcelsight.operators.quantiles import quantile_cut
from parcelsight.plans import prepare, reports
from parcelsight.plans.catalog.registry import Inputs, register


# --- projection, filters, casts -------------------------------------------------

@register("f1_drop_columns", """
SELECT review_id, order_id, review_score FROM raw_reviews""")
def _(q: Inputs):
    return q.tables.reviews.drop("review_comment_title", "review_comment_message",
                                 "review_creation_date", "review_answer_timestamp")


@register("f2_rename", """
SELECT geolocation_zip_code_prefix AS zip, lat AS customer_lat, lng AS customer_lng FROM (
  SELECT zip AS geolocation_zip_code_prefix, round(lat, 6) AS lat, round(lng, 6) AS lng
  FROM centroids)""")
def _(q: Inputs):
    return prepare.zip_centroids(q.tables.geolocation).withColumnsRenamed({
        "geolocation_zip_code_prefix": "zip", "geolocation_lat": "customer_lat",
        "geolocation_lng": "customer_lng"})


@register("f3_select_reorder", "SELECT review_score, order_id, delay_days FROM final_orders")
def _(q: Inputs):
    return q.orders.select("review_score", "order_id", "delay_days")


@register("f4_equality_filters", """
SELECT 'delivered orders' AS rule, count(*) FILTER (WHERE order_status = 'delivered') AS kept
FROM raw_orders UNION ALL
SELECT 'payments with installments', count(*) FILTER (WHERE payment_installments <> 0)
FROM raw_payments""")
def _(q: Inputs):
    delivered = q.tables.orders.where(F.col("order_status") == "delivered")
    paid = q.tables.payments.where(F.col("payment_installments") != 0)
    name = lambda df, rule: df.agg(F.count("*").alias("kept")).select(
        F.lit(rule).alias("rule"), "kept")
    return name(delivered, "delivered orders").unionByName(
        name(paid, "payments with installments"))


@register("f5_negated_comparison_keeps_nulls", """
SELECT order_id, order_status FROM raw_orders
WHERE NOT coalesce(order_delivered_carrier_date > order_delivered_customer_date, FALSE)""")
def _(q: Inputs):
    late = F.col("order_delivered_carrier_date") > F.col("order_delivered_customer_date")
    return q.tables.orders.where(~X.holds(late)).select("order_id", "order_status")


@register("f6_strict_comparison_drops_nulls", """
SELECT order_id FROM raw_orders WHERE order_status = 'delivered'
AND order_delivered_carrier_date <= order_delivered_customer_date""")
def _(q: Inputs):
    return q.tables.orders.where(
        (F.col("order_status") == "delivered")
        & (F.col("order_delivered_carrier_date") <= F.col("order_delivered_customer_date"))
    ).select("order_id")


@register("f7_drop_incomplete", "SELECT order_id, customer_id FROM clean_orders")
def _(q: Inputs):
    return prepare.clean_orders(q.tables.orders).select("order_id", "customer_id")


@register("f8_range_filters", """
SELECT order_id, dispatch_days, delay_days_int FROM reviewed_orders
WHERE dispatch_days >= 0 AND dispatch_days BETWEEN 0 AND 10
  AND delay_days_int > 0 AND delay_days_int <= 10""")
def _(q: Inputs):
    return q.orders.where(
        F.col("dispatch_days").between(0, 10) & (F.col("delay_days_int") > 0)
        & (F.col("delay_days_int") <= 10)).select("order_id", "dispatch_days", "delay_days_int")


@register("f9_membership_in_top_states", """
SELECT order_id, order_item_id, product_id, price, customer_state FROM sale_items
WHERE customer_state IN (
  SELECT customer_state FROM sale_items GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""")
def _(q: Inputs):
    items = q.items("order_id", "order_item_id", "product_id", "price", "customer_state")
    top = reports.largest_groups(items, "customer_state", 5).select("customer_state")
    return items.join(top, "customer_state", "left_semi")


@register("f10_quantile_cut_all_rows", """
SELECT order_id, delivery_days FROM final_orders WHERE delivery_days <= (
  SELECT quantile_cont(delivery_days, 0.95) FROM final_orders)""")
def _(q: Inputs):
    return quantile_cut(q.orders, "delivery_days", 0.95).select("order_id", "delivery_days")


@register("f10_quantile_cut_two_sided", """
SELECT order_id, delay_days_int FROM final_orders WHERE delay_days_int BETWEEN
  (SELECT quantile_cont(delay_days_int, 0.05) FROM final_orders) AND
  (SELECT quantile_cont(delay_days_int, 0.95) FROM final_orders)""")
def _(q: Inputs):
    return quantile_cut(q.orders, "delay_days_int", 0.95, lower=0.05).select(
        "order_id", "delay_days_int")


@register("f10_quantile_cut_delayed_only", """
SELECT order_id, delay_days FROM final_orders WHERE delay_days > 0 AND delay_days < (
  SELECT quantile_cont(delay_days, 0.95) FROM final_orders WHERE delay_days > 0)""")
def _(q: Inputs):
    return quantile_cut(q.orders, "delay_days", 0.95, strict=True,
                        scope=F.col("delay_days") > 0).select("order_id", "delay_days")


@register("f11_parse_timestamps", """
SELECT order_id, epoch_us(order_purchase_timestamp) AS purchase_us,
  epoch_us(order_delivered_customer_date) AS delivered_us FROM raw_orders""")
def _(q: Inputs):
    # text as it stands in raw files, parsed with an explicit pattern
    pattern = "yyyy-MM-dd HH:mm:ss"
    text = q.tables.orders.select("order_id", *[
        F.date_format(c, pattern).alias(c)
        for c in ("order_purchase_timestamp", "order_delivered_customer_date")])
    parse = lambda c: F.unix_micros(F.to_timestamp(c, pattern))
    return text.select("order_id", parse("order_purchase_timestamp").alias("purchase_us"),
                       parse("order_delivered_customer_date").alias("delivered_us"))


@register("f12_truncate_toward_zero", """
SELECT order_id, delay_days, trunc(delay_days)::INTEGER AS whole_days FROM final_orders""")
def _(q: Inputs):
    return q.orders.select("order_id", "delay_days", X.truncate("delay_days").alias("whole_days"))


@register("f15_fill_constants", """
SELECT review_id, order_id, coalesce(review_comment_title, 'None') AS review_comment_title,
  coalesce(review_comment_message, 'None') AS review_comment_message,
  coalesce(review_score, 0) AS review_score FROM raw_reviews""")
def _(q: Inputs):
    texts = ["review_comment_title", "review_comment_message"]
    filled = impute.fill_constant(q.tables.reviews, "None", texts)
    return impute.fill_constant(filled, 0, ["review_score"]).select(
        "review_id", "order_id", *texts, "review_score")


@register("f16_infinite_to_null", """
SELECT order_id, order_item_id, product_id, CASE WHEN freight_value <> 0
  THEN round(price / freight_value, 6) END AS price_per_freight FROM raw_items""")
def _(q: Inputs):
    infinite = F.when(F.col("freight_value") == 0, F.lit(float("inf"))).otherwise(
        X.safe_divide("price", "freight_value"))
    return q.tables.order_items.select(
        "order_id", "order_item_id", "product_id",
        X.finite_or_null(infinite).alias("price_per_freight"))


@register("f17_safe_divide", """
SELECT order_id, order_item_id, product_id,
  CASE WHEN freight_value <> 0 THEN round(price / freight_value, 6) END AS ratio FROM raw_items""")
def _(q: Inputs):
    return q.tables.order_items.select(
        "order_id", "order_item_id", "product_id",
        X.safe_divide("price", "freight_value").alias("ratio"))


@register("f18_clip", """
SELECT order_id, least(greatest(delay_days, 1), 5) AS clipped FROM final_orders""")
def _(q: Inputs):
    return q.orders.select("order_id", X.clip("delay_days", 1.0, 5.0).alias("clipped"))


@register("f19_row_lookup", """
SELECT * FROM (SELECT order_id, customer_id, review_score, delivery_days FROM final_orders)
WHERE order_id = (SELECT min(order_id) FROM final_orders)""")
def _(q: Inputs):
    smallest = q.orders.agg(F.min("order_id")).scalar()
    return q.orders.where(F.col("order_id") == smallest).select(
        "order_id", "customer_id", "review_score", "delivery_days")


# --- de-duplication ---------------------------------------------------------------

@register("d1_distinct_locations", """
SELECT DISTINCT geolocation_zip_code_prefix, round(geolocation_lat, 6) AS geolocation_lat,
  round(geolocation_lng, 6) AS geolocation_lng, geolocation_city, geolocation_state
FROM geo_distinct""")
def _(q: Inputs):
    return q.tables.geolocation.dropDuplicates()


@register("d2_latest_review", "SELECT order_id, review_id, review_score FROM latest_reviews")
def _(q: Inputs):
    return dedup.latest_reviews(q.tables.reviews).drop("review_answer_timestamp")


@register("d3_order_collapse", """
SELECT order_id, review_score, is_delayed, delay_days, dispatch_days FROM final_orders""")
def _(q: Inputs):
    columns = ["review_score", "is_delayed", "delay_days", "dispatch_days"]
    return dedup.collapse_orders(q.items("order_id", *columns), columns,
                                 ["is_delayed", "review_score"])


_ITEM_ORDER = "order_item_id NULLS FIRST, price NULLS FIRST, freight_value NULLS FIRST, product_id"


@register("d4_top_scored_item_per_order", f"""
SELECT order_id, order_item_id, price, freight_value FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY price DESC NULLS FIRST,
    {_ITEM_ORDER}) AS rn FROM raw_items) WHERE rn = 1""".replace(
    "freight_value FROM", "round(freight_value, 6) AS freight_value FROM"))
def _(q: Inputs):
    best = dedup.best_row(q.tables.order_items, "order_id", [
        -F.col("price"), F.col("order_item_id"), F.col("price"), F.col("freight_value"),
        F.col("product_id")])
    return best.select("order_id", "order_item_id", "price", "freight_value")


@register("d5_first_item_per_order", f"""
SELECT order_id, order_item_id, price, product_id FROM (
  SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY {_ITEM_ORDER}) AS rn
  FROM raw_items) WHERE rn = 1""")
def _(q: Inputs):
    first = dedup.best_row(q.tables.order_items, "order_id", [
        F.col(c) for c in ("order_item_id", "price", "freight_value", "product_id")])
    return first.select("order_id", "order_item_id", "price", "product_id")


@register("d6_rounded_zip_points", """
SELECT geolocation_zip_code_prefix, lat AS geolocation_lat, lng AS geolocation_lng,
  geolocation_city FROM (
  SELECT *, row_number() OVER (PARTITION BY geolocation_zip_code_prefix
    ORDER BY lat DESC, lng DESC, geolocation_city DESC) AS rn FROM (
    SELECT *, round_even(geolocation_lat, 2) AS lat, round_even(geolocation_lng, 2) AS lng
    FROM raw_geolocation)) WHERE rn = 1""")
def _(q: Inputs):
    return dedup.rounded_zip_points(q.tables.geolocation)


# --- joins --------------------------------------------------------------------------

@register("j1_category_translation", """
SELECT product_id, category, product_weight_g FROM raw_products
LEFT JOIN category_map USING (product_category_name)""")
def _(q: Inputs):
    return prepare.categorised_products(q.tables).select(
        "product_id", "category", "product_weight_g")


@register("j2_customer_points", """
SELECT customer_id, customer_city, round(lat, 6) AS customer_lat, round(lng, 6) AS customer_lng
FROM raw_customers LEFT JOIN centroids ON customer_zip_code_prefix = zip""")
def _(q: Inputs):
    points = prepare.with_centroid(
        q.tables.customers, prepare.zip_centroids(q.tables.geolocation), "customer")
    return points.select("customer_id", "customer_city", "customer_lat", "customer_lng")


@register("j3_seller_points", """
SELECT seller_id, seller_city, round(lat, 6) AS seller_lat, round(lng, 6) AS seller_lng
FROM raw_sellers LEFT JOIN centroids ON seller_zip_code_prefix = zip""")
def _(q: Inputs):
    points = prepare.with_centroid(
        q.tables.sellers, prepare.zip_centroids(q.tables.geolocation), "seller")
    return points.select("seller_id", "seller_city", "seller_lat", "seller_lng")


@register("j4_star_join", """
SELECT o.order_id, o.customer_id, i.order_item_id, i.product_id, i.seller_id, i.price,
  round(i.freight_value, 6) AS freight_value, r.review_id, r.review_score, m.category,
  c.customer_city, c.customer_state, s.seller_city, s.seller_state,
  round(gc.lat, 6) AS customer_lat, round(gs.lng, 6) AS seller_lng, p.product_weight_g
FROM clean_orders o
LEFT JOIN raw_customers c ON o.customer_id = c.customer_id
LEFT JOIN centroids gc ON gc.zip = c.customer_zip_code_prefix
LEFT JOIN raw_items i ON o.order_id = i.order_id
LEFT JOIN latest_reviews r ON o.order_id = r.order_id
LEFT JOIN raw_products p ON i.product_id = p.product_id
LEFT JOIN category_map m ON p.product_category_name = m.product_category_name
LEFT JOIN raw_sellers s ON i.seller_id = s.seller_id
LEFT JOIN centroids gs ON gs.zip = s.seller_zip_code_prefix""")
def _(q: Inputs):
    return prepare.star_join(q.tables).select(
        "order_id", "customer_id", "order_item_id", "product_id", "seller_id", "price",
        "freight_value", "review_id", "review_score", "category", "customer_city",
        "customer_state", "seller_city", "seller_state", "customer_lat", "seller_lng",
        "product_weight_g")


@register("j5_join_aggregates", """
, s AS (SELECT customer_state, sub_category, count(*) AS k,
    row_number() OVER (PARTITION BY customer_state ORDER BY count(*) DESC, sub_category) AS rn
  FROM sale_items WHERE customer_state IS NOT NULL GROUP BY 1, 2)
SELECT t.customer_state, t.total_orders, s.sub_category AS best_category, s.k AS best_orders
FROM (SELECT customer_state, count(*) AS total_orders FROM sale_items GROUP BY 1) t
JOIN s ON s.customer_state = t.customer_state AND s.rn = 1""")
def _(q: Inputs):
    ranked = reports.ranked_categories(q.items("order_id", "customer_state", "sub_category"))
    totals = ranked.groupBy("customer_state").agg(F.sum("order_count").alias("total_orders"))
    best = ranked.where("rank = 1").select(
        "customer_state", F.col("sub_category").alias("best_category"),
        F.col("order_count").alias("best_orders"))
    return totals.join(best, "customer_state", "inner")


@register("j6_group_statistic_to_rows", """
, m AS (SELECT seller_city, product_id FROM (
    SELECT seller_city, product_id, row_number() OVER (PARTITION BY seller_city
      ORDER BY count(*) DESC, product_id) AS rn
    FROM raw_items JOIN raw_sellers USING (seller_id)
    WHERE seller_city IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2) WHERE rn = 1)
SELECT i.order_id, i.order_item_id, i.product_id, s.seller_city, m.product_id AS city_product
FROM raw_items i LEFT JOIN raw_sellers s USING (seller_id)
LEFT JOIN m ON m.seller_city = s.seller_city""")
def _(q: Inputs):
    rows = q.tables.order_items.join(q.tables.sellers, "seller_id", "left").select(
        "order_id", "order_item_id", "product_id", "seller_city")
    best = impute.modes(rows.where("seller_city IS NOT NULL"), ["seller_city"], "product_id")
    return rows.join(best.withColumnRenamed("product_id", "city_product"), "seller_city", "left")


@register("j8_fan_out", """
, j1 AS (SELECT o.order_id FROM raw_orders o LEFT JOIN raw_items i ON o.order_id = i.order_id),
j2 AS (SELECT j1.order_id FROM j1 LEFT JOIN raw_payments p ON j1.order_id = p.order_id),
j3 AS (SELECT j2.order_id FROM j2 LEFT JOIN raw_reviews r ON j2.order_id = r.order_id)
SELECT 1 AS step, 'orders' AS joined, count(*) AS rows FROM raw_orders
UNION ALL SELECT 2, 'items', count(*) FROM j1 UNION ALL SELECT 3, 'payments', count(*) FROM j2
UNION ALL SELECT 4, 'reviews', count(*) FROM j3""")
def _(q: Inputs):
    t = q.tables
    return quality.fan_out(
        t.orders, [("items", t.order_items), ("payments", t.payments), ("reviews", t.reviews)],
        "order_id", "orders")


@register("j9_rolled_up_items_per_order", """
SELECT o.order_id, o.customer_id, a.total_items, round(a.price, 4) AS price,
  round(a.freight_value, 4) AS freight_value, round(r.review_score, 6) AS review_score
FROM clean_orders o
LEFT JOIN (SELECT order_id, count(*) AS total_items, sum(price) AS price,
  sum(freight_value) AS freight_value FROM raw_items GROUP BY 1) a ON a.order_id = o.order_id
LEFT JOIN (SELECT order_id, avg(review_score) AS review_score FROM raw_reviews GROUP BY 1) r
  ON r.order_id = o.order_id""")
def _(q: Inputs):
    t = q.tables
    items = t.order_items.groupBy("order_id").agg(
        F.count("*").alias("total_items"), F.round(F.sum("price"), 4).alias("price"),
        F.round(F.sum("freight_value"), 4).alias("freight_value"))
    scores = t.reviews.groupBy("order_id").agg(F.avg("review_score").alias("review_score"))
    orders = prepare.clean_orders(t.orders).select("order_id", "customer_id")
    return orders.join(items, "order_id", "left").join(scores, "order_id", "left")


# --- imputation, analysis table -------------------------------------------------------

@register("i1_points_filled_by_city_mode", """
SELECT order_id, order_item_id, product_id, round(f_clat, 6) AS customer_lat,
  round(f_clng, 6) AS customer_lng, round(f_slat, 6) AS seller_lat,
  round(f_slng, 6) AS seller_lng FROM filled_items""")
def _(q: Inputs):
    from parcelsight.sources.sinks import stage

    rows = stage(prepare.reviewed_items(q.tables), "i1")
    filled = impute.fill_points_by_city(
        rows, prepare.SIDES, impute.city_point_modes(rows, prepare.SIDES))
    return filled.where("dispatch_days >= 0").select(
        "order_id", "order_item_id", "product_id", "customer_lat", "customer_lng", "seller_lat",
        "seller_lng")


@register("i2_dimensions_filled_by_median", """
SELECT order_id, order_item_id, product_id, product_weight_g, product_length_cm,
  product_height_cm, product_width_cm FROM filled_items""")
def _(q: Inputs):
    return q.items("order_id", "order_item_id", "product_id", *prepare.DIMENSION_COLUMNS)


@register("i3_drop_unknown_distance", """
SELECT order_id, order_item_id, product_id, round(raw_km, 6) AS distance_km FROM measured_items
WHERE raw_km IS NOT NULL""")
def _(q: Inputs):
    from parcelsight.sources.sinks import stage

    rows = stage(prepare.reviewed_items(q.tables), "i3")
    filled = impute.fill_points_by_city(
        rows, prepare.SIDES, impute.city_point_modes(rows, prepare.SIDES))
    far = filled.where("dispatch_days >= 0").withColumn("distance_km", X.haversine_km(
        "customer_lat", "customer_lng", "seller_lat", "seller_lng"))
    return far.na.drop(subset=["distance_km"]).select(
        "order_id", "order_item_id", "product_id", "distance_km")


@register("e1_analysis_table", """
SELECT order_id, customer_id, customer_unique_id, seller_id, order_item_id, customer_city,
  customer_state, seller_city, seller_state, cross_state,
  epoch_us(shipping_limit_date) AS shipping_limit_us, round(price, 6) AS price,
  round(freight_value, 6) AS freight_value, review_score, product_weight_g, product_length_cm,
  product_height_cm, product_width_cm, category, main_category, sub_category,
  order_purchase_dayofweek, order_purchase_month, approved_days, dispatch_days, delivery_days,
  expected_delivery_days, delay_days, delay_days_int, is_delayed, delay_days_cat,
  round(distance_km, 6) AS distance_km, distance_cat FROM final_items""")
def _(q: Inputs):
    return q.items().withColumn(
        "shipping_limit_us", F.unix_micros("shipping_limit_date")).drop("shipping_limit_date")
