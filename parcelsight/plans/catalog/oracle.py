"""SQL twin of the canonical tables, shared by every oracle query.

Written from the table definitions and not generated from the Spark plans;
only the fixed category lists are taken from the library.
"""

from __future__ import annotations

from parcelsight.functions.categories import (
    HISTORICAL_GROUPS, MAIN_CATEGORIES, SUB_CATEGORIES)
from parcelsight.sources.adapter import CATEGORY_CODES, category_names


def _values() -> str:
    main = {c: g for g, members in MAIN_CATEGORIES.items() for c in members}
    sub = {c: g for g, members in SUB_CATEGORIES.items() for c in members}
    rows = []
    for code, name in category_names():
        group = HISTORICAL_GROUPS[main[name]] if name in main else None
        rows.append("('{}','{}','{}','{}',{})".format(
            code, name, main.get(name, "Others"), sub.get(name, "Others"),
            f"'{group}'" if group else "NULL"))
    return ",\n".join(rows)


PRELUDE = f"""
WITH category_map(product_category_name, category, main_category, sub_category, old_group) AS (
  VALUES {_values()}),
raw_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
    CASE WHEN o_orderstatus = 'P' THEN 'shipped' ELSE 'delivered' END AS order_status,
    o_orderdate AS order_purchase_timestamp,
    CASE WHEN o_orderkey % 53 <> 0 THEN o_orderdate + to_hours(o_orderkey % 48) END
      AS order_approved_at,
    CASE WHEN o_orderkey % 37 <> 0
      THEN o_orderdate + to_hours((o_orderkey * 5 + o_custkey) % 300 - 60) END
      AS order_delivered_carrier_date,
    CASE WHEN o_orderkey % 41 <> 0
      THEN o_orderdate + to_hours((o_orderkey * 7 + o_custkey * 3) % 1200) END
      AS order_delivered_customer_date,
    o_orderdate + to_hours((o_custkey % 30 + 10) * 24) AS order_estimated_delivery_date
  FROM orders),
raw_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
    l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
    l_extendedprice * l_tax AS freight_value FROM lineitem),
score_base AS (
  SELECT *, CASE WHEN o_orderkey % 101 <> 0
    THEN substr(o_orderpriority, 1, 1)::INTEGER END AS score FROM orders),
raw_reviews AS (
  SELECT o_orderkey AS review_id, o_orderkey AS order_id, score AS review_score,
    CASE WHEN o_orderkey % 2 = 0 THEN 'ok' END AS review_comment_title,
    CASE WHEN o_orderkey % 3 = 0 THEN 'text' END AS review_comment_message,
    o_orderdate AS review_creation_date,
    o_orderdate + to_hours(720) AS review_answer_timestamp FROM score_base
  UNION ALL
  SELECT o_orderkey + 1000000000, o_orderkey, 6 - score, NULL, NULL, o_orderdate,
    CASE WHEN o_orderkey % 30 <> 0 THEN o_orderdate + to_hours(744) END
  FROM score_base WHERE o_orderkey % 10 = 0),
raw_customers AS (
  SELECT c_custkey AS customer_id, c_custkey % 1000 AS customer_unique_id,
    (c_custkey % 410)::VARCHAR AS customer_zip_code_prefix,
    'C' || (c_custkey % 90)::VARCHAR AS customer_city, n_name AS customer_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
geo_once AS (
  SELECT (c_custkey % 400)::VARCHAR AS geolocation_zip_code_prefix, c_custkey % 400 AS z,
    -33.0::DOUBLE + ((c_custkey * 37) % 3800) / 100.0::DOUBLE AS geolocation_lat,
    -70.0::DOUBLE + ((c_custkey * 53) % 3500) / 100.0::DOUBLE AS geolocation_lng,
    'C' || (c_custkey % 90)::VARCHAR AS geolocation_city, n_name AS geolocation_state
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
raw_geolocation AS (
  SELECT * EXCLUDE (z) FROM geo_once
  UNION ALL SELECT * EXCLUDE (z) FROM geo_once WHERE z % 50 = 0),
raw_sellers AS (
  SELECT s_suppkey AS seller_id, (s_suppkey * 5 % 450)::VARCHAR AS seller_zip_code_prefix,
    CASE WHEN s_suppkey % 85 <> 0 THEN 'C' || (s_suppkey % 30)::VARCHAR END AS seller_city,
    CASE WHEN s_suppkey % 70 <> 69 THEN n_name END AS seller_state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
raw_products AS (
  SELECT p_partkey AS product_id, 'cat_' || (p_partkey % {CATEGORY_CODES})::VARCHAR
      AS product_category_name,
    length(p_name)::INTEGER AS product_name_lenght,
    length(p_type)::INTEGER AS product_description_lenght,
    (p_size % 5)::INTEGER AS product_photos_qty,
    CASE WHEN p_partkey % 97 <> 0 THEN p_size * 100.0::DOUBLE END AS product_weight_g,
    CASE WHEN p_partkey % 97 <> 0 THEN p_size + 10.0::DOUBLE END AS product_length_cm,
    CASE WHEN p_partkey % 97 <> 0 THEN p_size % 20 + 5.0::DOUBLE END AS product_height_cm,
    CASE WHEN p_partkey % 97 <> 0 THEN p_size % 30 + 8.0::DOUBLE END AS product_width_cm
  FROM part),
raw_category AS (
  SELECT product_category_name, category AS product_category_name_english FROM category_map),
raw_payments AS (
  SELECT o_orderkey AS order_id, seq AS payment_sequential,
    ['credit_card','boleto','voucher','debit_card'][(o_orderkey + seq) % 4 + 1] AS payment_type,
    ((o_orderkey + seq) % 11)::INTEGER AS payment_installments,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 2.0::DOUBLE ELSE o_totalprice END
      AS payment_value
  FROM orders, (VALUES (1), (2)) AS s(seq) WHERE seq = 1 OR o_orderkey % 3 = 0),
latest_reviews AS (
  SELECT order_id, review_id, review_score, review_answer_timestamp FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id
      ORDER BY review_answer_timestamp DESC NULLS FIRST, review_id DESC) AS rn FROM raw_reviews)
  WHERE rn = 1),
clean_orders AS (
  SELECT * EXCLUDE (order_status) FROM raw_orders
  WHERE NOT coalesce(order_delivered_carrier_date > order_delivered_customer_date, FALSE)
    AND order_status = 'delivered' AND order_approved_at IS NOT NULL
    AND order_delivered_carrier_date IS NOT NULL AND order_delivered_customer_date IS NOT NULL),
timed_orders AS (
  SELECT o.*, r.review_score,
    (epoch_us(order_approved_at) - epoch_us(order_purchase_timestamp)) / 1e6 / 86400 AS d_app,
    (epoch_us(order_delivered_carrier_date) - epoch_us(order_purchase_timestamp)) / 1e6 / 86400
      AS d_dis,
    (epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)) / 1e6 / 86400
      AS d_del,
    (epoch_us(order_estimated_delivery_date) - epoch_us(order_purchase_timestamp)) / 1e6 / 86400
      AS d_exp,
    round_even((epoch_us(order_delivered_customer_date) - epoch_us(order_estimated_delivery_date))
      / 1e6 / 86400, 1) + 0.0::DOUBLE AS delay_days
  FROM clean_orders o JOIN latest_reviews r USING (order_id) WHERE r.review_score IS NOT NULL),
reviewed_orders AS (
  SELECT *, lower(dayname(order_purchase_timestamp)) AS order_purchase_dayofweek,
    month(order_purchase_timestamp)::INTEGER AS order_purchase_month,
    trunc(d_app)::INTEGER AS approved_days, trunc(d_dis)::INTEGER AS dispatch_days,
    trunc(d_del)::INTEGER AS delivery_days, trunc(d_exp)::INTEGER AS expected_delivery_days,
    trunc(delay_days)::INTEGER AS delay_days_int, (delay_days > 0)::INTEGER AS is_delayed,
    CASE WHEN delay_days < 0 THEN '조기' WHEN delay_days = 0 THEN '정시'
      WHEN delay_days <= 3 THEN '1-3일 지연' WHEN delay_days <= 6 THEN '4-6일 지연'
      WHEN delay_days <= 9 THEN '7-9일 지연' ELSE '10일 이상 지연' END AS delay_days_cat
  FROM timed_orders),
final_orders AS (SELECT * FROM reviewed_orders WHERE dispatch_days >= 0),
geo_distinct AS (SELECT DISTINCT * FROM raw_geolocation),
centroids AS (
  SELECT geolocation_zip_code_prefix AS zip,
    avg(geolocation_lat::DECIMAL(18,14)) AS lat, avg(geolocation_lng::DECIMAL(18,14)) AS lng
  FROM geo_distinct GROUP BY 1),
located_items AS (
  SELECT o.*, i.order_item_id, i.product_id, i.seller_id, i.shipping_limit_date, i.price,
    i.freight_value, c.customer_unique_id, c.customer_city, c.customer_state,
    c.customer_zip_code_prefix, s.seller_zip_code_prefix,
    s.seller_city, s.seller_state, m.category,
    coalesce(m.main_category, 'Others') AS main_category,
    coalesce(m.sub_category, 'Others') AS sub_category,
    p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm,
    gc.lat AS c_lat, gc.lng AS c_lng, gs.lat AS s_lat, gs.lng AS s_lng
  FROM reviewed_orders o
  LEFT JOIN raw_customers c ON o.customer_id = c.customer_id
  LEFT JOIN raw_items i ON o.order_id = i.order_id
  LEFT JOIN raw_products p ON i.product_id = p.product_id
  LEFT JOIN category_map m ON p.product_category_name = m.product_category_name
  LEFT JOIN raw_sellers s ON i.seller_id = s.seller_id
  LEFT JOIN centroids gc ON c.customer_zip_code_prefix = gc.zip
  LEFT JOIN centroids gs ON s.seller_zip_code_prefix = gs.zip),
city_points AS (
  SELECT 'customer' AS side, customer_city AS city, 'lat' AS axis, c_lat AS v FROM located_items
  UNION ALL SELECT 'customer', customer_city, 'lng', c_lng FROM located_items
  UNION ALL SELECT 'seller', seller_city, 'lat', s_lat FROM located_items
  UNION ALL SELECT 'seller', seller_city, 'lng', s_lng FROM located_items),
city_modes AS (
  SELECT side, city, axis, v FROM (
    SELECT side, city, axis, v, row_number() OVER (
      PARTITION BY side, city, axis ORDER BY count(*) DESC, v) AS rn
    FROM city_points WHERE v IS NOT NULL AND city IS NOT NULL GROUP BY side, city, axis, v)
  WHERE rn = 1),
filled_items AS (
  SELECT l.* REPLACE (
      coalesce(product_weight_g, (SELECT quantile_cont(product_weight_g, 0.5) FROM located_items))
        AS product_weight_g,
      coalesce(product_length_cm, (SELECT quantile_cont(product_length_cm, 0.5) FROM located_items))
        AS product_length_cm,
      coalesce(product_height_cm, (SELECT quantile_cont(product_height_cm, 0.5) FROM located_items))
        AS product_height_cm,
      coalesce(product_width_cm, (SELECT quantile_cont(product_width_cm, 0.5) FROM located_items))
        AS product_width_cm),
    coalesce(c_lat, m1.v) AS f_clat, coalesce(c_lng, m2.v) AS f_clng,
    coalesce(s_lat, m3.v) AS f_slat, coalesce(s_lng, m4.v) AS f_slng
  FROM located_items l
  LEFT JOIN city_modes m1 ON m1.side='customer' AND m1.axis='lat' AND m1.city=l.customer_city
  LEFT JOIN city_modes m2 ON m2.side='customer' AND m2.axis='lng' AND m2.city=l.customer_city
  LEFT JOIN city_modes m3 ON m3.side='seller' AND m3.axis='lat' AND m3.city=l.seller_city
  LEFT JOIN city_modes m4 ON m4.side='seller' AND m4.axis='lng' AND m4.city=l.seller_city
  WHERE dispatch_days >= 0),
measured_items AS (
  SELECT *, 2 * 6371.0::DOUBLE * asin(sqrt(
      pow(sin((radians(f_slat) - radians(f_clat)) / 2), 2)
      + cos(radians(f_clat)) * cos(radians(f_slat))
        * pow(sin((radians(f_slng) - radians(f_clng)) / 2), 2))) AS raw_km
  FROM filled_items),
full_items AS (
  SELECT *, coalesce(raw_km, (SELECT quantile_cont(raw_km, 0.5) FROM measured_items))
    AS distance_km,
    coalesce((customer_state <> seller_state)::INTEGER, 1) AS cross_state
  FROM measured_items),
final_items AS (
  SELECT *, CASE WHEN distance_km <= 50 THEN 'Urban/Last-Mile' WHEN distance_km <= 250
      THEN 'Short-Haul' WHEN distance_km <= 750 THEN 'Mid-Haul' WHEN distance_km <= 1500
      THEN 'Long-Haul' ELSE 'Continental' END AS distance_cat
  FROM full_items),
sale_items AS (
  -- item grain without fillings, for reports that need no distance
  SELECT * FROM located_items WHERE dispatch_days >= 0)
"""


def with_prelude(body: str) -> str:
    """The query text with the canonical tables in scope.

    ``body`` is a SELECT, or starts with a comma to add further named tables.
    """
    return PRELUDE + body.strip()


# The normal curve summed up in steps of 0.001: (z0, below), the share below z0.
NORMAL_GRID = """normal_grid AS (SELECT -9 + (k + 1) * 0.001::DOUBLE AS z0, sum(exp(-pow(-9 + (k + 0.5) * 0.001::DOUBLE, 2) / 2)
  * (1 + (pow(-9 + (k + 0.5) * 0.001::DOUBLE, 2) - 1) / 24e6) * 0.001 / sqrt(2 * pi())) OVER (ORDER BY k) AS below
  FROM range(18000) AS s(k))"""


def normal_quantile(rows: str, share: str) -> str:
    """SELECT of ``rows`` with the normal quantile z of a column: the grid point below it and three terms of its series."""
    step = f"(({share} - below) * sqrt(2 * pi()) * exp(z0 * z0 / 2))"
    return f"""SELECT * EXCLUDE (z0, below), z0 + {step} + z0 * pow({step}, 2) / 2 + (2 * z0 * z0 + 1) * pow({step}, 3) / 6 AS z
  FROM {rows} ASOF JOIN normal_grid ON {share} >= below"""
