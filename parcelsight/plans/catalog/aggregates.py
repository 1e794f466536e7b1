"""Registered queries: aggregations, windows, ordering, set operations."""

from pyspark.sql import Window, functions as F

from parcelsight.functions import bands
from parcelsight.operators import bootstrap, impute, ordering, quality, quantiles, rollup
from parcelsight.plans import prepare, reports
from parcelsight.plans.catalog.oracle import NORMAL_GRID, normal_quantile
from parcelsight.plans.catalog.registry import Inputs, register


@register("a1_zip_centroids", """
SELECT zip AS geolocation_zip_code_prefix, round(lat, 6) AS geolocation_lat,
  round(lng, 6) AS geolocation_lng FROM centroids""")
def _(q: Inputs):
    return prepare.zip_centroids(q.tables.geolocation)


@register("a2_deterministic_mode", """
SELECT seller_id, product_id FROM (SELECT seller_id, product_id, row_number() OVER (
  PARTITION BY seller_id ORDER BY count(*) DESC, product_id) AS rn FROM raw_items
  WHERE product_id IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def _(q: Inputs):
    return impute.modes(q.tables.order_items, ["seller_id"], "product_id")


@register("a3_order_roll_up", """
, k AS (SELECT order_id, product_id, seller_id, price, freight_value, product_weight_g
  FROM raw_items LEFT JOIN raw_products USING (product_id)),
pm AS (SELECT order_id, product_id FROM (SELECT order_id, product_id, row_number() OVER (
  PARTITION BY order_id ORDER BY count(*) DESC, product_id) AS rn FROM k GROUP BY 1, 2)
  WHERE rn = 1),
sm AS (SELECT order_id, seller_id FROM (SELECT order_id, seller_id, row_number() OVER (
  PARTITION BY order_id ORDER BY count(*) DESC, seller_id) AS rn FROM k GROUP BY 1, 2)
  WHERE rn = 1)
SELECT order_id, total_items, price, freight_value, product_weight_g, product_id, seller_id FROM (
  SELECT order_id, count(*) AS total_items, round(sum(price), 4) AS price,
    round(sum(freight_value), 4) AS freight_value, sum(product_weight_g) AS product_weight_g
  FROM k GROUP BY 1) JOIN pm USING (order_id) JOIN sm USING (order_id)""")
def _(q: Inputs):
    items = q.tables.order_items.join(
        q.tables.products.select("product_id", "product_weight_g"), "product_id", "left")
    rolled = rollup.order_roll_up(
        items, ["price", "freight_value", "product_weight_g"], ["product_id", "seller_id"])
    return rolled.withColumns({c: F.round(c, 4) for c in ("price", "freight_value")})


@register("a4_item_arrays_per_order", """
SELECT order_id, array_to_string(list(product_id ORDER BY product_id), ',') AS products,
  count(*) AS items FROM raw_items GROUP BY 1""")
def _(q: Inputs):
    arrays = rollup.item_arrays(q.tables.order_items, "product_id")
    return arrays.select(
        "order_id", F.array_join(
            F.transform("product_id", lambda p: p.cast("string")), ",").alias("products"), "items")


@register("a4_item_values_per_order", """
SELECT order_id, product_id, count(*) AS repeats FROM raw_items GROUP BY 1, 2""")
def _(q: Inputs):
    return rollup.item_values(q.tables.order_items, "product_id")


@register("a5_review_roll_up", """
SELECT order_id, round(avg(review_score), 6) AS review_score, count(*) AS reviews
FROM raw_reviews GROUP BY 1""")
def _(q: Inputs):
    return q.tables.reviews.groupBy("order_id").agg(
        F.avg("review_score").alias("review_score"), F.count("*").alias("reviews"))


@register("a6_exact_medians", """
SELECT round(quantile_cont(price, 0.5), 6) AS price,
  round(quantile_cont(freight_value, 0.5), 6) AS freight_value FROM raw_items""")
def _(q: Inputs):
    return quantiles.medians(q.tables.order_items, ["price", "freight_value"])


@register("a7_exact_quantiles", """
SELECT 'price' AS "column", count(price) AS n, round(quantile_cont(price, 0.05), 6) AS q_0,
  round(quantile_cont(price, 0.95), 6) AS q_1 FROM raw_items""")
def _(q: Inputs):
    return quantiles.exact_quantiles(q.tables.order_items, ["price"], [0.05, 0.95])


@register("a7_exact_quantiles_by_group", """
SELECT l_returnflag, 'l_extendedprice' AS "column", count(*) AS n,
  round(quantile_cont(l_extendedprice, 0.25), 6) AS q_0,
  round(quantile_cont(l_extendedprice, 0.9), 6) AS q_1 FROM lineitem GROUP BY 1""")
def _(q: Inputs):
    lines = q.spark.read.parquet(f"{q.sf_dir}/lineitem.parquet")
    return quantiles.exact_quantiles(lines, ["l_extendedprice"], [0.25, 0.9], ["l_returnflag"])


@register("a8_group_summary", """
SELECT delay_days_cat, count(review_score) AS "count", round(avg(review_score), 6) AS mean,
  quantile_cont(review_score, 0.5) AS median, round(stddev_samp(review_score), 6) AS std
FROM final_orders GROUP BY 1""")
def _(q: Inputs):
    return reports.group_summary(q.orders, "delay_days_cat", "review_score")


@register("a9_a11_rates_for_large_groups", """
SELECT order_purchase_month, round(avg(is_delayed) * 100, 6) AS delay_rate, count(*) AS n,
  round(avg(review_score), 6) AS avg_review_score FROM final_orders GROUP BY 1
HAVING count(*) > 100""")
def _(q: Inputs):
    return q.orders.groupBy("order_purchase_month").agg(
        (F.avg("is_delayed") * 100.0).alias("delay_rate"), F.count("*").alias("n"),
        F.avg("review_score").alias("avg_review_score")).where("n > 100")


@register("a12_sole_value_or_etc", """
SELECT seller_state, main_category, CASE WHEN count(*) = 1 THEN min(sub_category) ELSE 'etc' END
  AS sub_category, count(*) AS sub_categories FROM (
  SELECT DISTINCT seller_state, main_category, sub_category FROM sale_items
  WHERE seller_state IS NOT NULL) GROUP BY 1, 2""")
def _(q: Inputs):
    pairs = q.items("seller_state", "main_category", "sub_category").where(
        "seller_state IS NOT NULL").distinct()
    return pairs.groupBy("seller_state", "main_category").agg(
        impute.sole_or_other("sub_category").alias("sub_category"),
        F.count("*").alias("sub_categories"))


_MAIN = ["DIY & Industry", "Electronics & Tech", "Health & Beauty & Fashion", "Home & Living",
         "Leisure & Kids", "Others"]


@register("a13_pivot_counts", "SELECT seller_state, " + ", ".join(
    f"count(*) FILTER (WHERE main_category = '{c}') AS \"{c}\"" for c in _MAIN)
    + " FROM sale_items WHERE seller_state IS NOT NULL GROUP BY 1")
def _(q: Inputs):
    return reports.state_category_counts(q.items("seller_state", "main_category", "is_delayed"),
                                         _MAIN)


@register("a14_w4_share_of_group", """
SELECT delay_days_cat, review_score, count(*) AS n,
  round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY delay_days_cat), 6) AS share
FROM final_orders GROUP BY 1, 2""")
def _(q: Inputs):
    counts = q.orders.groupBy("delay_days_cat", "review_score").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("delay_days_cat")
    return counts.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(whole))


@register("a15_fixed_label_order", """
SELECT label AS delay_days_cat, delay_days_cat_order, n FROM (VALUES ('조기', 1), ('정시', 2),
  ('1-3일 지연', 3), ('4-6일 지연', 4), ('7-9일 지연', 5), ('10일 이상 지연', 6))
  AS t(label, delay_days_cat_order)
LEFT JOIN (SELECT delay_days_cat, count(*) AS n FROM final_orders WHERE delay_days > 0
  GROUP BY 1) g ON g.delay_days_cat = t.label""")
def _(q: Inputs):
    counts = q.orders.where("delay_days > 0").groupBy("delay_days_cat").agg(
        F.count("*").alias("n"))
    return reports.in_label_order(counts, "delay_days_cat", bands.DELAY_BANDS)


_SQL_HISTOGRAM = """
, v AS (SELECT delay_days::DOUBLE AS x FROM final_orders),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT least(floor((x - lo) * {bins} / (hi - lo)), {bins} - 1)::INTEGER AS bin,
  count(*) AS n FROM v, s GROUP BY 1)
SELECT r::INTEGER AS bin, round(lo + r * ((hi - lo) / {bins}), 6) AS left_edge,
  round(lo + (r + 1) * ((hi - lo) / {bins}), 6) AS right_edge, coalesce(n, 0) AS n
FROM range({bins}) AS g(r) CROSS JOIN s LEFT JOIN b ON b.bin = r"""


@register("a16_histogram", _SQL_HISTOGRAM.format(bins=40))
def _(q: Inputs):
    return quantiles.histogram(q.orders, "delay_days", 40)


@register("a17_box_statistics", """
, s AS (SELECT is_delayed, dispatch_days::DOUBLE AS v FROM final_orders),
b AS (SELECT is_delayed, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3 FROM s GROUP BY 1)
SELECT s.is_delayed, count(*) AS n, q1, median, q3,
  min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM s JOIN b USING (is_delayed) GROUP BY s.is_delayed, q1, median, q3""")
def _(q: Inputs):
    return quantiles.box_statistics(q.orders, "dispatch_days", "is_delayed")


@register("a18_mean_with_interval", """
SELECT order_purchase_month, count(*) AS n, round(avg(review_score), 6) AS mean,
  round(avg(review_score) - 1.96 * stddev_samp(review_score) / sqrt(count(*)), 6) AS ci_low,
  round(avg(review_score) + 1.96 * stddev_samp(review_score) / sqrt(count(*)), 6) AS ci_high
FROM final_orders GROUP BY 1""")
def _(q: Inputs):
    return reports.mean_with_interval(q.orders, ["order_purchase_month"], "review_score")


# Poisson quantiles of hashed keys: counted out for small counts, by their expansion for large ones.
@register("a18_mean_with_bootstrap_interval", """
, """ + NORMAL_GRID + """,
f AS (SELECT order_purchase_month AS g, review_score AS v, count(*) AS n FROM final_orders GROUP BY ALL),
d AS (SELECT *, (('0x' || substr(md5(concat_ws('|', 0, g, v, r)), 1, 13))::BIGINT + 0.5) / 4503599627370496 AS share
  FROM f, range(1, 201) AS s(r)),
z AS (""" + normal_quantile("d", "share") + """),
c AS (SELECT n, k, sum(exp(-n + k * ln(n) - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS upto
  FROM (SELECT DISTINCT n FROM f WHERE n <= 50), range(200) AS s(k)),
w AS (SELECT g, v, r, count(k)::DOUBLE AS w FROM z LEFT JOIN c ON c.n = z.n AND upto < share WHERE z.n <= 50 GROUP BY ALL
  UNION ALL SELECT g, v, r, greatest(0, floor(n + sqrt(n) * z + (z * z - 1) / 6 + (z - z * z * z) / (72 * sqrt(n)) + 0.5))
  FROM z WHERE n > 50),
m AS (SELECT g, r, sum(w * v) / sum(w) AS m FROM w GROUP BY ALL HAVING sum(w) > 0),
l AS (SELECT g, quantile_cont(m, [0.025, 0.975]) AS l FROM m GROUP BY 1)
SELECT g AS order_purchase_month, sum(n)::BIGINT AS n, round(sum(n * v) / sum(n)::DOUBLE, 6) AS mean,
  round(any_value(l)[1], 6) AS ci_low, round(any_value(l)[2], 6) AS ci_high FROM f JOIN l USING (g) GROUP BY 1""")
def _(q: Inputs):
    return bootstrap.mean_interval(q.orders, ["order_purchase_month"], "review_score")


# --- windows and order --------------------------------------------------------------------

@register("w1_w2_rank_in_state", """
SELECT customer_state, sub_category, count(*) AS order_count, row_number() OVER (
  PARTITION BY customer_state ORDER BY count(*) DESC, sub_category)::INTEGER AS rank
FROM sale_items WHERE customer_state IS NOT NULL GROUP BY 1, 2""")
def _(q: Inputs):
    return reports.ranked_categories(q.items("order_id", "customer_state", "sub_category"))


@register("w3_rank_bands", """
, r AS (SELECT customer_state, count(*) AS k, row_number() OVER (
  PARTITION BY customer_state ORDER BY count(*) DESC, sub_category) AS rn
FROM sale_items WHERE customer_state IS NOT NULL GROUP BY customer_state, sub_category)
SELECT customer_state, CASE rn WHEN 1 THEN '1위' WHEN 2 THEN '2위' WHEN 3 THEN '3위'
  ELSE 'etc' END AS rank_group, sum(k)::BIGINT AS order_count FROM r GROUP BY 1, 2""")
def _(q: Inputs):
    ranked = reports.ranked_categories(q.items("order_id", "customer_state", "sub_category"))
    return ranked.groupBy("customer_state", bands.rank_band("rank").alias("rank_group")).agg(
        F.sum("order_count").alias("order_count"))


@register("w5_k1_midranks_of_scores", """
, f AS (SELECT review_score, count(*) AS n FROM final_orders GROUP BY 1)
SELECT review_score, n, (sum(n) OVER (ORDER BY review_score) - n)::BIGINT AS cum_before,
  (sum(n) OVER ())::BIGINT AS total,
  (sum(n) OVER (ORDER BY review_score) - n + (n + 1) / 2.0)::DOUBLE AS midrank FROM f""")
def _(q: Inputs):
    return ordering.ranked_values(q.orders, "review_score", bounded=True)


@register("w5_k1_midranks_of_prices", """
, f AS (SELECT price, count(*) AS n FROM raw_items GROUP BY 1)
SELECT price, n, (sum(n) OVER (ORDER BY price) - n)::BIGINT AS cum_before,
  (sum(n) OVER ())::BIGINT AS total,
  (sum(n) OVER (ORDER BY price) - n + (n + 1) / 2.0)::DOUBLE AS midrank FROM f""")
def _(q: Inputs):
    return ordering.ranked_values(q.tables.order_items, "price")


@register("l1_sorted_metric", """
SELECT sub_category, round(avg(review_score), 6) AS avg_review_score FROM sale_items GROUP BY 1
ORDER BY 2 DESC, 1""")
def _(q: Inputs):
    return reports.sub_category_scores(q.items("sub_category", "review_score"))


@register("l2_l3_largest_and_smallest", """
, c AS (SELECT customer_city, count(*) AS n FROM sale_items WHERE customer_city IS NOT NULL
  GROUP BY 1)
SELECT 'largest' AS side, * FROM (SELECT * FROM c ORDER BY n DESC, customer_city LIMIT 5)
UNION ALL
SELECT 'smallest', * FROM (SELECT * FROM c ORDER BY n, customer_city LIMIT 5)""")
def _(q: Inputs):
    items = q.items("customer_city")
    side = lambda df, name: df.select(F.lit(name).alias("side"), "customer_city", "n")
    return side(reports.largest_groups(items, "customer_city", 5), "largest").unionByName(
        side(reports.largest_groups(items, "customer_city", 5, smallest=True), "smallest"))


@register("l7_stacked_rows", """
SELECT 'delivery_days' AS measure, round(avg(delivery_days), 6) AS mean, count(*) AS n
FROM final_orders UNION ALL
SELECT 'dispatch_days', round(avg(dispatch_days), 6), count(*) FROM final_orders UNION ALL
SELECT 'delay_days', round(avg(delay_days), 6), count(*) FROM final_orders""")
def _(q: Inputs):
    # one pass for all measures, then one row each
    measures = ["delivery_days", "dispatch_days", "delay_days"]
    sums = q.orders.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.col(m).alias("mean"), F.col("n").alias("n"))
        for m in measures])))


@register("s11_approximate_cardinality")
def _(q: Inputs):
    return quality.cardinalities(q.tables.order_items, ["order_id", "product_id", "seller_id"],
                                 approximate=True)
