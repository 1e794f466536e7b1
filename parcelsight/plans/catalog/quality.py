"""Registered queries: sources, profiling, data quality."""

import uuid

from pyspark.sql import functions as F

from parcelsight.operators import quality
from parcelsight.plans.catalog.registry import Inputs, register
from parcelsight.sources import readers, sinks
from parcelsight.sources.sinks import staging_root

_SIZES = " UNION ALL ".join(
    f"SELECT '{label}' AS \"table\", count(*) AS rows, {columns} AS columns FROM {source}"
    for label, source, columns in [
        ("customers", "raw_customers", 5), ("geolocation", "raw_geolocation", 5),
        ("order_items", "raw_items", 7), ("payments", "raw_payments", 5),
        ("reviews", "raw_reviews", 7), ("orders", "raw_orders", 8),
        ("products", "raw_products", 9), ("sellers", "raw_sellers", 4),
        ("category", "raw_category", 2)])


@register("s1_raw_table_sizes", _SIZES)
def _(q: Inputs):
    return quality.table_sizes(q.tables)


@register("s1_csv_round_trip", """
SELECT seller_id, seller_city, seller_state FROM raw_sellers""")
def _(q: Inputs):
    """Sellers written as CSV with their columns in another order, and read by the header's names."""
    folder = f"{staging_root(q.spark)}/parcelsight/s1-{uuid.uuid4().hex}"
    sellers = q.tables.sellers
    sellers.select(*reversed(sellers.columns)).write.option("header", True).option("escape", '"').csv(
        f"{folder}/sellers.csv")
    return readers.read_raw(q.spark, folder, "sellers").select(
        F.col("seller_id").cast("long").alias("seller_id"), "seller_city", "seller_state")


@register("s1_quoted_csv_in_ranges", """
SELECT review_id, order_id, review_score, review_comment_title,
  review_comment_message || chr(10) || 'a "quoted" word, and' || chr(10) || chr(10) || 'the end' AS review_comment_message
FROM raw_reviews""")
def _(q: Inputs):
    """Reviews with line breaks, quotes and commas in their messages, written as CSV and read range by range."""
    folder = f"{staging_root(q.spark)}/parcelsight/s1-{uuid.uuid4().hex}"
    text = F.concat("review_comment_message", F.lit('\na "quoted" word, and\n\nthe end'))
    q.tables.reviews.withColumn("review_comment_message", text).write.option("header", True).option(
        "escape", '"').csv(f"{folder}/reviews.csv")
    reviews = readers.read_raw(q.spark, folder, "reviews")
    return reviews.select(*(F.col(c).cast("long").alias(c) for c in ("review_id", "order_id")), "review_score",
                          "review_comment_title", "review_comment_message")


@register("s2_s3_snapshot_round_trip", """
SELECT order_id, product_id, seller_id, order_item_id FROM raw_items""")
def _(q: Inputs):
    path = f"{staging_root(q.spark)}/parcelsight/s3-{uuid.uuid4().hex}"
    sinks.write_snapshot(q.tables.order_items, path)
    return readers.read_snapshot(q.spark, path, "s3").select(
        "order_id", "product_id", "seller_id", "order_item_id")


@register("s4_result_round_trip", """
SELECT seller_state, count(*) AS sellers FROM raw_sellers GROUP BY 1""")
def _(q: Inputs):
    path = f"{staging_root(q.spark)}/parcelsight/s4-{uuid.uuid4().hex}"
    sinks.write_result(q.tables.sellers.groupBy("seller_state").agg(F.count("*").alias("sellers")), path)
    return q.spark.read.option("header", True).schema("seller_state string, sellers long").csv(path)


_NUMERIC = ["order_item_id", "price", "freight_value"]


@register("s5_numeric_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
    round(max({c})::DOUBLE, 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
    round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75
    FROM raw_items""" for c in _NUMERIC))
def _(q: Inputs):
    return quality.numeric_profile(q.tables.order_items, _NUMERIC)


_TEXT = ["customer_zip_code_prefix", "customer_city", "customer_state"]


@register("s5_text_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", sum(k)::BIGINT AS n, count(*) AS "unique",
    arg_min(v, (-k, v)) AS top, max(k)::BIGINT AS freq FROM (
      SELECT {c} AS v, count(*) AS k FROM raw_customers WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in _TEXT))
def _(q: Inputs):
    return quality.text_profile(q.tables.customers, _TEXT)


_ORDER_COLUMNS = [
    "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date",
    "order_estimated_delivery_date"]


@register("s6_null_profile", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM raw_orders"""
    for c in _ORDER_COLUMNS) + ") WHERE missing > 0 ORDER BY missing DESC")
def _(q: Inputs):
    return quality.null_profile(q.tables.orders)


@register("s7_duplicate_items_by_key", """
SELECT sum(k - 1)::BIGINT AS surplus_rows, coalesce(sum(CASE WHEN k > 1 THEN k END), 0)::BIGINT
  AS member_rows
FROM (SELECT count(*) AS k FROM raw_items GROUP BY order_id, order_item_id)""")
def _(q: Inputs):
    return quality.duplicate_counts(q.tables.order_items, ["order_id", "order_item_id"])


@register("s7_duplicate_whole_rows", """
SELECT sum(k - 1)::BIGINT AS surplus_rows, coalesce(sum(CASE WHEN k > 1 THEN k END), 0)::BIGINT
  AS member_rows
FROM (SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, geolocation_city,
  geolocation_state, count(*) AS k FROM raw_geolocation GROUP BY 1, 2, 3, 4, 5)""")
def _(q: Inputs):
    geo = q.tables.geolocation
    return quality.duplicate_counts(geo, geo.columns)


# All nine tables with their measures and their texts; identifiers are texts.
_TABLES = {
    "customers": ("raw_customers", [], ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city",
                                        "customer_state"]),
    "geolocation": ("raw_geolocation", ["geolocation_lat", "geolocation_lng"],
                    ["geolocation_zip_code_prefix", "geolocation_city", "geolocation_state"]),
    "order_items": ("raw_items", ["order_item_id", "price", "freight_value"], ["order_id", "product_id", "seller_id"]),
    "payments": ("raw_payments", ["payment_sequential", "payment_installments", "payment_value"],
                 ["order_id", "payment_type"]),
    "reviews": ("raw_reviews", ["review_score"], ["review_id", "order_id", "review_comment_title", "review_comment_message"]),
    "orders": ("raw_orders", [], ["order_id", "customer_id", "order_status"]),
    "products": ("raw_products", ["product_name_lenght", "product_description_lenght", "product_photos_qty",
                                  "product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"],
                 ["product_id", "product_category_name"]),
    "sellers": ("raw_sellers", [], ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"]),
    "category": ("raw_category", [], ["product_category_name", "product_category_name_english"]),
}
_TIMES = {"order_items": ["shipping_limit_date"], "reviews": ["review_creation_date", "review_answer_timestamp"],
          "orders": _ORDER_COLUMNS[3:]}


def _over_tables(q: Inputs, profile, chosen=lambda name: True):
    """A profile of every chosen table, with the table's name before its rows."""
    out = None
    for name in filter(chosen, _TABLES):
        rows = profile(name, getattr(q.tables, name))
        rows = rows.select(F.lit(name).alias("table"), *rows.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


@register("s5_numeric_profile_of_all_tables", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
    round(max({c})::DOUBLE, 6) AS max, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25,
    round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75
    FROM {source}""" for name, (source, measures, _) in _TABLES.items() for c in measures))
def _(q: Inputs):
    return _over_tables(q, lambda name, df: quality.numeric_profile(df, _TABLES[name][1]), lambda name: _TABLES[name][1])


@register("s5_text_profile_of_all_tables", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", '{c}' AS "column", sum(k)::BIGINT AS n, count(*) AS "unique",
    arg_min(v, (-k, v)) AS top, max(k)::BIGINT AS freq FROM (
      SELECT {c}::VARCHAR AS v, count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY 1) HAVING count(*) > 0"""
    for name, (source, _, texts) in _TABLES.items() for c in texts))
def _(q: Inputs):
    return _over_tables(q, lambda name, df: quality.text_profile(df, _TABLES[name][2]))


@register("s6_null_profile_of_all_tables", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", '{c}' AS "column", count(*) - count({c}) AS missing,
    round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 6) AS missing_pct FROM {source}"""
    for name, (source, measures, texts) in _TABLES.items() for c in [*measures, *texts, *_TIMES.get(name, [])])
    + ") WHERE missing > 0")
def _(q: Inputs):
    return _over_tables(q, lambda name, df: quality.null_profile(df))


@register("s7_duplicate_rows_of_all_tables", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", coalesce(sum(k - 1), 0)::BIGINT AS surplus_rows,
    coalesce(sum(CASE WHEN k > 1 THEN k END), 0)::BIGINT AS member_rows FROM (SELECT count(*) AS k FROM {source}
    GROUP BY {', '.join([*measures, *texts, *_TIMES.get(name, [])])})"""
    for name, (source, measures, texts) in _TABLES.items()))
def _(q: Inputs):
    return _over_tables(q, lambda name, df: quality.duplicate_counts(df, df.columns))


@register("s7_duplicate_review_members", """
SELECT order_id, review_id, review_score FROM raw_reviews WHERE order_id IN (
  SELECT order_id FROM raw_reviews GROUP BY 1 HAVING count(*) > 1)""")
def _(q: Inputs):
    rows = quality.duplicate_members(q.tables.reviews, ["order_id"])
    return rows.select("order_id", "review_id", "review_score")


@register("s8_preview", """
SELECT order_id, order_item_id, product_id, seller_id, price FROM raw_items
ORDER BY order_id, order_item_id, product_id, seller_id, price LIMIT 20""")
def _(q: Inputs):
    keys = ["order_id", "order_item_id", "product_id", "seller_id", "price"]
    return q.tables.order_items.select(*keys).orderBy(*keys).limit(20)


@register("s9_frequency_table", """
SELECT delay_days_cat, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM sale_items GROUP BY 1 ORDER BY 2 DESC, 1""")
def _(q: Inputs):
    return quality.frequency_table(q.items("delay_days_cat"), "delay_days_cat")


@register("s10_distinct_options", """
SELECT DISTINCT seller_state FROM sale_items WHERE seller_state IS NOT NULL ORDER BY 1""")
def _(q: Inputs):
    return quality.distinct_options(q.items("seller_state"), "seller_state")


@register("s11_cardinalities", """
SELECT 'customer_city' AS "column", count(DISTINCT customer_city) AS "distinct" FROM sale_items
UNION ALL SELECT 'customer_state', count(DISTINCT customer_state) FROM sale_items""")
def _(q: Inputs):
    return quality.cardinalities(
        q.items("customer_city", "customer_state"), ["customer_city", "customer_state"])


_RULES = [
    ("purchase > approved", "order_purchase_timestamp > order_approved_at"),
    ("approved > carrier", "order_approved_at > order_delivered_carrier_date"),
    ("carrier > delivered", "order_delivered_carrier_date > order_delivered_customer_date"),
    ("delivered < purchase", "order_delivered_customer_date < order_purchase_timestamp")]


@register("f13_timeline_violations", " UNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) FILTER (WHERE {cond}) AS violations FROM raw_orders"
    for name, cond in _RULES))
def _(q: Inputs):
    return quality.timeline_violations(q.tables.orders)


@register("f13_timeline_examples", " UNION ALL ".join(
    f"(SELECT '{name}' AS rule, order_id FROM raw_orders WHERE {cond} ORDER BY order_id LIMIT 5)"
    for name, cond in _RULES))
def _(q: Inputs):
    return quality.timeline_examples(q.tables.orders)


@register("j10_unmatched_customers", """
SELECT customer_id, customer_zip_code_prefix, customer_city FROM raw_customers
WHERE customer_zip_code_prefix NOT IN (SELECT zip FROM centroids)""")
def _(q: Inputs):
    missed = quality.unmatched_rows(
        q.tables.customers, q.tables.geolocation,
        "customer_zip_code_prefix", "geolocation_zip_code_prefix")
    return missed.select("customer_id", "customer_zip_code_prefix", "customer_city")


@register("f14_column_kinds", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS kind, count({present}) AS present FROM sale_items"""
    for c, kind, present in (("price", "numeric", "price"), ("review_score", "numeric", "review_score"),
                             ("delay_days_cat", "categorical", "delay_days"),
                             ("delivery_days", "numeric", "delivery_days"))))
def _(q: Inputs):
    items = q.items("order_id", "price", "review_score", "delay_days_cat", "delivery_days")
    numeric, other = quality.split_by_type(items, exclude=["order_id"])
    kinds = {**dict.fromkeys(numeric, "numeric"), **dict.fromkeys(other, "categorical")}
    # one row per column, with how many rows carry a value
    return items.agg(*[F.count(c).alias(c) for c in kinds]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(c).alias("present"))
        for c, kind in kinds.items()])))
