"""Raw tables derived from TPC-H-like tables.

Stands in for the e-commerce files when only ``orders lineitem customer
supplier part nation`` are at hand. Delivery timestamps, reviews and locations
follow from keys by integer arithmetic, so every engine derives the same rows.
Order-grain values use order columns only and are constant within an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelsight.functions.categories import known_categories
from parcelsight.session import configure
from parcelsight.sources.tables import RawTables

HUB_STATE = "NATION_0"
# category codes above the known ones: the first has no translation, the second
# translates to a name no grouping knows
CATEGORY_CODES = len(known_categories()) + 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _plus_hours(ts: str, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours.cast("int"), F.col(ts))


def category_names() -> list[tuple[str, str]]:
    """(raw code, english name) pairs of the translation table."""
    named = [(f"cat_{i}", name) for i, name in enumerate(known_categories())]
    return named + [(f"cat_{len(named) + 1}", "not_in_any_group")]


def raw_tables(spark: SparkSession, sf_dir: str) -> RawTables:
    configure(spark)
    read = lambda name: _read(spark, sf_dir, name)
    key, cust, placed = F.col("o_orderkey"), F.col("o_custkey"), "o_orderdate"
    source_orders = read("orders").withColumn(placed, F.col(placed).cast("timestamp"))

    orders = source_orders.select(
        key.alias("order_id"),
        cust.alias("customer_id"),
        F.when(F.col("o_orderstatus") == "P", "shipped").otherwise("delivered").alias("order_status"),
        F.col(placed).alias("order_purchase_timestamp"),
        F.when(key % 53 != 0, _plus_hours(placed, key % 48)).alias("order_approved_at"),
        F.when(key % 37 != 0, _plus_hours(placed, (key * 5 + cust) % 300 - 60))
        .alias("order_delivered_carrier_date"),
        F.when(key % 41 != 0, _plus_hours(placed, (key * 7 + cust * 3) % 1200))
        .alias("order_delivered_customer_date"),
        _plus_hours(placed, (cust % 30 + 10) * 24).alias("order_estimated_delivery_date"),
    )

    items = read("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("timestamp").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
    )

    stars = F.substring("o_orderpriority", 1, 1).cast("int")
    score = F.when(key % 101 != 0, stars)
    first = source_orders.select(
        key.alias("review_id"), key.alias("order_id"), score.alias("review_score"),
        F.when(key % 2 == 0, F.lit("ok")).alias("review_comment_title"),
        F.when(key % 3 == 0, F.lit("text")).alias("review_comment_message"),
        F.col(placed).alias("review_creation_date"),
        _plus_hours(placed, F.lit(30 * 24)).alias("review_answer_timestamp"),
    )
    second = source_orders.where(key % 10 == 0).select(
        (key + 1_000_000_000).alias("review_id"), key.alias("order_id"),
        (F.lit(6) - score).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.lit(None).cast("string").alias("review_comment_message"),
        F.col(placed).alias("review_creation_date"),
        F.when(key % 30 != 0, _plus_hours(placed, F.lit(31 * 24))).alias("review_answer_timestamp"),
    )

    nation = read("nation").select("n_nationkey", "n_name")
    source_customers = read("customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    c = F.col("c_custkey")
    customers = source_customers.select(
        c.alias("customer_id"),
        (c % 1000).alias("customer_unique_id"),
        (c % 410).cast("string").alias("customer_zip_code_prefix"),
        F.concat(F.lit("C"), (c % 90).cast("string")).alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )
    geolocation = source_customers.select(
        (c % 400).cast("string").alias("geolocation_zip_code_prefix"),
        (F.lit(-33.0) + (c * 37 % 3800) / F.lit(100.0)).alias("geolocation_lat"),
        (F.lit(-70.0) + (c * 53 % 3500) / F.lit(100.0)).alias("geolocation_lng"),
        F.concat(F.lit("C"), (c % 90).cast("string")).alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
    )
    # every 50th location is reported twice, as exact duplicates
    geolocation = geolocation.unionByName(
        geolocation.where(F.col("geolocation_zip_code_prefix").cast("int") % 50 == 0))

    s = F.col("s_suppkey")
    sellers = read("supplier").join(
        nation, F.col("s_nationkey") == F.col("n_nationkey"), "left"
    ).select(
        s.alias("seller_id"),
        (s * 5 % 450).cast("string").alias("seller_zip_code_prefix"),
        F.when(s % 85 != 0, F.concat(F.lit("C"), (s % 30).cast("string"))).alias("seller_city"),
        F.when(s % 70 != 69, F.col("n_name")).alias("seller_state"),
    )

    p, size = F.col("p_partkey"), F.col("p_size")
    known = p % 97 != 0
    products = read("part").select(
        p.alias("product_id"),
        F.concat(F.lit("cat_"), (p % CATEGORY_CODES).cast("string")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_type").alias("product_description_lenght"),
        (size % 5).alias("product_photos_qty"),
        F.when(known, size * 100.0).alias("product_weight_g"),
        F.when(known, size + 10.0).alias("product_length_cm"),
        F.when(known, size % 20 + 5.0).alias("product_height_cm"),
        F.when(known, size % 30 + 8.0).alias("product_width_cm"),
    )
    category = spark.createDataFrame(
        category_names(), "product_category_name string, product_category_name_english string")

    kinds = F.array(*map(F.lit, ["credit_card", "boleto", "voucher", "debit_card"]))
    payments = (
        source_orders
        .withColumn("payment_sequential",
                    F.explode(F.when(key % 3 == 0, F.array(F.lit(1), F.lit(2)))
                              .otherwise(F.array(F.lit(1)))))
        .select(
            key.alias("order_id"),
            "payment_sequential",
            F.element_at(kinds, ((key + F.col("payment_sequential")) % 4 + 1).cast("int"))
            .alias("payment_type"),
            ((key + F.col("payment_sequential")) % 11).cast("int").alias("payment_installments"),
            (F.col("o_totalprice") / F.when(key % 3 == 0, 2.0).otherwise(1.0))
            .alias("payment_value"),
        )
    )
    return RawTables(
        customers=customers, geolocation=geolocation, order_items=items, payments=payments,
        reviews=first.unionByName(second), orders=orders, products=products, sellers=sellers,
        category=category,
    )
