"""Raw tables to the analysis table, one row per order item.

The plan is demand driven: a caller names the columns it wants and only the
tables behind them are joined. All lookups are left joins on unique keys, so
leaving one out never changes the rows. Order-grain steps (reviews, elapsed
days, filters) run before items multiply the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from parcelsight.functions import bands, categories, expressions as X
from parcelsight.operators import dedup, impute
from parcelsight.sources.sinks import stage
from parcelsight.sources.tables import RawTables

DAY_COLUMNS = ["approved_days", "dispatch_days", "delivery_days", "expected_delivery_days"]
ORDER_COLUMNS = [
    "order_id", "customer_id", "review_score", "order_purchase_dayofweek",
    "order_purchase_month", *DAY_COLUMNS, "delay_days", "delay_days_int", "is_delayed",
    "delay_days_cat",
]
CUSTOMER_COLUMNS = ["customer_unique_id", "customer_city", "customer_state"]
ITEM_COLUMNS = ["order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
                "freight_value"]
CATEGORY_COLUMNS = ["category", "main_category", "sub_category"]
DIMENSION_COLUMNS = ["product_weight_g", "product_length_cm", "product_height_cm",
                     "product_width_cm"]
SELLER_COLUMNS = ["seller_city", "seller_state"]
DISTANCE_COLUMNS = ["distance_km", "distance_cat"]
SIDES = ["customer", "seller"]

# The 33 columns of the analysis table.
FINAL_COLUMNS = [
    "order_id", "customer_id", "customer_unique_id", "seller_id", "order_item_id",
    "customer_city", "customer_state", "seller_city", "seller_state", "cross_state",
    "shipping_limit_date", "price", "freight_value", "review_score", *DIMENSION_COLUMNS,
    *CATEGORY_COLUMNS, "order_purchase_dayofweek", "order_purchase_month", *DAY_COLUMNS,
    "delay_days", "delay_days_int", "is_delayed", "delay_days_cat", *DISTANCE_COLUMNS,
]


def clean_orders(orders: DataFrame) -> DataFrame:
    """Delivered orders with all delivery times and no arrival before hand-over.

    An unknown time does not violate the hand-over rule; it is removed by the
    completeness rule instead.
    """
    late_handover = F.col("order_delivered_carrier_date") > F.col("order_delivered_customer_date")
    return (
        orders.where(~X.holds(late_handover))
        .where(F.col("order_status") == "delivered")
        .na.drop(subset=["order_approved_at", "order_delivered_carrier_date",
                         "order_delivered_customer_date"])
        .drop("order_status")
    )


def zip_centroids(geolocation: DataFrame) -> DataFrame:
    """Mean point per zip over distinct rows.

    City spelling takes part in the distinct, so variants keep their weight.
    Sums are decimal: the mean does not depend on task order.
    """
    exact = lambda c: F.avg(F.col(c).cast("decimal(18,14)")).cast("double").alias(c)
    return geolocation.dropDuplicates().groupBy("geolocation_zip_code_prefix").agg(
        exact("geolocation_lat"), exact("geolocation_lng"))


def with_centroid(people: DataFrame, centroids: DataFrame, side: str) -> DataFrame:
    """Attach the zip centroid as ``<side>_lat`` and ``<side>_lng``."""
    renamed = centroids.select(
        F.col("geolocation_zip_code_prefix").alias(f"{side}_zip_code_prefix"),
        F.col("geolocation_lat").alias(f"{side}_lat"),
        F.col("geolocation_lng").alias(f"{side}_lng"))
    return people.join(renamed, f"{side}_zip_code_prefix", "left")


def categorised_products(tables: RawTables) -> DataFrame:
    """Products with translated category and both groupings, computed per product."""
    translated = tables.products.join(tables.category, "product_category_name", "left")
    named = translated.withColumnRenamed("product_category_name_english", "category")
    return named.select(
        "product_id", "category",
        categories.main_category("category").alias("main_category"),
        categories.sub_category("category").alias("sub_category"),
        *DIMENSION_COLUMNS)


def with_elapsed_days(orders: DataFrame) -> DataFrame:
    """Day counts, delay and calendar columns from the order timestamps."""
    bought = "order_purchase_timestamp"
    arrived = "order_delivered_customer_date"
    ends = {
        "approved_days": "order_approved_at",
        "dispatch_days": "order_delivered_carrier_date",
        "delivery_days": arrived,
        "expected_delivery_days": "order_estimated_delivery_date",
    }
    days = {name: X.truncate(X.elapsed_days(end, bought)) for name, end in ends.items()}
    delay = X.round_half_even(X.elapsed_days(arrived, "order_estimated_delivery_date"), 1)
    return orders.withColumns({
        "order_purchase_dayofweek": X.weekday_name(bought),
        "order_purchase_month": F.month(bought),
        **days,
        "delay_days": delay,
    }).withColumns({
        "delay_days_int": X.truncate("delay_days"),
        # after rounding: less than 72 minutes late still counts as on time
        "is_delayed": F.when(F.col("delay_days").isNotNull(),
                             (F.col("delay_days") > 0).cast("int")),
        "delay_days_cat": bands.delay_band("delay_days"),
    })


def reviewed_orders(tables: RawTables) -> DataFrame:
    """Clean orders with their latest review and derived days, one row per order."""
    reviews = dedup.latest_reviews(tables.reviews).select("order_id", "review_score")
    joined = clean_orders(tables.orders).join(reviews, "order_id", "left")
    return with_elapsed_days(joined.na.drop(subset=["review_score"]))


def delivery_orders(tables: RawTables) -> DataFrame:
    """Order-grain analysis table; needs neither items nor any lookup.

    Hand-over more than a full day before purchase is an outlier.
    """
    return reviewed_orders(tables).where(F.col("dispatch_days") >= 0).select(*ORDER_COLUMNS)


def with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Order rows with their items; an order without items stays, its item columns missing.

    An inner join plus the leftovers instead of one outer join: adaptive
    execution can split a hot order only where both sides may be split, and the
    optional side of an outer join may not.
    """
    bare = orders.join(items.select("order_id").distinct(), "order_id", "left_anti")
    return orders.join(items, "order_id").unionByName(bare, allowMissingColumns=True)


def star_join(tables: RawTables) -> DataFrame:
    """Every raw column an item row can have: orders with all lookups joined."""
    centroids = zip_centroids(tables.geolocation)
    reviews = dedup.latest_reviews(tables.reviews)
    orders = (
        clean_orders(tables.orders)
        .join(with_centroid(tables.customers, centroids, "customer"), "customer_id", "left")
        .join(reviews, "order_id", "left")
    )
    return (
        with_items(orders, tables.order_items)
        .join(categorised_products(tables), "product_id", "left")
        .join(with_centroid(tables.sellers, centroids, "seller"), "seller_id", "left")
    )


def analysis_items(tables: RawTables, columns: Iterable[str] | None = None) -> DataFrame:
    """The analysis table at item grain, restricted to ``columns`` (default: all 33)."""
    columns = list(columns or FINAL_COLUMNS)
    wanted = set(columns)
    if wanted & {*DIMENSION_COLUMNS, *DISTANCE_COLUMNS}:
        return _imputed_items(tables, columns)

    rows = delivery_orders(tables)
    if wanted & {*CUSTOMER_COLUMNS, "cross_state"}:
        rows = rows.join(tables.customers.select("customer_id", *CUSTOMER_COLUMNS),
                         "customer_id", "left")
    rows = with_items(rows, tables.order_items)
    if wanted & set(CATEGORY_COLUMNS):
        rows = _with_category(rows, categorised_products(tables).select(
            "product_id", *CATEGORY_COLUMNS))
    if wanted & {*SELLER_COLUMNS, "cross_state"}:
        rows = rows.join(tables.sellers.select("seller_id", *SELLER_COLUMNS), "seller_id", "left")
    if "cross_state" in wanted:
        rows = rows.withColumn("cross_state", X.differs_flag("customer_state", "seller_state"))
    return rows.select(*columns)


def _with_category(rows: DataFrame, products: DataFrame) -> DataFrame:
    """A row without product falls into the same default group as an unknown one."""
    joined = rows.join(products, "product_id", "left")
    return joined.withColumns({
        c: F.coalesce(c, F.lit(categories.OTHERS)) for c in ("main_category", "sub_category")})


def reviewed_items(tables: RawTables, columns: Iterable[str] | None = None) -> DataFrame:
    """Item rows with raw lookups and derived days, before any filling; only the joins behind ``columns``."""
    points = {side: [f"{side}_{axis}" for axis in ("lat", "lng")] for side in SIDES}
    every = [*ORDER_COLUMNS, *CUSTOMER_COLUMNS, *ITEM_COLUMNS, *CATEGORY_COLUMNS, *DIMENSION_COLUMNS,
             *SELLER_COLUMNS, *(c for side in SIDES for c in points[side])]
    wanted = [c for c in every if columns is None or c in set(columns)]
    has = lambda names: bool(set(wanted) & set(names))

    def side_table(table: DataFrame, side: str) -> DataFrame:
        return with_centroid(table, zip_centroids(tables.geolocation), side) if has(points[side]) else table

    rows = reviewed_orders(tables)
    if has([*CUSTOMER_COLUMNS, *points["customer"]]):
        rows = rows.join(side_table(tables.customers, "customer"), "customer_id", "left")
    rows = with_items(rows, tables.order_items)
    if has([*CATEGORY_COLUMNS, *DIMENSION_COLUMNS]):
        rows = _with_category(rows, categorised_products(tables))
    if has([*SELLER_COLUMNS, *points["seller"]]):
        rows = rows.join(side_table(tables.sellers, "seller"), "seller_id", "left")
    return rows.select(*wanted)


def with_distance(rows: DataFrame) -> DataFrame:
    """Distance between both ends; missing distances take the exact median."""
    raw = rows.withColumn("distance_km", X.haversine_km(
        "customer_lat", "customer_lng", "seller_lat", "seller_lng"))
    filled = impute.fill_medians(raw, ["distance_km"])
    return filled.withColumn("distance_cat", bands.distance_band("distance_km"))


def _imputed_items(tables: RawTables, columns: list[str]) -> DataFrame:
    """Item rows with filled coordinates, dimensions and distance.

    The fill values are statistics of the joined rows. The joined rows are
    staged once, with no more columns than the wanted ones come from; each statistic is then a scan of
    two to five columns of the staged table, and never repeats the joins.
    """
    wanted = set(columns)
    needed = {*wanted, "dispatch_days"}
    if wanted & set(DISTANCE_COLUMNS):
        needed |= {f"{side}_{what}" for side in SIDES for what in ("lat", "lng", "city")}
    if "cross_state" in wanted:
        needed |= {"customer_state", "seller_state"}
    staged = stage(reviewed_items(tables, needed), "reviewed_items")
    rows = staged
    if wanted & set(DISTANCE_COLUMNS):
        # staged, the cities have a known size, and a small table of them is broadcast before any item row is shuffled
        points = stage(impute.city_point_modes(staged, SIDES), "city_points")
        rows = impute.fill_points_by_city(rows, SIDES, points)
    dimensions = [c for c in DIMENSION_COLUMNS if c in wanted]
    if dimensions:
        rows = impute.fill_medians(rows, dimensions, staged)
    rows = rows.where(F.col("dispatch_days") >= 0)
    if wanted & set(DISTANCE_COLUMNS):
        rows = with_distance(rows)
    if "cross_state" in wanted:
        rows = rows.withColumn("cross_state", X.differs_flag("customer_state", "seller_state"))
    return rows.select(*columns)
