"""The analysis table on hand-made raw tables."""

import datetime as dt

import pytest

from parcelsight.plans import features, prepare
from parcelsight.sources.schemas import RAW_SCHEMAS
from parcelsight.sources.tables import RawTables

T0 = dt.datetime(2018, 1, 1, 10, 0, 0)


def at(days=0.0):
    return None if days is None else T0 + dt.timedelta(days=days)


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda name, data: spark.createDataFrame(data, RAW_SCHEMAS[name])
    order = lambda k, status="delivered", approved=0.5, carrier=2.0, arrived=8.0, promised=10.0: (
        k, f"c{k}", status, T0, at(approved), at(carrier), at(arrived), at(promised))
    orders = [
        order("1"), order("2", arrived=10.04),          # less than 72 minutes late
        order("3", arrived=13.4), order("4", "shipped"),
        order("5", carrier=9.0, arrived=8.0),           # handed over after arrival
        order("6", carrier=None), order("7", carrier=-0.9), order("8", carrier=-1.1),
        order("9"), order("10"),
    ]
    reviews = [(f"r{k}", k, s, None, None, T0, at(12)) for k, s in
               [("1", 5), ("2", 4), ("3", 1), ("4", 5), ("5", 5), ("6", 5), ("7", 2), ("8", 2)]]
    reviews += [("r1b", "1", 1, None, None, T0, at(11)), ("r9", "9", None, None, None, T0, at(12))]
    customers = [(f"c{k}", f"u{k}", "100" if k != "3" else "999", "town", "SP")
                 for k in map(str, range(1, 11))]
    items = [("1", 1, "p1", "s1", T0, 100.0, 10.0), ("1", 2, "p2", "s2", T0, 0.0, 5.0),
             ("2", 1, "p1", "s3", T0, 50.0, 5.0), ("3", 1, "p3", "s1", T0, 20.0, 5.0),
             ("7", 1, "p1", "s1", T0, 10.0, 1.0), ("8", 1, "p1", "s1", T0, 10.0, 1.0)]
    return RawTables(
        customers=make("customers", customers),
        geolocation=make("geolocation", [
            ("100", -20.0, -40.0, "town", "SP"), ("100", -20.0, -40.0, "town", "SP"),
            ("100", -22.0, -42.0, "town", "SP"), ("200", -25.0, -45.0, "far", "PR")]),
        order_items=make("order_items", items),
        payments=make("payments", []),
        reviews=make("reviews", reviews),
        orders=make("orders", orders),
        products=make("products", [
            ("p1", "brinquedos", None, None, None, 100.0, 10.0, 10.0, 10.0),
            ("p2", "xx", None, None, None, None, None, None, None),
            ("p3", None, None, None, None, 300.0, 30.0, 30.0, 30.0)]),
        sellers=make("sellers", [("s1", "200", "far", "PR"), ("s2", "888", "far", "PR"),
                                 ("s3", "888", None, None)]),
        category=make("category", [("brinquedos", "toys")]),
    )


@pytest.fixture(scope="module")
def items(tables):
    return {(r["order_id"], r["order_item_id"]): r
            for r in prepare.analysis_items(tables).collect()}


def test_which_orders_remain(tables):
    kept = {r["order_id"] for r in prepare.clean_orders(tables.orders).collect()}
    assert kept == {"1", "2", "3", "7", "8", "9", "10"}
    # no review (10), missing score (9) and hand-over over a day early (8) go; 0.9 days stays
    assert {r["order_id"] for r in prepare.delivery_orders(tables).collect()} == {
        "1", "2", "3", "7"}


def test_grain_and_columns(items, tables):
    assert set(items) == {("1", 1), ("1", 2), ("2", 1), ("3", 1), ("7", 1)}
    assert prepare.analysis_items(tables).columns == prepare.FINAL_COLUMNS
    assert len(prepare.FINAL_COLUMNS) == 33


def test_days_and_delay(items):
    late = items["2", 1]
    assert (late["delay_days"], late["is_delayed"], late["delay_days_cat"]) == (0.0, 0, "정시")
    assert (items["3", 1]["delay_days"], items["3", 1]["delay_days_int"]) == (3.4, 3)
    assert items["3", 1]["delay_days_cat"] == "4-6일 지연"
    assert items["7", 1]["dispatch_days"] == 0
    assert items["1", 1]["order_purchase_dayofweek"] == "monday"
    assert items["1", 1]["review_score"] == 5


def test_centroid_drops_exact_duplicates_only(tables):
    row = prepare.zip_centroids(tables.geolocation).where(
        "geolocation_zip_code_prefix = '100'").first()
    assert (row["geolocation_lat"], row["geolocation_lng"]) == (-21.0, -41.0)


def test_filling(items):
    # unknown seller zip takes the mode of its city, so both items of order 1 are equally far
    assert items["1", 1]["distance_km"] == pytest.approx(items["1", 2]["distance_km"])
    # a seller without city or zip gets the median distance
    assert items["2", 1]["distance_km"] == pytest.approx(items["1", 1]["distance_km"])
    assert items["1", 2]["product_weight_g"] == 100.0
    assert items["2", 1]["cross_state"] == 1
    assert [items[k]["main_category"] for k in (("1", 1), ("1", 2), ("3", 1))] == [
        "Leisure & Kids", "Others", "Others"]


def test_restricted_columns_agree_with_the_full_table(tables, items):
    columns = ["order_id", "order_item_id", "delay_days", "seller_state", "main_category"]
    got = {(r["order_id"], r["order_item_id"]): tuple(r)
           for r in prepare.analysis_items(tables, columns).collect()}
    assert got == {k: tuple(r[c] for c in columns) for k, r in items.items()}


def test_lookups_behind_unused_columns_are_not_joined(tables):
    plan = prepare.analysis_items(tables, ["order_id", "price"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "seller_city" not in text and "product_category_name" not in text


def test_model_frames(tables):
    items = prepare.analysis_items(tables)
    frame = features.order_time_frame(items)
    assert frame.columns[3:] == features.ORDER_TIME_FEATURES and frame.count() == 5
    free = frame.where("order_id = '1' and order_item_id = 2").first()
    assert free["freight_ratio"] is None and free["total_price"] == 5.0
    after = features.after_delivery_frame(items)
    assert len(after.columns) == 2 + 33
    assert "seller_id" not in features.model_table(items).columns


def test_what_if_overrides_follow_through(tables):
    items = prepare.analysis_items(tables)
    moved = features.with_overrides(items, customer_state="PR", distance_km=10.0)
    row = moved.where("order_id = '1' and order_item_id = 1").first()
    assert (row["cross_state"], row["distance_cat"]) == (0, "Urban/Last-Mile")


def test_filling_points_by_city_shuffles_no_item_row(spark, sf_dir):
    """The cities are few; where only they fit the broadcast limit, item rows are not dealt by city."""
    from parcelsight.sources.adapter import raw_tables

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        rows = prepare.analysis_items(raw_tables(spark, sf_dir), ["order_id", "distance_km"])
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastHashJoin [customer_city" in plan and "BroadcastHashJoin [seller_city" in plan
