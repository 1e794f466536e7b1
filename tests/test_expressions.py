"""Bin edges, missing values, rounding and zero denominators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelsight.functions import bands, categories, expressions as X
from parcelsight.plans import features


def values(rows, data, schema, column):
    df = rows([(v,) for v in data], schema)
    return [r[0] for r in df.select(column).collect()]


def test_delay_band_edges(rows):
    days = [-0.1, -0.0, 0.0, 0.1, 3.0, 3.1, 6.0, 6.1, 9.0, 9.1, None]
    got = values(rows, days, "d double", bands.delay_band("d"))
    a, b, c, d, e, f = bands.DELAY_BANDS
    assert got == [a, b, b, c, c, d, d, e, e, f, None]


def test_threshold_and_split_use_the_tenth_of_a_day(rows):
    # 3.4 days late is "long" although its whole days are 3
    assert values(rows, [3.0, 3.4], "d double", bands.delayed_split("d")) == bands.DELAYED_SPLIT
    got = values(rows, [-1.0, 0.0, 3.0, 3.4, None], "d double", bands.threshold_band("d"))
    assert got == [*bands.THRESHOLD_BANDS, None]


def test_dispatch_and_distance_edges(rows):
    got = values(rows, [0, 1, 2, 3, 4, 5, 6, None], "d int", bands.dispatch_band("d"))
    a, b, c, d = bands.DISPATCH_BANDS
    assert got == [a, a, b, b, c, c, d, None]
    km = [0.0, 50.0, 50.1, 250.0, 750.0, 1500.0, 1500.1, None]
    assert values(rows, km, "d double", bands.distance_code("d")) == [0, 0, 1, 1, 2, 3, 4, None]


def test_rounding_is_half_even_and_never_negative_zero(rows):
    got = values(rows, [0.25, 0.75, -0.04, 0.05, 1.25], "d double", X.round_half_even("d", 1))
    assert got == [0.2, 0.8, 0.0, 0.0, 1.2]
    assert str(got[2]) == "0.0"


def test_truncation_is_toward_zero(rows):
    assert values(rows, [-1.9, -0.9, 0.9, 1.9, None], "d double", X.truncate("d")) == [
        -1, 0, 0, 1, None]


def test_safe_divide_and_finite(rows):
    df = rows([(1.0, 0.0), (1.0, 2.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(X.safe_divide("a", "b")).collect()] == [None, 0.5, None]
    inf = float("inf")
    assert values(rows, [inf, -inf, float("nan"), 2.0, None], "d double",
                  X.finite_or_null("d")) == [None, None, None, 2.0, None]


def test_negated_condition_keeps_unknown(rows):
    df = rows([(1, 2), (2, 1), (None, 1)], "a int, b int")
    kept = df.where(~X.holds(F.col("a") > F.col("b"))).collect()
    assert [(r.a, r.b) for r in kept] == [(1, 2), (None, 1)]


def test_flags_treat_missing_as_documented(rows):
    df = rows([("X", "X"), ("X", "Y"), (None, "X"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(X.differs_flag("a", "b")).collect()] == [0, 1, 1, 1]
    assert [r[0] for r in df.select(X.equals_flag("a", "X")).collect()] == [1, 1, 0, 0]


def test_weekday_names(rows):
    df = rows([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 7),)], "t timestamp")
    got = df.select(X.weekday_name("t").alias("d")).select("d", X.weekday_order("d")).collect()
    assert [tuple(r) for r in got] == [("monday", 1), ("sunday", 7)]


def test_haversine_quarter_of_the_equator(rows):
    df = rows([(0.0, 0.0, 0.0, 90.0), (10.0, 20.0, 10.0, 20.0)],
              "a double, b double, c double, d double")
    quarter, zero = [r[0] for r in df.select(X.haversine_km("a", "b", "c", "d")).collect()]
    assert quarter == pytest.approx(6371.0 * 3.141592653589793 / 2)
    assert zero == 0.0


def test_categories(rows):
    data = ["toys", "auto", "food_drink", "nothing_known", None]
    main = values(rows, data, "c string", categories.main_category("c"))
    sub = values(rows, data, "c string", categories.sub_category("c"))
    old = values(rows, data, "c string", categories.historical_group("c"))
    assert main == ["Leisure & Kids", "Others", "Others", "Others", "Others"]
    assert sub == ["Kids & Baby", "Automotive", "Food & Drink", "Others", "Others"]
    assert old == ["hobbies_leisure_kids", "automotivie_food", "automotivie_food", None, None]


def test_every_category_has_one_sub_category():
    subs = [c for members in categories.SUB_CATEGORIES.values() for c in members]
    assert sorted(subs) == categories.known_categories()
    assert len(subs) == len(set(subs))


def test_risk_levels_at_exact_limits(rows):
    high, caution, normal = bands.RISK_LEVELS
    got = values(rows, [0.471, 0.47, 0.351, 0.35, None], "p double", bands.risk_level("p"))
    assert got == [high, caution, caution, normal, None]


def test_action_lists(rows):
    df = rows([("고위험", 2.0), ("고위험", 0.0), ("주의", 2.0), ("일반", 0.0)],
              "level string, days double")
    lists = [r[0] for r in df.select(bands.action_list("level", "days")).collect()]
    assert [len(x) for x in lists] == [4, 3, 2, 1]
    assert lists[0][1] == bands.PROMISE_REVIEW_ACTION


def test_route_features(rows):
    df = rows([("SP", "SP"), ("SP", "RJ"), ("RJ", "SP"), ("RJ", None), (None, None)],
              "customer_state string, seller_state string")
    got = features.with_route_features(df).select(
        "sp_route_type", "sp_route_type_customer", "sp_route_type_seller").collect()
    assert [tuple(r) for r in got] == [(2, 2, 2), (1, 1, 0), (1, 0, 1), (0, 0, 0), (0, 0, 0)]


def test_clip_and_effect_labels(rows):
    assert values(rows, [0.2, 3.0, 9.0, None], "d double", X.clip("d", 1.0, 5.0)) == [
        1.0, 3.0, 5.0, None]
    got = values(rows, [0.05, -0.1, 0.3, -0.5], "d double", bands.effect_level("d"))
    assert got == bands.EFFECT_LEVELS
