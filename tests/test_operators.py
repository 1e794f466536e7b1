"""Operators against brute force on small inputs with ties, nulls and hot keys."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelsight.operators import (
    bootstrap, dedup, impute, metrics, ordering, quality, quantiles, rank_tests, rollup, splits)


@pytest.fixture(scope="module")
def skewed():
    """Values of which one makes up more than a third."""
    rng = random.Random(7)
    values = [5.0] * 1500 + [round(rng.gauss(0, 100), 3) for _ in range(2500)] + [None] * 40
    rng.shuffle(values)
    return values


def brute_midranks(values):
    ordered = sorted(v for v in values if v is not None)
    return {v: (ordered.index(v) + 1 + len(ordered) - ordered[::-1].index(v)) / 2
            for v in set(ordered)}


@pytest.mark.parametrize("bounded", [True, False])
def test_midranks(rows, skewed, bounded):
    df = rows([(v,) for v in skewed], "v double")
    got = {r["v"]: r for r in ordering.ranked_values(df, "v", bounded=bounded).collect()}
    want = brute_midranks(skewed)
    assert {v: r["midrank"] for v, r in got.items()} == want
    n = sum(v is not None for v in skewed)
    assert sum(r["midrank"] * r["n"] for r in got.values()) == n * (n + 1) / 2
    assert {r["total"] for r in got.values()} == {n}


def test_grouped_midranks_and_quantiles(rows, skewed):
    data = [("hot" if i % 3 else "cold", v) for i, v in enumerate(skewed)]
    df = rows(data, "g string, v double")
    quant = {r["g"]: r for r in quantiles.exact_quantiles(
        df, ["v"], [0.0, 0.05, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in ("hot", "cold"):
        mine = [v for k, v in data if k == g and v is not None]
        want = np.percentile(mine, [0, 5, 50, 95, 100])
        assert [quant[g][f"q_{i}"] for i in range(5)] == pytest.approx(list(want))
        assert quant[g]["n"] == len(mine)


def test_quantiles_of_constant_short_and_empty_columns(rows):
    df = rows([(1.0, 7.0, None), (2.0, 7.0, None)], "a double, b double, c double")
    got = {r["column"]: r["q_0"] for r in quantiles.exact_quantiles(
        df, ["a", "b", "c"], [0.5]).collect()}
    assert got == {"a": 1.5, "b": 7.0}
    assert quantiles.medians(df, ["a", "c"]).first().asDict() == {"a": 1.5, "c": None}


def test_numbered_rows_are_a_permutation(rows):
    df = rows([(i, i % 7 == 0) for i in range(3000)], "k bigint, g boolean")
    out = ordering.numbered_rows(df, ["g"], splits.mixed_key("k"), [F.col("k")]).collect()
    for g in (True, False):
        numbers = sorted(r["row_number"] for r in out if r["g"] is g)
        assert numbers == list(range(1, len(numbers) + 1))


def test_histogram_matches_numpy(rows):
    values = [0, 1, 1, 2, 9, 10, 10, 4]
    df = rows([(v,) for v in values], "v int")
    got = quantiles.histogram(df, "v", 5).collect()
    counts, edges = np.histogram(values, 5)
    assert [r["n"] for r in got] == list(counts)
    assert [r["left_edge"] for r in got] == pytest.approx(list(edges[:-1]))
    single = quantiles.histogram(rows([(3,), (3,)], "v int"), "v", 4).collect()
    assert [r["n"] for r in single] == [0, 0, 2, 0]


def test_box_statistics(rows):
    values = [1, 2, 3, 4, 5, 100]
    row = quantiles.box_statistics(rows([(0, v) for v in values], "g int, v int"), "v", "g").first()
    q1, med, q3 = np.percentile(values, [25, 50, 75])
    assert (row["q1"], row["median"], row["q3"]) == (q1, med, q3)
    assert (row["whisker_low"], row["whisker_high"], row["n_outliers"]) == (1.0, 5.0, 1)


def test_quantile_cuts(rows):
    df = rows([(i,) for i in range(101)], "v int")
    assert quantiles.quantile_cut(df, "v", 0.95).count() == 96
    assert quantiles.quantile_cut(df, "v", 0.95, strict=True).count() == 95
    assert quantiles.quantile_cut(df, "v", 0.95, lower=0.05).count() == 91
    assert quantiles.quantile_cut(df, "v", 0.5, scope=F.col("v") > 50).count() == 25


def test_latest_review_prefers_missing_time_then_highest_id(rows):
    day = lambda d: dt.datetime(2024, 1, d)
    df = rows([
        (1, "a", 5, day(1)), (2, "a", 4, day(3)), (3, "a", 3, day(2)),
        (4, "b", 1, day(9)), (5, "b", 2, None),
        (6, "c", 1, day(1)), (7, "c", 2, day(1)),
    ], "review_id int, order_id string, review_score int, review_answer_timestamp timestamp")
    got = {r["order_id"]: r["review_id"] for r in dedup.latest_reviews(df).collect()}
    assert got == {"a": 2, "b": 5, "c": 7}


def test_best_row_with_a_hot_key(rows):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}", rng.randrange(1000), i)
            for i in range(2000)]
    got = {r["k"]: (r["v"], r["i"]) for r in dedup.best_row(
        rows(data, "k string, v int, i int"), "k", [-F.col("v"), F.col("i")]).collect()}
    want = {}
    for k, v, i in data:
        if k not in want or (-v, i) < (-want[k][0], want[k][1]):
            want[k] = (v, i)
    assert got == want


def test_modes_break_ties_low_and_skip_missing(rows):
    df = rows([("a", 2), ("a", 1), ("a", None), ("a", None), ("a", None), ("b", None), ("c", 3)],
              "g string, v int")
    got = {r["g"]: r["v"] for r in impute.modes(df, ["g"], "v").collect()}
    assert got == {"a": 1, "c": 3}


def test_city_fill_leaves_unknown_cities_missing(rows):
    df = rows([
        ("x", 1.0, 2.0), ("x", 1.0, 3.0), ("x", None, None), (None, None, None), ("y", None, None),
    ], "seller_city string, seller_lat double, seller_lng double")
    filled = impute.fill_points_by_city(df, ["seller"], impute.city_point_modes(df, ["seller"]))
    got = sorted(((r["seller_city"], r["seller_lat"], r["seller_lng"]) for r in filled.collect()),
                 key=str)
    assert got == sorted([("x", 1.0, 2.0), ("x", 1.0, 3.0), ("x", 1.0, 2.0), (None, None, None),
                          ("y", None, None)], key=str)


def test_duplicates_and_nulls(rows):
    df = rows([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "c")], "k int, v string")
    row = quality.duplicate_counts(df, ["k", "v"]).first()
    assert (row["surplus_rows"], row["member_rows"]) == (3, 5)
    profile = [tuple(r) for r in quality.null_profile(df).collect()]
    assert profile == [("v", 3, 50.0)]


def test_mann_whitney_against_pairs(rows):
    rng = random.Random(3)
    a = [rng.randrange(1, 6) for _ in range(60)]
    b = [rng.randrange(2, 6) for _ in range(80)]
    df = rows([(1, v) for v in a] + [(0, v) for v in b], "g int, v int")
    for bounded in (True, False):
        row = rank_tests.mann_whitney(df, "v", "g", 1, 0, bounded).first()
        u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert row["u1"] == u
        assert row["u1"] + row["u2"] == row["n1"] * row["n2"] == 60 * 80
        assert row["rank_biserial_r"] == pytest.approx(2 * u / 4800 - 1)


def test_mann_whitney_all_tied(rows):
    df = rows([(1, 3), (1, 3), (0, 3)], "g int, v int")
    result = rank_tests.mann_whitney(df, "v", "g", 1, 0)
    assert result.first()["rank_biserial_r"] == 0.0
    assert rank_tests.mann_whitney_p(result) == 1.0


def test_kruskal_of_two_groups_is_z_squared(rows):
    df = rows([(1, v) for v in (1, 2, 2, 5, 7)] + [(0, v) for v in (3, 5, 8, 9)], "g int, v int")
    h = rank_tests.kruskal_wallis(df, "v", "g").first()["h"]
    row = rank_tests.mann_whitney(df, "v", "g", 1, 0).first()
    # z without continuity correction
    z = row["z_abs"] * abs(row["u1"] - 10) / (abs(row["u1"] - 10) - 0.5)
    assert h == pytest.approx(z * z)


def test_spearman_and_pearson_against_numpy(rows):
    rng = random.Random(5)
    data = [(rng.randrange(10), rng.randrange(5), rng.randrange(3)) for _ in range(300)]
    df = rows([*data, (None, 1, 1)], "a int, b int, c int")
    got = {(r["left"], r["right"]): r["rho"]
           for r in rank_tests.spearman_matrix(df, ["a", "b", "c"]).collect()}
    columns = list(zip(*data))
    ranked = [[brute_midranks(c)[v] for v in c] for c in columns]
    want = np.corrcoef(ranked)
    plain = np.corrcoef(columns)
    pearson = {(r["left"], r["right"]): r["corr"]
               for r in rank_tests.pearson_matrix(df, ["a", "b", "c"]).collect()}
    for i, x in enumerate("abc"):
        for j, y in enumerate("abc"):
            assert got[x, y] == pytest.approx(want[i][j])
            assert pearson[x, y] == pytest.approx(plain[i][j])


def test_welch(rows):
    a, b = [1.0, 2.0, 4.0, 7.0], [2.0, 9.0, 9.0]
    result = rank_tests.welch_t(rows([(1, v) for v in a] + [(0, v) for v in b],
                                     "g int, v double"), "v", "g", 1, 0)
    va, vb = statistics.variance(a) / 4, statistics.variance(b) / 3
    assert result.first()["t"] == pytest.approx(
        (statistics.mean(a) - statistics.mean(b)) / (va + vb) ** 0.5)
    assert 0 < rank_tests.welch_p(result) < 1


def test_threshold_sweep_against_loops(rows):
    rng = random.Random(11)
    data = [(rng.choice([0.29, 0.57, 0.58, 1.0, 0.0, rng.random()]), rng.randrange(2))
            for _ in range(400)]
    sweep = metrics.threshold_sweep(rows(data, "p double, y int"), "p", "y").collect()
    assert len(sweep) == 81
    for row in sweep:
        t = row["threshold"]
        want = [sum(1 for p, y in data if (p >= t) == said and y == is_yes)
                for said, is_yes in ((False, 0), (True, 0), (False, 1), (True, 1))]
        assert [row["tn"], row["fp"], row["fn"], row["tp"]] == want
    ones = [r["tp"] for r in sweep]
    zeros = [r["neg_recall"] for r in sweep]
    assert ones == sorted(ones, reverse=True) and zeros == sorted(zeros)


def test_balanced_threshold_takes_the_first_of_equals(rows):
    df = rows([(0.2, 0.5, 0.4), (0.3, 0.6, 0.5), (0.4, 0.9, 0.1)],
              "threshold double, neg_recall double, balanced_acc double")
    assert metrics.balanced_threshold(df).first()["threshold"] == 0.2


def test_metrics_of_a_single_class(rows):
    counts = metrics.confusion(rows([(0.9, 1), (0.1, 1)], "p double, y int"), "p", "y", 0.5)
    row = metrics.with_scores(counts).first()
    assert (row["neg_recall"], row["accuracy"]) == (0.0, 0.5)


def test_splits_and_folds(rows):
    df = rows([(f"o{i // 3}", i % 2) for i in range(3000)], "order_id string, label int")
    split = splits.with_split(df)
    assert splits.split_overlap(split).first()["overlapping_orders"] == 0
    shares = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert shares["test"] == pytest.approx(600, abs=120)
    folds = splits.stratified_folds(df, "label").groupBy("stratum", "fold").count().collect()
    for stratum in {r["stratum"] for r in folds}:
        sizes = [r["count"] for r in folds if r["stratum"] == stratum]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_class_weights(rows):
    df = rows([(1,)] * 6 + [(0,)] * 2, "label int")
    assert {r["label"]: r["weight"] for r in splits.class_weights(df).collect()} == {
        1: pytest.approx(8 / 12), 0: 2.0}
    weighted = splits.with_class_weight(df).groupBy("label").agg(F.sum("weight")).collect()
    assert {r[1] for r in weighted} == {4.0}


def test_item_values_of_any_order(rows):
    data = [("a", i % 7) for i in range(500)] + [("b", 3), ("b", None)]
    items = rows(data, "order_id string, v int")
    values = {(r["order_id"], r["v"]): r["repeats"] for r in rollup.item_values(items, "v").collect()}
    assert sum(values.values()) == 502 and values["b", None] == 1 and values["a", 0] == 72
    arrays = {r["order_id"]: r["v"] for r in rollup.item_arrays(items, "v").collect()}
    assert arrays["a"] == sorted(i % 7 for i in range(500))


def test_tests_on_degenerate_data(rows):
    one = rows([("g", 1.0)], "g string, v double")
    flat = rows([("g", 1.0), ("g", 1.0), ("h", 1.0), ("h", 1.0)], "g string, v double")
    assert rank_tests.kruskal_wallis_p(rank_tests.kruskal_wallis(one, "v", "g")) is None
    assert rank_tests.kruskal_wallis_p(rank_tests.kruskal_wallis(flat, "v", "g")) is None
    assert rank_tests.welch_p(rank_tests.welch_t(flat, "v", "g", "g", "h")) is None
    assert rank_tests.welch_p(rank_tests.welch_t(one, "v", "g", "g", "h")) is None
    assert rank_tests.spearman_p(None, 10) is None and rank_tests.spearman_p(0.5, 2) is None


def test_duplicate_members_with_missing_keys(rows):
    df = rows([(None, 1), (None, 2), ("x", 3), ("x", 4), ("y", 5)], "k string, v int")
    assert sorted(r["v"] for r in quality.duplicate_members(df, ["k"]).collect()) == [1, 2, 3, 4]
    assert quality.duplicate_counts(df, ["k"]).first()["member_rows"] == 4


def test_class_weight_leaves_missing_labels_out(rows):
    df = splits.with_class_weight(rows([(1,), (None,), (1,)], "label int"))
    assert [(r["label"], r["weight"]) for r in df.collect()] == [(1, 0.5), (1, 0.5)]

def test_fan_out_counts_what_the_joins_would(rows):
    base = rows([("a",), ("b",), ("c",)], "k string")
    first = rows([("a",), ("a",), ("b",)], "k string")
    second = rows([("a",), ("a",), ("a",), ("c",)], "k string")
    got = [r["rows"] for r in quality.fan_out(base, [("x", first), ("y", second)], "k").collect()]
    one = base.join(first, "k", "left")
    assert got == [3, one.count(), one.join(second, "k", "left").count()]


@pytest.mark.parametrize("bounded", [True, False])
def test_normal_scores(rows, skewed, bounded):
    rng = random.Random(3)
    data = [("a", v) for v in skewed] + [("b", rng.gauss(5, 2)) for _ in range(300)] + [("c", 1.0)] * 9 + [(None, 3.0)] * 4
    got = {r["g"]: r for r in rank_tests.normal_scores(rows(data, "g string, v double"), "v", ["g"], bounded).collect()}
    for g in ("a", "b"):
        mine = [v for k, v in data if k == g and v is not None]
        ranks = brute_midranks(mine)
        scores = [statistics.NormalDist().inv_cdf((ranks[v] - 0.375) / (len(mine) + 0.25)) for v in mine]
        assert got[g]["n"] == len(mine)
        assert got[g]["w"] == pytest.approx(np.corrcoef(mine, scores)[0, 1] ** 2, abs=1e-12)
    assert got["b"]["p_value"] > 0.01 > got["a"]["p_value"]
    assert (got["c"]["w"], got["c"]["p_value"]) == (None, None)
    assert set(got) == {"a", "b", "c"}
    whole = rank_tests.normal_scores(rows([(v,) for v in skewed], "v double"), "v", bounded=bounded).first()
    assert whole["w"] == pytest.approx(got["a"]["w"], abs=1e-12)
    assert rank_tests.normal_scores(rows([], "g string, v double"), "v", ["g"], bounded).collect() == []


def test_normal_scores_p_is_uniform_under_normality(rows):
    rng = random.Random(11)
    data = [(g, rng.gauss(0, 1)) for g in range(400) for _ in range(40)]
    ps = [r["p_value"] for r in rank_tests.normal_scores(rows(data, "g int, v double"), "v", ["g"], bounded=True).collect()]
    for level in (0.05, 0.25, 0.5, 0.75):
        assert sum(p <= level for p in ps) / len(ps) == pytest.approx(level, abs=4 * (level * (1 - level) / 400) ** 0.5)


def test_exact_mann_whitney(rows):
    data = [("a", v) for v in (1.1, 2.2, 3.3)] + [("b", v) for v in (4.4, 5.5, 6.6, 7.7)]
    row = rank_tests.mann_whitney(rows(data, "g string, v double"), "v", "g", "b", "a", exact_up_to=8).first()
    assert (row["p_method"], row["u1"]) == ("exact", 12.0)
    assert (row["p_two_sided"], row["p_greater"]) == (pytest.approx(2 / 35), pytest.approx(1 / 35))
    usual = rank_tests.mann_whitney(rows(data, "g string, v double"), "v", "g", "b", "a")
    assert "p_method" not in usual.columns and usual.first()["p_two_sided"] != pytest.approx(2 / 35)
    tied = rank_tests.mann_whitney(rows(data + [("a", 4.4)], "g string, v double"), "v", "g", "b", "a", exact_up_to=8).first()
    large = rank_tests.mann_whitney(rows(data, "g string, v double"), "v", "g", "b", "a", exact_up_to=3).first()
    empty = rank_tests.mann_whitney(rows(data, "g string, v double"), "v", "g", "b", "z", exact_up_to=8).first()
    assert [r["p_method"] for r in (tied, large, empty)] == ["normal"] * 3
    assert empty["p_two_sided"] == 1.0
    with pytest.raises(ValueError):
        rank_tests.mann_whitney(rows(data, "g string, v double"), "v", "g", "b", "a", exact_up_to=26)


def test_bootstrap_interval(rows):
    rng = random.Random(5)
    data = [("hot", rng.randrange(1, 6)) for _ in range(3000)] + [("cold", rng.randrange(1, 6)) for _ in range(60)]
    data += [("one", 4), (None, 3), ("cold", None)]
    df = rows(data, "g string, v int")
    read = lambda d: {r["g"]: r for r in bootstrap.mean_interval(d, ["g"], "v", replicates=400).collect()}
    got = read(df)
    assert got == read(df.repartition(7, "v")) == read(df.coalesce(1))
    assert set(got) == {"hot", "cold", "one"}
    for g in ("hot", "cold"):
        mine = [v for k, v in data if k == g and v is not None]
        half = 1.96 * statistics.stdev(mine) / len(mine) ** 0.5
        assert (got[g]["n"], got[g]["mean"]) == (len(mine), pytest.approx(statistics.mean(mine)))
        assert got[g]["ci_low"] == pytest.approx(got[g]["mean"] - half, abs=half / 4)
        assert got[g]["ci_high"] == pytest.approx(got[g]["mean"] + half, abs=half / 4)
    assert (got["one"]["ci_low"], got["one"]["ci_high"]) == (4.0, 4.0)
    assert bootstrap.mean_interval(rows([], "g string, v int"), ["g"], "v").collect() == []
    with pytest.raises(ValueError):
        bootstrap.mean_interval(df, [], "v")


def test_bootstrap_of_a_continuous_column(rows):
    rng = random.Random(6)
    values = [rng.gauss(100, 15) for _ in range(500)]
    row = bootstrap.mean_interval(rows([(1, v) for v in values], "g int, v double"), ["g"], "v", replicates=300, seed=2).first()
    half = 1.96 * statistics.stdev(values) / len(values) ** 0.5
    assert (row["ci_high"] - row["ci_low"]) / 2 == pytest.approx(half, rel=0.2)


def test_quantiles_tell_only_values_near_their_positions_apart(spark, monkeypatch):
    """Values far from every wanted position are counted, not grouped one by one."""
    df = spark.range(200_000).select(
        (F.col("id") * 7919 % 200_000 / 2).alias("v"), (F.col("id") % 3).cast("double").alias("few"),
        F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 8 == 0, float("nan")).otherwise(
            F.when(F.col("id") % 8 == 2, float("inf")).otherwise(F.col("id") * -1.0))).alias("odd"))
    rows, real = [], quantiles.running_total
    monkeypatch.setattr(quantiles, "running_total", lambda counts, *a: rows.append(counts.count()) or real(counts, *a))
    got = {r["column"]: r for r in quantiles.exact_quantiles(df, ["v", "few", "odd"], [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert rows[0] < 3_000
    want = np.percentile(np.arange(200_000) / 2, [0, 25, 50, 90, 100])
    assert [got["v"][f"q_{i}"] for i in range(5)] == pytest.approx(list(want))
    assert [got["few"][f"q_{i}"] for i in range(5)] == [0.0, 0.0, 1.0, 2.0, 2.0]
    # a half finite, a quarter infinite, a quarter NaN, which comes last
    assert got["odd"]["n"] == 100_000 and got["odd"]["q_1"] == pytest.approx(-100_000, abs=20)
    assert got["odd"]["q_3"] != got["odd"]["q_3"] and got["odd"]["q_4"] != got["odd"]["q_4"]
