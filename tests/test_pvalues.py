"""Tail functions against table values."""

import itertools
import math
import statistics

import pytest
from pyspark.sql import functions as F

from parcelsight.functions import draws, pvalues, tails


def test_normal():
    assert pvalues.normal_sf(1.959963984540054) == pytest.approx(0.025)
    assert pvalues.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert pvalues.normal_ppf(0.5) == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("x, df, p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (11.070497693516351, 5, 0.05),
    (18.307038053275146, 10, 0.05), (0.0, 3, 1.0)])
def test_chi_square(x, df, p):
    assert pvalues.chi2_sf(x, df) == pytest.approx(p)


@pytest.mark.parametrize("t, df, p", [
    (2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05), (2.0, 1e9, 0.04550026),
    (0.0, 5, 1.0)])
def test_student(t, df, p):
    assert pvalues.student_two_sided(t, df) == pytest.approx(p, rel=1e-5)


def test_published_effect_size_identity():
    # U and group sizes of a published 1-3 days against 4+ days comparison
    assert 2 * 6621470 / (2086 * 3983) - 1 == pytest.approx(0.5938953399503017)


def first(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_normal_columns(spark):
    zs = [-9.0, -1.96, -0.3, 0.0, 0.2, 0.6, 1.0, 1.959963984540054, 4.0, 6.0, 9.0, 20.0, 37.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", tails.normal_tail("z").alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-11), r["z"]
    # published values
    assert first(spark, tails.normal_tail(F.lit(1.644853626951472)), tails.normal_tail(F.lit(5.0))) == pytest.approx(
        (0.05, 2.866515718791939e-07), rel=1e-11)
    assert first(spark, tails.normal_tail(F.lit(None).cast("double"))) == (None,)


@pytest.mark.parametrize("x, df, p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (11.070497693516351, 5, 0.05),
    (18.307038053275146, 10, 0.05), (124.3421134, 100, 0.05), (0.0, 3, 1.0), (0.5, 4, 0.9735009788392561),
    (300.0, 2, 7.175095973164411e-66)])
def test_chi_square_column(spark, x, df, p):
    got = first(spark, tails.chi_square_tail(F.lit(x), F.lit(df)))[0]
    assert got == pytest.approx(p, rel=1e-8)
    assert got == pytest.approx(pvalues.chi2_sf(x, df), rel=1e-9)


@pytest.mark.parametrize("t, df, p", [
    (2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05), (1.9719565442517553, 199, 0.05),
    (1.971896223516, 200, 0.05), (1.9623390808264078, 1000, 0.05), (-3.2905267314918945, 1e9, 0.001), (0.0, 5, 1.0),
    (0.1, 3, 1 - 2 / math.pi * (math.atan(0.1 / 3**0.5) + 0.1 * 3**0.5 / 3.01)), (1.0, 1, 0.5)])
def test_student_column(spark, t, df, p):
    got = first(spark, tails.student_two_sided(F.lit(t), F.lit(df)))[0]
    assert got == pytest.approx(p, rel=1e-7)
    if df < 1e6:
        assert got == pytest.approx(pvalues.student_two_sided(t, df), rel=1e-9)


def test_kolmogorov_column(spark):
    # published critical values of the limiting distribution
    got = first(spark, *(tails.kolmogorov_tail(F.lit(x)) for x in (1.3580986393225507, 1.6276236115189502, 0.1, 9.0)))
    assert got == pytest.approx((0.05, 0.01, 1.0, 0.0), rel=1e-9, abs=1e-15)


def test_normal_quantile_column(spark):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.025, 0.0749, 0.0751, 0.3, 0.5, 0.8, 0.9249, 0.9251, 0.975, 0.999999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", tails.normal_quantile("p").alias("z")).collect()
    for r in rows:
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-14), r["p"]
    outside = spark.createDataFrame([(p,) for p in (0.0, 1.0, -0.5, 2.0, None)], "p double").select(tails.normal_quantile("p"))
    assert [r[0] for r in outside.collect()] == [None] * 5


@pytest.mark.parametrize("n1, n2", [(1, 1), (1, 6), (3, 3), (4, 7), (8, 8)])
def test_exact_rank_sum_tail(spark, n1, n2):
    """Every choice of ranks for the first group."""
    sums = [sum(c) - n1 * (n1 + 1) // 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    rows = spark.range(n1 * n2 + 2).select("id", tails.rank_sum_tail(F.col("id"), F.lit(n1), F.lit(n2)).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(sum(s >= r["id"] for s in sums) / len(sums), abs=1e-13), r["id"]


def test_exact_rank_sum_tail_against_published_tables(spark):
    # two-sided 5% critical values of U: 2 for 5 and 5, 8 for 7 and 7, 13 for 8 and 8, 127 for 20 and 20
    for n, critical in ((5, 2), (7, 8), (8, 13), (20, 127)):
        at, beyond = first(spark, *(tails.rank_sum_tail(F.lit(n * n - u), F.lit(n), F.lit(n)) for u in (critical, critical + 1)))
        assert 2 * at <= 0.05 < 2 * beyond
    assert first(spark, tails.rank_sum_tail(F.lit(9), F.lit(3), F.lit(3)))[0] == pytest.approx(0.05)
    assert first(spark, tails.rank_sum_tail(F.lit(313), F.lit(25), F.lit(25)))[0] == pytest.approx(0.5, abs=0.01)
    assert first(spark, tails.rank_sum_tail(F.lit(0), F.lit(0), F.lit(5))) == (None,)


def test_poisson_quantile_column(spark):
    def brute(u, mean):
        k, upto = 0, math.exp(-mean)
        while u > upto:
            k += 1
            upto += math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1))
        return k

    cases = [(u, m) for u in (1e-12, 0.001, 0.2, 0.3679, 0.5, 0.7358, 0.97, 1 - 1e-9) for m in (1.0, 2.0, 7.0, 50.0, 51.0, 400.0)]
    rows = spark.createDataFrame(cases, "u double, m double").select("u", "m", draws.poisson("u", "m").alias("k")).collect()
    for r in rows:
        assert abs(r["k"] - brute(r["u"], r["m"])) <= (0 if r["m"] <= draws.COUNTED_MEAN else 1), r
    assert first(spark, draws.poisson(F.lit(0.5), F.lit(0))) == (0.0,)


def test_uniform_draws(spark):
    got = [r["u"] for r in spark.range(4000).select(draws.uniform(F.lit(3), "id").alias("u")).collect()]
    assert 0 < min(got) and max(got) < 1 and len(set(got)) == 4000
    assert statistics.mean(got) == pytest.approx(0.5, abs=0.02)
    assert statistics.pvariance(got) == pytest.approx(1 / 12, abs=0.005)
