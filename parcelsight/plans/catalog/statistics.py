"""Registered queries: rank tests, correlations, moments."""

from pyspark.sql import functions as F

from parcelsight.functions import bands
from parcelsight.operators import rank_tests
from parcelsight.plans import hypothesis, reports
from parcelsight.plans.catalog.oracle import NORMAL_GRID, normal_quantile
from parcelsight.plans.catalog.registry import Inputs, register

# Simpson's rule over 12 units beyond z; the tail further out is below 1e-32.
def _normal_tail(z: str) -> str:
    return f"""(SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-power(({z}) + i * 0.003, 2) / 2)) * 0.001 / sqrt(2 * pi()) FROM range(4001) AS s(i))"""


# The same over Student's density.
def _student(t: str, df: str) -> str:
    return f"""(SELECT 2 * sum(CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * power(1 + power(abs({t}) + i * 0.005, 2) / ({df}), -(({df}) + 1) / 2)) * 0.005 / 3
    * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi()) FROM range(8001) AS s(i))"""


# Midranks by counting, pooled over two groups.
_MWU = """
, s AS (SELECT {value} AS v, {group} AS g FROM {source}),
f AS (SELECT v, count(*) AS t, count(*) FILTER (WHERE g = {first}) AS a FROM s GROUP BY 1),
r AS (SELECT *, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0::DOUBLE AS mid FROM f),
b AS (SELECT sum(a)::DOUBLE AS n1, sum(t - a)::DOUBLE AS n2, sum(a * mid) AS r1,
  sum(t::DOUBLE * t * t - t) AS ties FROM r),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1,
  sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM b)
SELECT n1::BIGINT AS n1, n2::BIGINT AS n2, u1, n1 * n2 - u1 AS u2,
  round(greatest(abs(u1 - n1 * n2 / 2) - 0.5, 0) / sd, 6) AS z_abs,
  round((u1 - n1 * n2 / 2 - 0.5) / sd, 6) AS z_greater,
  round(2 * u1 / (n1 * n2) - 1, 6) AS rank_biserial_r, round(u1 / (n1 * n2), 6) AS cles,
  round(least(2 * """ + _normal_tail("greatest(abs(u1 - n1 * n2 / 2) - 0.5, 0) / sd") + """, 1), 6) AS p_two_sided,
  round(""" + _normal_tail("(u1 - n1 * n2 / 2 - 0.5) / sd") + """, 6) AS p_greater FROM u"""


@register("k2_k3_scores_of_delayed_orders", _MWU.format(
    value="review_score", group="is_delayed", source="final_orders", first=1))
def _(q: Inputs):
    return rank_tests.mann_whitney(q.orders, "review_score", "is_delayed", 1, 0, bounded=True)


@register("k2_k3_dispatch_of_delayed_items", _MWU.format(
    value="dispatch_days", group="is_delayed", source="sale_items", first=1))
def _(q: Inputs):
    return rank_tests.mann_whitney(q.items("dispatch_days", "is_delayed"), "dispatch_days",
                                   "is_delayed", 1, 0)


@register("k2_continuous_price_of_delayed_items", _MWU.format(
    value="price", group="is_delayed", first=1,
    source="(SELECT * FROM sale_items WHERE price IS NOT NULL)"))
def _(q: Inputs):
    return rank_tests.mann_whitney(q.items("price", "is_delayed"), "price", "is_delayed", 1, 0,
                                   bounded=False)


@register("k4_kruskal_wallis_speed_groups", """
, m AS (SELECT quantile_cont(delivery_days, 0.5) AS m FROM sale_items WHERE delay_days <= 0),
g AS (SELECT CASE WHEN delay_days > 0 THEN 'delayed' WHEN delivery_days <= m THEN 'ontime_fast'
  ELSE 'ontime_slow' END AS g, review_score AS v FROM sale_items, m),
f AS (SELECT v, count(*)::DOUBLE AS t FROM g GROUP BY 1),
r AS (SELECT *, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2 AS mid FROM f),
p AS (SELECT g, count(*)::DOUBLE AS n, sum(mid) AS s FROM g JOIN r USING (v) GROUP BY 1),
n AS (SELECT sum(n) AS n, count(*) AS k, sum(s * s / n) AS q FROM p)
SELECT k AS groups, n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1))
  / (1 - (SELECT sum(t * t * t - t) FROM f) / (n * n * n - n)), 6) AS h,
  round(exp(-(12 / (n * (n + 1)) * q - 3 * (n + 1))
  / (1 - (SELECT sum(t * t * t - t) FROM f) / (n * n * n - n)) / 2), 6) AS p_value FROM n""")
def _(q: Inputs):
    grouped = reports.with_speed_group(q.items("delay_days", "delivery_days", "review_score"))
    return rank_tests.kruskal_wallis(grouped, "review_score", "speed_group", bounded=True)


_LOGISTICS = ["delivery_days", "dispatch_days", "approved_days", "expected_delivery_days",
              "delay_days", "review_score"]
_RANKED = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 "
                    f"AS {c}" for c in _LOGISTICS)


def _pairs(columns, source, name):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, "
        f"round(corr({a}, {b}), 6) AS {name} FROM {source}" for a in columns for b in columns)


@register("k5_spearman_matrix", f"""
, r AS (SELECT {_RANKED} FROM sale_items),
c AS ({_pairs(_LOGISTICS, 'r', 'rho').replace("round(corr(", "(corr(").replace("), 6) AS", ")) AS")})
SELECT "left", "right", n, round(rho, 6) AS rho, CASE WHEN "left" = "right" THEN 0.0
  ELSE round({_student('rho * sqrt((n - 2) / (1 - rho * rho))', 'n - 2')}, 6) END AS p_value FROM c""")
def _(q: Inputs):
    return rank_tests.spearman_matrix(q.items(*_LOGISTICS), _LOGISTICS)


@register("k6_pearson_matrix", _pairs(_LOGISTICS, "sale_items", "corr"))
def _(q: Inputs):
    return rank_tests.pearson_matrix(q.items(*_LOGISTICS), _LOGISTICS)


@register("k7_welch_t", """
, s AS (SELECT count(*) FILTER (WHERE is_delayed = 1) AS n1,
    count(*) FILTER (WHERE is_delayed = 0) AS n2,
    avg(review_score) FILTER (WHERE is_delayed = 1) AS mean1,
    avg(review_score) FILTER (WHERE is_delayed = 0) AS mean2,
    var_samp(review_score) FILTER (WHERE is_delayed = 1) AS v1,
    var_samp(review_score) FILTER (WHERE is_delayed = 0) AS v2 FROM final_orders)
SELECT n1, n2, round(mean1, 6) AS mean1, round(mean2, 6) AS mean2,
  round((mean1 - mean2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round(pow(v1 / n1 + v2 / n2, 2)
    / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) AS df,
  round(""" + _student("(mean1 - mean2) / sqrt(v1 / n1 + v2 / n2)", """pow(v1 / n1 + v2 / n2, 2)
    / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))""") + """, 6) AS p_value FROM s""")
def _(q: Inputs):
    return rank_tests.welch_t(q.orders, "review_score", "is_delayed", 1, 0).withColumn(
        "df", F.round("df", 4))


@register("k8_jarque_bera", """
, m AS (SELECT is_delayed, avg(review_score) AS a FROM final_orders GROUP BY 1),
c AS (SELECT is_delayed, count(*) AS n, avg(pow(review_score - a, 2)) AS m2,
  avg(pow(review_score - a, 3)) AS m3, avg(pow(review_score - a, 4)) AS m4
  FROM final_orders JOIN m USING (is_delayed) GROUP BY 1)
SELECT is_delayed, n, round(m3 / pow(m2, 1.5), 6) AS skewness,
  round(m4 / (m2 * m2) - 3, 6) AS kurtosis,
  round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jb
FROM c""")
def _(q: Inputs):
    return rank_tests.jarque_bera(q.orders, "review_score", "is_delayed").withColumn(
        "jb", F.round("jb", 4))


# Standard normal quantiles of 0.05, 0.10 to 0.95.
_NORMAL = [-1.644854, -1.281552, -1.036433, -0.841621, -0.67449, -0.524401, -0.38532, -0.253347, -0.125661,
           0.0, 0.125661, 0.253347, 0.38532, 0.524401, 0.67449, 0.841621, 1.036433, 1.281552, 1.644854]
_POINTS = ", ".join(str(i / 20) for i in range(1, 20))


@register("k9_normal_quantile_points", f"""
, s AS (SELECT is_delayed, quantile_cont(delivery_days::DOUBLE, [{_POINTS}]) AS q FROM final_orders
  WHERE is_delayed IS NOT NULL GROUP BY 1),
u AS (SELECT is_delayed, unnest([{_POINTS}]::DOUBLE[]) AS p, unnest({_NORMAL}::DOUBLE[]) AS normal,
  unnest(q) AS sample FROM s)
SELECT is_delayed, p, normal, round(sample, 6) AS sample FROM u""")
def _(q: Inputs):
    return rank_tests.normal_quantile_points(q.orders, "delivery_days", "is_delayed")


_THRESHOLD = """
, s AS (SELECT review_score AS v, delay_days <= 3 AS short FROM final_orders
  WHERE delay_days > 0),
f AS (SELECT v, count(*) AS t, count(*) FILTER (WHERE short) AS a FROM s GROUP BY 1),
r AS (SELECT *, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0::DOUBLE AS mid FROM f),
b AS (SELECT sum(a)::DOUBLE AS n1, sum(t - a)::DOUBLE AS n2, sum(a * mid) AS r1,
  sum(t::DOUBLE * t * t - t) AS ties FROM r),
u AS (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u1,
  sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS sd FROM b),
z AS (SELECT u1, greatest(abs(u1 - n1 * n2 / 2) - 0.5, 0) / sd AS z_abs,
  2 * u1 / (n1 * n2) - 1 AS r FROM u),
g AS (SELECT CASE WHEN short THEN '1-3일 지연' ELSE '4일 이상 지연' END AS "group",
  count(*) AS "count", avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std
  FROM s GROUP BY 1)
SELECT "group", "count", round(mean, 6) AS mean, median, round(std, 6) AS std,
  (SELECT round(avg(v) FILTER (WHERE short) - avg(v) FILTER (WHERE NOT short), 6) FROM s)
    AS mean_diff_1_3_minus_4_plus,
  u1 AS mannwhitney_u, __Z____P__ AS p_value, round(r, 6) AS rank_biserial_r,
  CASE WHEN abs(r) >= 0.5 THEN '큰 효과' WHEN abs(r) >= 0.3 THEN '중간 효과'
    WHEN abs(r) >= 0.1 THEN '작은 효과' ELSE '매우 작은 효과' END AS effect_size_label
FROM g, z""".replace("__P__", f"round(least(2 * {_normal_tail('z_abs')}, 1), 6)")


@register("k10_delay_threshold_test", _THRESHOLD.replace("__Z__", "round(z_abs, 6) AS z_abs, "))
def _(q: Inputs):
    return hypothesis.threshold_test(q.orders)


@register("k10_delay_threshold_test_with_p", _THRESHOLD.replace("__Z__", ""))
def _(q: Inputs):
    return hypothesis.threshold_test_with_p(q.orders)


_KS = """
, f AS (SELECT {value} AS v, count(*) FILTER (WHERE is_delayed = 1) AS a, count(*) FILTER (WHERE is_delayed = 0) AS b
  FROM {source} WHERE {value} IS NOT NULL AND is_delayed IN (0, 1) GROUP BY 1),
c AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER ()::DOUBLE AS fa, sum(b) OVER (ORDER BY v) / sum(b) OVER ()::DOUBLE AS fb
  FROM f),
n AS (SELECT sum(a)::BIGINT AS n1, sum(b)::BIGINT AS n2, (SELECT max(abs(fa - fb)) FROM c) AS d FROM f),
l AS (SELECT *, sqrt(n1 * n2::DOUBLE / (n1 + n2)) * d AS x FROM n)
SELECT n1, n2, round(d, 6) AS d, round(CASE WHEN x < 0.2 THEN 1 ELSE least(1, (SELECT sum((2 * (k % 2) - 1) * 2
  * exp(-2.0::DOUBLE * k * k * x * x)) FROM range(1, 61) AS s(k))) END, 6) AS p_value FROM l"""


@register("k8_ks_scores_of_delayed_orders", _KS.format(value="review_score", source="final_orders"))
def _(q: Inputs):
    return rank_tests.kolmogorov_smirnov(q.orders, "review_score", "is_delayed", 1, 0, bounded=True)


@register("k8_ks_price_of_delayed_items", _KS.format(value="price", source="sale_items"))
def _(q: Inputs):
    return rank_tests.kolmogorov_smirnov(q.items("price", "is_delayed"), "price", "is_delayed", 1, 0)


@register("k8_ks_normal_dispatch_days", f"""
, m AS (SELECT avg(dispatch_days) AS mean, stddev_samp(dispatch_days) AS std FROM sale_items),
f AS (SELECT dispatch_days::DOUBLE AS v, count(*)::DOUBLE AS t FROM sale_items WHERE dispatch_days IS NOT NULL GROUP BY 1),
c AS (SELECT v, sum(t) OVER (ORDER BY v) / sum(t) OVER () AS upto, (sum(t) OVER (ORDER BY v) - t) / sum(t) OVER () AS before,
  1 - {_normal_tail('(v - m.mean) / m.std')} AS below FROM f, m),
n AS (SELECT (SELECT sum(t) FROM f)::BIGINT AS n, max(greatest(upto - below, below - before)) AS d FROM c)
SELECT n.n, round(mean, 6) AS mean, round(std, 6) AS std, round(d, 6) AS d,
  round(CASE WHEN sqrt(n.n) * d < 0.2 THEN 1 ELSE least(1, (SELECT sum((2 * (k % 2) - 1) * 2
  * exp(-2.0::DOUBLE * k * k * n.n * d * d)) FROM range(1, 61) AS s(k))) END, 6) AS p_value FROM n, m""")
def _(q: Inputs):
    return rank_tests.kolmogorov_smirnov_normal(q.items("dispatch_days"), "dispatch_days")


_SCORES = """
, """ + NORMAL_GRID + """,
f AS (SELECT {by}, {value}::DOUBLE AS v, count(*)::DOUBLE AS t FROM {source} WHERE {value} IS NOT NULL AND {by} IS NOT NULL
  GROUP BY ALL),
r AS (SELECT *, (sum(t) OVER (PARTITION BY {by} ORDER BY v) - t + (t + 1) / 2 - 0.375)
  / (sum(t) OVER (PARTITION BY {by}) + 0.25) AS share FROM f),
z AS (""" + normal_quantile("r", "share") + """),
m AS (SELECT {by}, sum(t * v) / sum(t) AS mv, sum(t * z) / sum(t) AS mz FROM z GROUP BY ALL),
w AS (SELECT {by}, sum(t) AS n, pow(sum(t * (v - mv) * (z - mz)), 2)
  / (sum(t * pow(v - mv, 2)) * sum(t * pow(z - mz, 2))) AS w FROM z JOIN m USING ({by}) GROUP BY ALL),
y AS (SELECT *, (ln(1 - w) + 1.2725 - 1.0521 * (ln(ln(n)) - ln(n))) / (1.0308 - 0.26758 * (ln(ln(n)) + 2 / ln(n))) AS y FROM w)
SELECT {keep}n::BIGINT AS n, round(w, 6) AS w, CASE WHEN n BETWEEN 5 AND 5000 THEN round(CASE WHEN y < 0
  THEN 1 - """ + _normal_tail("-y") + " ELSE " + _normal_tail("y") + """ END, 6) END AS p_value FROM y"""


@register("k8_normal_scores_price", _SCORES.format(
    by="k", keep="", value="price", source="(SELECT 1 AS k, price FROM sale_items)"))
def _(q: Inputs):
    return rank_tests.normal_scores(q.items("price"), "price")


@register("k8_normal_scores_delivery_days", _SCORES.format(
    by="is_delayed", keep="is_delayed, ", value="delivery_days", source="final_orders"))
def _(q: Inputs):
    return rank_tests.normal_scores(q.orders, "delivery_days", ["is_delayed"])


# Untied ranks: every choice of n1 of them counted by its sum.
@register("k2_exact_mean_price_of_slow_states", """
, s AS (SELECT customer_state, avg(price) AS v, count(*) AS n, count(*) FILTER (WHERE is_delayed = 1) AS d
  FROM sale_items WHERE customer_state IS NOT NULL GROUP BY 1),
o AS (SELECT sum(n) AS n, sum(d) AS d FROM s),
r AS (SELECT CASE WHEN s.d * o.n > o.d * s.n THEN 1 ELSE 0 END AS slow, rank() OVER (ORDER BY v) AS k,
  count(*) OVER (PARTITION BY v) AS t FROM s, o),
b AS (SELECT count(*) FILTER (WHERE slow = 1) AS n1, count(*) FILTER (WHERE slow = 0) AS n2,
  coalesce(sum(k) FILTER (WHERE slow = 1), 0) AS r1 FROM r),
u AS (SELECT n1, n2, (r1 - n1 * (n1 + 1) / 2)::DOUBLE AS u1, sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1)) AS sd FROM b),
e AS (WITH RECURSIVE c(i, k, total, ways) AS (SELECT 0, 0, 0, 1::DOUBLE UNION ALL
    SELECT i + 1, k + x, total + x * (i + 1), sum(ways) FROM c, (VALUES (0), (1)) AS t(x), b WHERE i < n1 + n2 AND k + x <= n1
    GROUP BY ALL)
  SELECT total - n1 * (n1 + 1) / 2 AS value, ways / sum(ways) OVER () AS p FROM c, b WHERE i = n1 + n2 AND k = n1)
SELECT n1, n2, u1, n1 * n2 - u1 AS u2, round(greatest(abs(u1 - n1 * n2 / 2.0) - 0.5, 0) / sd, 6) AS z_abs,
  round((u1 - n1 * n2 / 2.0 - 0.5) / sd, 6) AS z_greater, round(2 * u1 / (n1 * n2) - 1, 6) AS rank_biserial_r,
  round(u1 / (n1 * n2), 6) AS cles, 'exact' AS p_method,
  round(least(1, 2 * (SELECT sum(p) FROM e WHERE value >= greatest(u1, n1 * n2 - u1))), 6) AS p_two_sided,
  round((SELECT sum(p) FROM e WHERE value >= u1), 6) AS p_greater FROM u""")
def _(q: Inputs):
    items = q.items("customer_state", "price", "is_delayed").where(F.col("customer_state").isNotNull())
    late = F.coalesce(F.sum("is_delayed"), F.lit(0))
    states = items.groupBy("customer_state").agg(F.avg("price").alias("price"), F.count("*").alias("n"), late.alias("late"))
    whole = items.agg(F.struct(F.count("*").alias("n"), late.alias("late"))).scalar()
    slow = states.withColumn("_whole", whole).withColumn(
        "slow", (F.col("late") * F.col("_whole.n") > F.col("_whole.late") * F.col("n")).cast("int"))
    return rank_tests.mann_whitney(slow, "price", "slow", 1, 0, bounded=True, exact_up_to=rank_tests.EXACT_LIMIT)


@register("k3_effect_level", """
, s AS (SELECT avg(review_score) FILTER (WHERE is_delayed = 1) AS a FROM final_orders),
f AS (SELECT review_score AS v, count(*) AS t, count(*) FILTER (WHERE is_delayed = 1) AS a
  FROM final_orders GROUP BY 1),
r AS (SELECT *, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2.0::DOUBLE AS mid FROM f),
b AS (SELECT sum(a)::DOUBLE AS n1, sum(t - a)::DOUBLE AS n2, sum(a * mid) AS r1 FROM r),
e AS (SELECT 2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n2) - 1 AS rbc FROM b)
SELECT round(rbc, 6) AS rank_biserial_r, CASE WHEN abs(rbc) < 0.1 THEN 'Negligible'
  WHEN abs(rbc) < 0.3 THEN 'Small' WHEN abs(rbc) < 0.5 THEN 'Medium' ELSE 'Large' END AS level
FROM e""")
def _(q: Inputs):
    test = rank_tests.mann_whitney(q.orders, "review_score", "is_delayed", 1, 0)
    return test.select("rank_biserial_r", bands.effect_level("rank_biserial_r").alias("level"))
