"""Rank tests, correlations and moments from frequency tables.

The data is reduced to (group, value, count) before anything is ranked, so a
test over any number of rows ranks only the distinct values. P-values are
scalar arithmetic on the one-row result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.functions import pvalues, tails
from parcelsight.operators.ordering import bucketed, ranked_values, running_total, value_frequencies
from parcelsight.sources.sinks import stage


def _grouped_ranks(df: DataFrame, value: str, group: str, bounded: bool) -> DataFrame:
    """(group, value, n) with the midrank of each value in the pooled sample.

    The pooled ranks come from the same counts, so the data is read once.
    """
    counts = value_frequencies(df, value, [group])
    ranks = ranked_values(counts, value, bounded=bounded, weight="n").select(
        value, "midrank", F.col("n").alias("tied"), F.col("total"))
    return counts.join(ranks, value)


def _tie_sum():
    """Sum of t^3 - t over distinct values, from rows that repeat per group."""
    tied = F.col("tied").cast("double")
    return F.sum(F.col("n") / tied * (tied * tied * tied - tied))


#: Largest group for which the exact distribution of U is counted out: its counts stay below 2^53.
EXACT_LIMIT = 25


def mann_whitney(df: DataFrame, value: str, group: str, first, second,
                 bounded: bool = False, exact_up_to: int = 0) -> DataFrame:
    """U of the first group, with tie-corrected z, rank-biserial r, CLES and p; without spread p is 1.

    Where neither group has more than ``exact_up_to`` rows (at most ``EXACT_LIMIT``) and no value is tied, p comes from the
    exact distribution of U. With this option a column ``p_method`` tells ``exact`` from ``normal``.
    """
    if not 0 <= exact_up_to <= EXACT_LIMIT:
        raise ValueError(f"exact_up_to lies between 0 and {EXACT_LIMIT}: {exact_up_to}")
    ranks = _grouped_ranks(df.where(F.col(group).isin(first, second)), value, group, bounded)
    is_first = F.col(group) == F.lit(first)
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("double")
    base = ranks.agg(
        n(is_first).alias("n1"), n(~is_first).alias("n2"),
        F.coalesce(F.sum(F.when(is_first, F.col("n") * F.col("midrank"))), F.lit(0.0)).alias("r1"),
        F.coalesce(_tie_sum(), F.lit(0.0)).alias("ties"))
    pairs, total = F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    spread = F.sqrt(pairs / 12.0 * (
        total + 1 - F.try_divide(F.col("ties"), total * (total - 1))))
    with_u = base.select("n1", "n2", "ties", u.alias("u1"), pairs.alias("_pairs"), spread.alias("_sd"))
    centred = F.col("u1") - F.col("_pairs") / 2.0
    tested = with_u.select(
        F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"), "u1",
        (F.col("_pairs") - F.col("u1")).alias("u2"),
        F.try_divide(F.greatest(F.abs(centred) - 0.5, F.lit(0.0)), F.col("_sd")).alias("z_abs"),
        F.try_divide(centred - 0.5, F.col("_sd")).alias("z_greater"),
        (2.0 * F.try_divide(F.col("u1"), F.col("_pairs")) - 1.0).alias("rank_biserial_r"),
        F.try_divide(F.col("u1"), F.col("_pairs")).alias("cles"), (F.col("ties") > 0).alias("_tied"),
    )
    p = {"p_two_sided": F.least(2.0 * tails.normal_tail("z_abs"), F.lit(1.0)), "p_greater": tails.normal_tail("z_greater")}
    if exact_up_to:
        small = ~F.col("_tied") & F.col("n1").between(1, exact_up_to) & F.col("n2").between(1, exact_up_to)
        tail = lambda u: tails.rank_sum_tail(u, F.col("n1"), F.col("n2"))
        p["p_two_sided"] = F.when(small, F.least(2.0 * tail(F.greatest("u1", "u2")), F.lit(1.0))).otherwise(p["p_two_sided"])
        p["p_greater"] = F.when(small, tail(F.col("u1"))).otherwise(p["p_greater"])
        tested = tested.withColumn("p_method", F.when(small, "exact").otherwise("normal"))
    return tested.withColumns({name: F.coalesce(c, F.lit(1.0)) for name, c in p.items()}).drop("_tied")


def mann_whitney_p(result: DataFrame, alternative: str = "two-sided") -> float:
    """P-value of a ``mann_whitney`` result (an action on one row)."""
    row = result.first()
    if alternative == "two-sided":
        return 1.0 if row["z_abs"] is None else min(1.0, 2.0 * pvalues.normal_sf(row["z_abs"]))
    if alternative == "greater":
        return 1.0 if row["z_greater"] is None else pvalues.normal_sf(row["z_greater"])
    raise ValueError(f"unknown alternative: {alternative}")


def kruskal_wallis(df: DataFrame, value: str, group: str, bounded: bool = False) -> DataFrame:
    """H with tie correction over all groups, and its p, null where H is not defined."""
    ranks = _grouped_ranks(df, value, group, bounded)
    per_group = ranks.groupBy(group).agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("n") * F.col("midrank")).alias("r"), _tie_sum().alias("ties"))
    total = per_group.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("ties").alias("ties"))
    n = F.col("n")
    h = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    return total.select(
        F.col("k").alias("groups"), n.cast("bigint").alias("n"),
        F.try_divide(h, 1.0 - F.try_divide(F.col("ties"), n * n * n - n)).alias("h")).withColumn(
        "p_value", tails.chi_square_tail("h", F.col("groups") - 1))


def kruskal_wallis_p(result: DataFrame) -> float | None:
    """P-value of a ``kruskal_wallis`` result; None where H is not defined."""
    row = result.first()
    if row["h"] is None or row["groups"] < 2:
        return None
    return pvalues.chi2_sf(row["h"], row["groups"] - 1)


def _pair_correlations(df: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """Pearson correlation of every column pair from one pass of weighted sums.

    Values are centred on their weighted means first, which keeps the sums
    accurate for large ranks.
    """
    n = F.col(weight).cast("double")
    means = df.agg(F.struct(*[
        (F.sum(n * F.col(c)) / F.sum(n)).alias(c) for c in columns])).scalar()
    centred = df.withColumn("_m", means).select(
        n.alias("n"), *[(F.col(c) - F.col(f"_m.{c}")).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    moments = centred.agg(*[
        F.sum(F.col("n") * F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs],
        F.sum("n").cast("bigint").alias("n"))
    names = {}
    for a, b in pairs:
        names[a, b] = names[b, a] = f"{a}__{b}"
    cells = [
        F.struct(
            F.lit(a).alias("left"), F.lit(b).alias("right"), F.col("n").alias("n"),
            F.try_divide(F.col(names[a, b]),
                         F.sqrt(F.col(names[a, a])) * F.sqrt(F.col(names[b, b]))).alias("corr"))
        for a in columns for b in columns
    ]
    return moments.select(F.inline(F.array(*cells)))


def spearman_matrix(df: DataFrame, columns: Sequence[str], bounded: bool = False) -> DataFrame:
    """Spearman correlation of every pair over rows complete in all columns.

    Equal rows are counted together first and the counts staged. Each column's
    ranks come from those counts and are looked up per distinct row, so the data
    is read once and neither a hot value nor the raw row count matters afterwards.
    """
    columns = list(columns)
    distinct_rows = stage(df.select(*columns).na.drop().groupBy(*columns).agg(
        F.count("*").alias("_n")), "spearman_counts")
    ranked = distinct_rows
    for c in columns:
        ranks = ranked_values(distinct_rows, c, bounded=bounded, weight="_n").select(
            c, F.col("midrank").alias(f"_rank_{c}"))
        ranked = ranked.join(ranks, c)
    as_ranks = ranked.select("_n", *[F.col(f"_rank_{c}").alias(c) for c in columns])
    return _pair_correlations(as_ranks, columns, "_n").withColumnRenamed("corr", "rho").withColumn(
        "p_value", correlation_p("rho", "n"))


def correlation_p(corr: str, n: str) -> Column:
    """Two-sided p of a correlation; null for a constant column or fewer than three rows."""
    r, freedom = F.col(corr), F.col(n) - 2
    t = r * F.sqrt(F.try_divide(freedom.cast("double"), 1.0 - r * r))
    return F.when(r.isNull() | (freedom < 1), None).when(F.abs(r) >= 1.0, 0.0).otherwise(tails.student_two_sided(t, freedom))


def spearman_p(rho: float | None, n: int) -> float | None:
    """Two-sided p of a rank correlation; None for a constant column or fewer than three rows."""
    if rho is None or n < 3:
        return None
    if abs(rho) >= 1.0:
        return 0.0
    return pvalues.student_two_sided(rho * math.sqrt((n - 2) / (1.0 - rho * rho)), n - 2)


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    return _pair_correlations(rows.withColumn("_n", F.lit(1)), list(columns), "_n")


def welch_t(df: DataFrame, value: str, group: str, first, second) -> DataFrame:
    """Difference of means with unequal variances: t, degrees of freedom and two-sided p, null where t is."""
    v = F.col(value).cast("double")

    def side(key, i):
        mine = F.when(F.col(group) == F.lit(key), v)
        return [F.count(mine).alias(f"n{i}"), F.avg(mine).alias(f"mean{i}"),
                F.var_samp(mine).alias(f"var{i}")]

    stats = df.agg(*side(first, 1), *side(second, 2))
    a = F.try_divide(F.col("var1"), F.col("n1"))
    b = F.try_divide(F.col("var2"), F.col("n2"))
    return stats.select(
        "n1", "n2", "mean1", "mean2",
        F.try_divide(F.col("mean1") - F.col("mean2"), F.sqrt(a + b)).alias("t"),
        F.try_divide((a + b) * (a + b),
                     F.try_divide(a * a, F.col("n1") - 1)
                     + F.try_divide(b * b, F.col("n2") - 1)).alias("df"),
    ).withColumn("p_value", tails.student_two_sided("t", "df"))


def welch_p(result: DataFrame) -> float | None:
    """Two-sided p of a ``welch_t`` result; None where t is not defined."""
    row = result.first()
    if row["t"] is None or row["df"] is None:
        return None
    return pvalues.student_two_sided(row["t"], row["df"])


def _cumulative(df: DataFrame, value: str, columns: dict[str, Column], bounded: bool) -> DataFrame:
    """Distinct values with the sum of each column over all values up to each (``<name>``) and over all (``<name>_all``).

    The raw rows are counted per distinct value first; running totals use buckets, as ranks do.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        *[F.sum(c).cast("double").alias(f"_{n}") for n, c in columns.items()], F.count("*").alias("_rows")).where("_rows > 0")
    if not bounded:
        freq = bucketed(freq, "_v")
    for name in columns:
        freq = running_total(freq, [], [F.col("_v")], f"_{name}", f"_{name}_before", None if bounded else "_bucket",
                             f"{name}_all")
        freq = freq.withColumn(name, F.col(f"_{name}_before") + F.col(f"_{name}"))
    return freq


def kolmogorov_smirnov(df: DataFrame, value: str, group: str, first, second, bounded: bool = False) -> DataFrame:
    """Largest gap between the cumulative curves of two groups, with the p of its limiting distribution."""
    one = lambda key: F.when(F.col(group) == F.lit(key), 1).otherwise(0)
    curves = _cumulative(df.where(F.col(group).isin(first, second)), value, {"a": one(first), "b": one(second)}, bounded)
    gap = F.abs(F.try_divide(F.col("a"), F.col("a_all")) - F.try_divide(F.col("b"), F.col("b_all")))
    found = curves.agg(F.max("a_all").cast("long").alias("n1"), F.max("b_all").cast("long").alias("n2"), F.max(gap).alias("d"))
    size = F.sqrt(F.try_divide((F.col("n1") * F.col("n2")).cast("double"), (F.col("n1") + F.col("n2")).cast("double")))
    return found.withColumn("p_value", tails.kolmogorov_tail(size * F.col("d")))


def kolmogorov_smirnov_normal(df: DataFrame, value: str, bounded: bool = False) -> DataFrame:
    """Largest gap between the cumulative curve of a column and the normal one of its mean and deviation.

    The p is that of a normal distribution given beforehand; as mean and deviation come from the same rows, it is too large.
    """
    v = F.col(value).cast("double")
    shape = df.agg(F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))).scalar()
    curve = _cumulative(df, value, {"n": F.lit(1)}, bounded).withColumn("_s", shape)
    below = 1.0 - tails.normal_tail(F.try_divide(F.col("_v").cast("double") - F.col("_s.mean"), F.col("_s.std")))
    upto, before = F.col("n") / F.col("n_all"), F.col("_n_before") / F.col("n_all")
    found = curve.agg(F.max("n_all").cast("long").alias("n"), F.max("_s.mean").alias("mean"), F.max("_s.std").alias("std"),
                      F.max(F.greatest(upto - below, below - before)).alias("d"))
    return found.withColumn("p_value", tails.kolmogorov_tail(F.sqrt(F.col("n").cast("double")) * F.col("d")))


#: Sample sizes for which the normalising transformation of 1 - W' was fitted.
ROYSTON_SIZES = (5, 5000)


def normal_scores(df: DataFrame, value: str, by: Sequence[str] = (), bounded: bool = False) -> DataFrame:
    """Normality by W', the squared correlation of the values with the normal scores of their ranks, per group.

    The score of a value is the normal quantile of (midrank - 3/8) / (n + 1/4); tied values share theirs. Ranks come from the
    frequency table, so nothing is sorted as a whole and the sums run over distinct values. The p is that of Royston's
    normal approximation, for 5 to 5,000 values without many ties, else null; W' is null for a constant column.
    """
    by = list(by)
    ranks = ranked_values(df.select(*by, F.col(value).cast("double").alias("_v")), "_v", by, bounded)
    scored = ranks.select(*by, "_v", F.col("n").cast("double").alias("_n"), tails.normal_quantile(
        (F.col("midrank") - 0.375) / (F.col("total") + 0.25)).alias("_s"))
    mean = lambda c: (F.sum(F.col("_n") * F.col(c)) / F.sum("_n")).alias(c)
    means = scored.groupBy(*by).agg(F.struct(mean("_v"), mean("_s")).alias("_m"))
    centred = scored.join(means, by) if by else scored.withColumn("_m", means.scalar())
    v, s, n = F.col("_v") - F.col("_m._v"), F.col("_s") - F.col("_m._s"), F.col("_n")
    sums = centred.groupBy(*by).agg(
        F.sum(n).cast("long").alias("n"), F.sum(n * v * s).alias("_vs"), F.sum(n * v * v).alias("_vv"),
        F.sum(n * s * s).alias("_ss"), (F.min("_v") < F.max("_v")).alias("_varies"))
    tested = sums.select(*by, "n", F.when(F.col("_varies"), F.least(F.try_divide(
        F.col("_vs") * F.col("_vs"), F.col("_vv") * F.col("_ss")), F.lit(1.0))).alias("w"))
    # fixed values: Royston's fit of the mean and deviation of log(1 - W')
    u = F.log(F.col("n").cast("double"))
    centre = -1.2725 + 1.0521 * (F.log(u) - u)
    spread = 1.0308 - 0.26758 * (F.log(u) + 2.0 / u)
    z = (F.log(F.greatest(1.0 - F.col("w"), F.lit(1e-300))) - centre) / spread
    fitted = F.col("w").isNotNull() & F.col("n").between(*ROYSTON_SIZES)
    return tested.withColumn("p_value", F.when(fitted, tails.normal_tail(z)))


def jarque_bera(df: DataFrame, value: str, group: str) -> DataFrame:
    """Normality statistic per group from skewness and excess kurtosis."""
    v = F.col(value).cast("double")
    moments = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(v).alias("n"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"))
    s, k = F.col("skewness"), F.col("kurtosis")
    return moments.withColumn("jb", F.col("n") / 6.0 * (s * s + k * k / 4.0)).orderBy(group)


def normal_quantile_points(df: DataFrame, value: str, group: str, points: int = 19) -> DataFrame:
    """Sample quantiles next to standard normal quantiles, per group.

    For columns with few distinct values.
    """
    probabilities = [i / (points + 1) for i in range(1, points + 1)]
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(pvalues.normal_ppf(p)).alias("normal"))
                      for p in probabilities])
    sample = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.percentile(F.col(value), probabilities).alias("sample"))
    return sample.select(
        group, F.explode(F.arrays_zip(table.alias("table"), F.col("sample"))).alias("z")
    ).select(group, "z.table.p", "z.table.normal", "z.sample").orderBy(group, "p")
