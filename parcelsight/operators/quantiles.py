"""Exact interpolated quantiles, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.operators.ordering import running_total, value_frequencies
from parcelsight.sources.sinks import stage

#: Inverse of the rank error of the sketch behind exact quantiles, and how far its limits are from a wanted share of the rows.
SKETCH_ACCURACY = 10_000
LIMIT_DISTANCE = 3 / SKETCH_ACCURACY
#: Up to so many values, whose ranks are further apart than these shares, a column is grouped as a whole.
FEW_VALUES = 2 * SKETCH_ACCURACY


def bounded_quantile(c: str | Column, q: float | Sequence[float]) -> Column:
    """Quantile aggregate for columns with few distinct values (scores, day counts).

    Its state is one counter per distinct value. Use ``exact_quantiles`` for
    continuous columns.
    """
    return F.percentile(c, q if isinstance(q, float) else list(q))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Linearly interpolated quantiles of continuous columns, all in one pass.

    Returns ``[by...], column, n, q_0, q_1, ...`` in the order of
    ``probabilities``. A column without any value has no row. A sketch first
    encloses every wanted position; only the values between its limits are
    told apart, all others are counted.
    """
    by = list(by)
    counts = _counts_by_cell(df, columns, probabilities, by)

    def wanted(first: Column, last: Column, total: Column) -> Column:
        """Whether a range of positions holds a value that some quantile reads."""
        hit = F.lit(False)
        for p in probabilities:
            position = (total - 1) * F.lit(float(p))
            hit = hit | F.floor(position).between(first, last) | F.ceil(position).between(first, last)
        return hit

    ranked = running_total(counts, [*by, "column"], [F.col("value")], "n", "cum_before", "cell", "total", wanted)
    first, last = F.col("cum_before"), F.col("cum_before") + F.col("n") - 1
    # the sketch's error bound makes a range of values at a wanted position impossible
    value = F.when(F.col("value") == F.col("top"), F.col("value")).otherwise(
        F.raise_error(F.lit("a quantile lies outside the limits of its sketch")).cast("double"))

    def at(position: Column) -> Column:
        return F.max(F.when(position.between(first, last), value))

    picks = [F.max("total").alias("n")]
    for i, p in enumerate(probabilities):
        position = (F.col("total") - 1) * F.lit(float(p))
        low, high = at(F.floor(position)), at(F.ceil(position))
        fraction = F.max(position) - F.floor(F.max(position))
        picks.append((low + (high - low) * fraction).alias(f"q_{i}"))
    return ranked.groupBy(*by, "column").agg(*picks)


def _counts_by_cell(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    by: Sequence[str]) -> DataFrame:
    """``[by...], column, cell, value, top, n``: counts of the ranges of values between a sketch's limits.

    Cells are numbered along the values, and each limit is a cell of its own. Between the two limits around a wanted
    position every distinct value has its row, elsewhere a cell is one row from its least to its largest value.
    """
    pairs = [(max(p - LIMIT_DISTANCE, 0.0), min(p + LIMIT_DISTANCE, 1.0)) for p in map(float, probabilities)]
    around = sorted({share for pair in pairs for share in pair})
    doubles = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    if by:
        doubles = doubles.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in by)))
    limits = doubles.groupBy(*by).agg(
        # a sketch cannot order NaN, which comes after infinity
        F.array(*[F.percentile_approx(F.when(F.isnan(c), float("inf")).otherwise(F.col(c)), around, SKETCH_ACCURACY)
                  for c in columns]).alias("cuts"), F.array(*[F.count(c) for c in columns]).alias("counts"))
    if by:
        # staged, the groups have a known size, and a small table of them is broadcast before any row is shuffled
        limits = stage(limits.select(*by, F.struct("cuts", "counts").alias("_limits")), "quantile_limits")
        doubles = doubles.join(limits, by)
    else:
        doubles = doubles.withColumn("_limits", limits.select(F.struct("cuts", "counts")).scalar())
    long = doubles.select(*by, "_limits", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("_i"), F.col(c).alias("value"))
        for i, c in enumerate(columns)]))).where("value IS NOT NULL")
    # one expression for all columns: a longer one is more than the JVM compiles
    long = long.select(*by, "column", "value", F.get("_limits.cuts", F.col("_i")).alias("_cuts"),
                       (F.get("_limits.counts", F.col("_i")) <= FEW_VALUES).alias("_few"))
    cell, inside = F.lit(0), F.col("_few")
    for i in range(len(around)):
        cut = F.get("_cuts", F.lit(i))
        cell = cell + (F.col("value") > cut).cast("int") + (F.col("value") >= cut).cast("int")
    for low, high in pairs:
        inside = inside | F.col("cell").between(2 * around.index(low) + 2, 2 * around.index(high))
    long = long.withColumn("cell", cell).withColumn("kept", F.when(inside, F.col("value")))
    # the always-true filter makes every consumer read n, so that both uses share one shuffle
    return long.groupBy(*by, "column", "cell", "kept").agg(
        F.min("value").alias("value"), F.max("value").alias("top"), F.count("*").alias("n")).where("n > 0").drop("kept")


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of every column."""
    quantiles = exact_quantiles(df, columns, [0.5])
    return quantiles.agg(*[
        F.max(F.when(F.col("column") == c, F.col("q_0"))).alias(c) for c in columns])


def histogram(df: DataFrame, c: str, bins: int = 25) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed.

    All ``bins`` appear, empty ones with count 0. A constant column gets a range
    of one around its value.
    """
    freq = value_frequencies(df.select(F.col(c).cast("double").alias("value")), "value")
    low, high = F.min("value"), F.max("value")
    pad = F.when(low == high, 0.5).otherwise(0.0)
    span = freq.agg((low - pad).alias("low"), (high + pad).alias("high"))
    raw = F.floor((F.col("value") - F.col("low")) * bins / (F.col("high") - F.col("low")))
    counted = (
        freq.withColumn("_span", span.select(F.struct("low", "high")).scalar())
        .withColumns({"low": F.col("_span.low"), "high": F.col("_span.high")})
        .withColumn("bin", F.least(raw, F.lit(bins - 1)).cast("int"))
        .groupBy("bin").agg(F.sum("n").alias("n"))
    )
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn(
        "_span", span.select(F.struct("low", "high")).scalar())
    width = (F.col("_span.high") - F.col("_span.low")) / bins
    return edges.join(counted, "bin", "left").select(
        "bin",
        (F.col("_span.low") + F.col("bin") * width).alias("left_edge"),
        (F.col("_span.low") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    ).orderBy("bin")


def box_statistics(df: DataFrame, c: str, by: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges and outlier count per group.

    For columns with few distinct values; works on the frequency table, so both
    passes read counts and not rows.
    """
    freq = value_frequencies(df.select(by, F.col(c).cast("double").alias("value")), "value", [by])
    quartiles = freq.groupBy(by).agg(
        F.percentile("value", [0.25, 0.5, 0.75], F.col("n")).alias("q"))
    iqr = F.col("q")[2] - F.col("q")[0]
    inside = F.col("value").between(F.col("q")[0] - 1.5 * iqr, F.col("q")[2] + 1.5 * iqr)
    return freq.join(quartiles, by).groupBy(by).agg(
        F.sum("n").alias("n"),
        F.max(F.col("q")[0]).alias("q1"),
        F.max(F.col("q")[1]).alias("median"),
        F.max(F.col("q")[2]).alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("n_outliers"),
    ).orderBy(by)


def quantile_cut(df: DataFrame, c: str, upper: float | None = None, lower: float | None = None,
                 strict: bool = False, scope: Column | None = None) -> DataFrame:
    """Keep rows up to a quantile of the column (and from one, when ``lower`` is given).

    The limits come from a scalar subquery, so the cut itself is a plain filter.
    ``scope`` restricts both the quantile and the rows kept.
    """
    base = df if scope is None else df.where(scope)
    wanted = [q for q in (lower, upper) if q is not None]
    limits = base.agg(bounded_quantile(c, wanted).alias("limits"))
    kept = base
    if upper is not None:
        limit = limits.scalar()[len(wanted) - 1]
        kept = kept.where(F.col(c) < limit if strict else F.col(c) <= limit)
    if lower is not None:
        kept = kept.where(F.col(c) >= limits.scalar()[0])
    return kept
