"""Exact global order statistics without a global sort.

Raw rows are first collapsed to one row per distinct value, which removes hot
values before anything is shuffled by value. Running totals over those distinct
values then use two levels: small per-bucket totals give each bucket its
offset, and only the rows inside one bucket are ordered together. No task ever
holds more than one bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

VALUE_BUCKETS = 1024
# rank error of the split points, well below one bucket; keeps the merged sketch small
CUT_ACCURACY = 4000
HASH_BUCKETS = 8192


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column], weight: str,
                  out: str, bucket: str | None = None, total: str | None = None,
                  keep: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the same ``by`` group.

    ``bucket`` names an integer column that never decreases along ``order``.
    Without it the whole group is ordered in one window, which is only right
    when the number of rows per group is bounded. ``total`` also adds the sum
    over the whole group. ``keep(first, last, total)`` may name the buckets whose
    rows are wanted, given the positions a bucket covers; rows of other buckets
    are then dropped before they are shuffled and sorted.
    """
    by = list(by)
    before = (Window.unboundedPreceding, -1)
    if bucket is None:
        w = Window.partitionBy(*by)
        sums = {out: F.coalesce(F.sum(weight).over(w.orderBy(*order).rowsBetween(*before)), F.lit(0))}
        if total:
            sums[total] = F.sum(weight).over(w)
        return df.withColumns(sums)

    over = Window.partitionBy(*by)
    earlier = over.orderBy(bucket).rowsBetween(*before)
    offsets = df.groupBy(*by, bucket).agg(F.sum(weight).alias("_weight")).select(
        *by, bucket,
        F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_weight").over(over).alias("_total"), "_weight",
    )
    if keep is not None:
        offsets = offsets.where(keep(
            F.col("_offset"), F.col("_offset") + F.col("_weight") - 1, F.col("_total")))
    offsets = offsets.drop("_weight")
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(*before)
    joined = df.join(offsets, [*by, bucket])
    result = joined.withColumn(
        out, F.col("_offset") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    if total:
        result = result.withColumn(total, F.col("_total"))
    return result.drop("_offset", "_total")


def value_frequencies(df: DataFrame, value: str, by: Sequence[str] = (),
                      weight: str | None = None) -> DataFrame:
    """One row per distinct (by, value) with its count ``n``; missing keys are left out.

    ``weight`` names a count column when the rows are already counted.
    """
    keys = [*by, value]
    present = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    # the always-true filter makes every consumer read n, so that plans which use
    # the table several times share one shuffle of it
    size = F.sum(weight) if weight else F.count("*")
    return present.groupBy(*keys).agg(size.alias("n")).where("n > 0")


def _with_bucket(freq: DataFrame, value: str) -> DataFrame:
    """Number of split points below the value, by binary search in ``_cuts``."""
    out, step = freq.withColumn("_bucket", F.lit(0)), VALUE_BUCKETS // 2
    while step:
        cut = F.get("_cuts", F.col("_bucket") + step - 1)
        out = out.withColumn("_bucket", F.col("_bucket") + F.when(
            cut < F.col(value), step).otherwise(0))
        step //= 2
    return out


def bucketed(freq: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the number of their bucket, in ``_bucket``.

    Split points balance distinct values, so a hot value cannot fill a bucket.
    """
    # one constant instead of a thousand literals keeps the plan small
    steps = F.split(F.lit(",".join(
        str(i / VALUE_BUCKETS) for i in range(1, VALUE_BUCKETS))), ",").cast("array<double>")
    cuts = F.percentile_approx(value, steps, CUT_ACCURACY).alias("_cuts")
    if by:
        freq = freq.join(freq.groupBy(*by).agg(cuts), list(by))
    else:
        freq = freq.withColumn("_cuts", freq.agg(cuts).scalar())
    return _with_bucket(freq, value).drop("_cuts")


def ranked_values(df: DataFrame, value: str, by: Sequence[str] = (),
                  bounded: bool = False, weight: str | None = None,
                  keep: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Distinct values with ``n``, ``cum_before``, ``total`` and ``midrank``.

    ``midrank`` is the average rank (ties share it) that rank tests need.
    ``bounded=True`` says the number of distinct values per group is small by
    nature (scores, day counts), so a plain window orders them. ``keep`` is
    passed on to ``running_total``.
    """
    by = list(by)
    freq = value_frequencies(df, value, by, weight)
    bucket = None
    if not bounded:
        freq = bucketed(freq, value, by)
        bucket = "_bucket"
    ranked = running_total(freq, by, [F.col(value)], "n", "cum_before", bucket, "total", keep)
    ranked = ranked.withColumn("midrank", F.col("cum_before") + (F.col("n") + 1) / 2.0)
    return ranked.drop("_bucket")


def numbered_rows(df: DataFrame, by: Sequence[str], key: Column, ties: Sequence[Column],
                  out: str = "row_number") -> DataFrame:
    """Exact row number in hash order inside each ``by`` group, for large groups.

    ``key`` must be a well mixed non-negative hash below 2**31. Its leading bits
    are the bucket, so a group of any size spreads over ``HASH_BUCKETS`` tasks.
    """
    hashed = df.withColumn("_hash", key).withColumn(
        "_bucket", F.shiftright("_hash", 31 - HASH_BUCKETS.bit_length() + 1).cast("int")
    ).withColumn("_one", F.lit(1))
    ranked = running_total(hashed, by, [F.col("_hash"), *ties], "_one", "_before", "_bucket")
    return ranked.withColumn(out, F.col("_before") + 1).drop("_hash", "_bucket", "_one", "_before")
