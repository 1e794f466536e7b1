"""Splits by order: rows of one order always land together, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelsight.operators.ordering import numbered_rows

MERSENNE_31 = 2147483647
LEHMER_FACTOR = 48271


def mixed_key(key: str | Column, seed: int = 42, portable: bool = False) -> Column:
    """A well mixed non-negative number below 2**31 that depends on key and seed only.

    ``portable`` uses one Lehmer step on an integer key, which any SQL engine
    can repeat; otherwise a 64-bit hash serves every key type.
    """
    key = F.col(key) if isinstance(key, str) else key
    if portable:
        return ((key + seed) % MERSENNE_31) * LEHMER_FACTOR % MERSENNE_31
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(MERSENNE_31))


def order_share(key: str | Column = "order_id", seed: int = 42, portable: bool = False) -> Column:
    """Position of an order in [0, 1000)."""
    return mixed_key(key, seed, portable) % 1000


def split_label(key: str | Column = "order_id", seed: int = 42, portable: bool = False,
                test: float = 0.2, valid: float = 0.2) -> Column:
    """'test', 'valid' or 'train'; valid is a share of what test leaves over."""
    position = order_share(key, seed, portable)
    test_limit = round(1000 * test)
    valid_limit = test_limit + round((1000 - test_limit) * valid)
    return (F.when(position < test_limit, "test").when(position < valid_limit, "valid")
            .otherwise("train"))


def with_split(df: DataFrame, key: str = "order_id", **options) -> DataFrame:
    return df.withColumn("split", split_label(key, **options))


def split_overlap(df: DataFrame, key: str = "order_id", split: str = "split") -> DataFrame:
    """How many keys occur in more than one split, out of all keys."""
    per_key = df.groupBy(key).agg(
        F.min(split).alias("first"), F.max(split).alias("last"))
    return per_key.agg(
        F.count("*").alias("orders"),
        F.count_if(F.col("first") != F.col("last")).alias("overlapping_orders"))


def stratified_folds(df: DataFrame, label: str, key: str = "order_id", folds: int = 3,
                     seed: int = 42, portable: bool = False) -> DataFrame:
    """Fold per order with equal label shares (to within one order per label).

    An order takes its majority label (ties to the smaller). Orders are dealt
    round robin in hash order inside each label; the numbering is bucketed, so
    a label may hold any number of orders.
    """
    votes = df.groupBy(key, label).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("rank"), F.col(label).alias("value")))
    orders = votes.groupBy(key).agg(best.getField("value").alias("stratum"))
    numbered = numbered_rows(
        orders, ["stratum"], mixed_key(key, seed, portable), [F.col(key)], "_number")
    return numbered.select(key, "stratum", ((F.col("_number") - 1) % folds).cast("int").alias("fold"))


def stratified_row_sample(df: DataFrame, label: str, share: float, labels: list,
                          seed: int = 42) -> DataFrame:
    """Row-level stratified sample. Leaks orders across splits; kept to show that."""
    return df.sampleBy(label, {value: share for value in labels}, seed)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (classes * class count), one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(
        label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """The rows whose ``label`` is 0 or 1, with the balanced weight of their class."""
    df = df.where(F.col(label).isin(0, 1))
    counts = df.agg(F.struct(
        F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("ones"),
        F.count_if(F.col(label) == 0).alias("zeros"))).scalar()
    size = F.when(F.col(label) == 1, F.col("_c.ones")).otherwise(F.col("_c.zeros"))
    return df.withColumn("_c", counts).withColumn(out, F.try_divide(F.col("_c.n"), 2.0 * size)).drop("_c")
