"""Profiling and data-quality checks; each is one pass over its table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from parcelsight.functions.expressions import holds
from parcelsight.operators.quantiles import exact_quantiles

# The chronological rules an order has to obey.
TIMELINE_RULES = {
    "purchase > approved": ("order_purchase_timestamp", "order_approved_at"),
    "approved > carrier": ("order_approved_at", "order_delivered_carrier_date"),
    "carrier > delivered": ("order_delivered_carrier_date", "order_delivered_customer_date"),
    "delivered < purchase": ("order_purchase_timestamp", "order_delivered_customer_date"),
}


def split_by_type(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Names of the numeric and of the other columns."""
    numeric = [f.name for f in df.schema
               if isinstance(f.dataType, T.NumericType) and f.name not in exclude]
    other = [f.name for f in df.schema if f.name not in numeric and f.name not in exclude]
    return numeric, other


def _melt(aggregated: DataFrame, columns: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One-row aggregate with ``measure__column`` columns to one row per column."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{m}__{c}").alias(m) for m in measures])
        for c in columns
    ])
    return aggregated.select(F.inline(rows))


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and share of every column that misses anything, most first."""
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing__{c}") for c in df.columns])
    melted = counted.select(
        "rows",
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"missing__{c}").alias("missing"))
            for c in df.columns
        ])))
    return melted.where("missing > 0").select(
        "column", "missing", (F.col("missing") * 100.0 / F.col("rows")).alias("missing_pct"),
    ).orderBy(F.desc("missing"), "column")


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of numeric columns."""
    columns = list(columns or split_by_type(df)[0])
    as_double = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    aggregates = []
    for c in columns:
        aggregates += [F.count(c).alias(f"n__{c}"), F.avg(c).alias(f"mean__{c}"),
                       F.stddev_samp(c).alias(f"std__{c}"), F.min(c).alias(f"min__{c}"),
                       F.max(c).alias(f"max__{c}")]
    basic = _melt(as_double.agg(*aggregates), columns, ["n", "mean", "std", "min", "max"])
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75]).select(
        "column", F.col("q_0").alias("q25"), F.col("q_1").alias("q50"), F.col("q_2").alias("q75"))
    return basic.join(quartiles, "column", "left").orderBy("column")


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, distinct count, most frequent value and its frequency of text columns.

    Counts per distinct value come first, so no task collects a value set.
    """
    columns = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value")
    freq = long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    top = F.min(F.struct((-F.col("n")).alias("rank"), F.col("value").alias("value")))
    return freq.groupBy("column").agg(
        F.sum("n").alias("n"), F.count("*").alias("unique"),
        top.getField("value").alias("top"), (-top.getField("rank")).alias("freq"),
    ).orderBy("column")


def table_sizes(tables) -> DataFrame:
    """Rows and columns of each raw table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def column_types(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema, 1)],
        "position int, column string, dtype string")


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surplus rows and all rows that share their key with another row."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("member_rows"),
    )


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows themselves whose key occurs more than once; missing values equal each other."""
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(
        *[F.col(c).alias(f"_key_{c}") for c in keys])
    same = [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys]
    return df.join(repeated, same, "left_semi")


def frequency_table(df: DataFrame, c: str) -> DataFrame:
    """Counts and shares per value, missing values left out, most frequent first."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), c)


def distinct_options(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c)


def cardinalities(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column.

    The exact form counts rows after a per-column distinct, in one shuffle for
    all columns; the approximate form is a single sketch pass.
    """
    if approximate:
        return _melt(
            df.agg(*[F.approx_count_distinct(c).alias(f"distinct__{c}") for c in columns]),
            columns, ["distinct"])
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value")
    return (long.where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*"))
            .groupBy("column").agg(F.count("*").alias("distinct")).orderBy("column"))


def timeline_conditions() -> dict[str, Column]:
    """Rule name to "first timestamp lies after the second", unknown meaning no."""
    return {rule: holds(F.col(a) > F.col(b)) for rule, (a, b) in TIMELINE_RULES.items()}


def timeline_violations(orders: DataFrame) -> DataFrame:
    conditions = timeline_conditions()
    counted = orders.agg(*[F.count_if(cond).alias(f"violations__{rule}")
                           for rule, cond in conditions.items()])
    return _melt(counted, list(conditions), ["violations"])


def timeline_examples(orders: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` violating orders per rule, lowest order ids first."""
    out = None
    for rule, cond in timeline_conditions().items():
        rows = orders.where(cond).select(F.lit(rule).alias("rule"), "order_id").orderBy(
            "order_id").limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out


def unmatched_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows whose lookup finds nothing, a missing key included.

    Only distinct keys of the right side travel, so a key that fills it is one row.
    """
    keys = right.select(right_key).distinct()
    return left.join(keys, F.col(left_key) == F.col(right_key), "left_anti")


def fan_out(base: DataFrame, joined: list[tuple[str, DataFrame]], key: str,
            base_name: str = "base") -> DataFrame:
    """Row count after each left join on the key, to see where rows multiply.

    The joins are not carried out: per key the rows multiply by the number of
    matches, so counts per key are enough and nothing explodes.
    """
    n = base.groupBy(key).agg(F.count("*").alias("_rows_0"))
    names = [base_name]
    for position, (name, df) in enumerate(joined, 1):
        counts = df.groupBy(key).agg(F.count("*").alias("_n"))
        n = n.join(counts, key, "left").withColumn(
            f"_rows_{position}", F.col(f"_rows_{position - 1}") * F.coalesce("_n", F.lit(1))
        ).drop("_n")
        names.append(name)
    sums = n.agg(*[F.sum(f"_rows_{i}").alias(f"_rows_{i}") for i in range(len(names))])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("joined"),
                 F.col(f"_rows_{i}").alias("rows"))
        for i, name in enumerate(names)])))
