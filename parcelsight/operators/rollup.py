"""Order roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelsight.operators import impute


def order_roll_up(items: DataFrame, sums: list[str], modal: list[str]) -> DataFrame:
    """Item count, sums and modal values per order."""
    out = items.groupBy("order_id").agg(
        F.count("*").alias("total_items"), *[F.sum(c).alias(c) for c in sums])
    for c in modal:
        out = out.join(impute.modes(items, ["order_id"], c), "order_id", "left")
    return out


def item_values(items: DataFrame, value: str) -> DataFrame:
    """The item values of each order, each with how often it repeats, for orders of any size.

    Counts combine before the shuffle and no task holds an order. Sorted by value and repeated, the rows of
    an order are the array that ``item_arrays`` makes.
    """
    return items.groupBy("order_id", value).agg(F.count("*").alias("repeats"))


def item_arrays(items: DataFrame, value: str) -> DataFrame:
    """The sorted item values of each order as one array, equal values included.

    Only for items whose orders the caller knows to be small: an array is one row. ``item_values`` has
    the same content for any order.
    """
    return items.groupBy("order_id").agg(
        F.array_sort(F.collect_list(value)).alias(value), F.count("*").alias("items"))
