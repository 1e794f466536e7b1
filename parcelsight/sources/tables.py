"""The bundle of raw tables that every plan starts from."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class RawTables:
    customers: DataFrame
    geolocation: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    orders: DataFrame
    products: DataFrame
    sellers: DataFrame
    category: DataFrame

    def items(self):
        return [(f.name, getattr(self, f.name)) for f in fields(self)]
