"""Registration of named queries."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelsight.plans import prepare
from parcelsight.plans.catalog.oracle import with_prelude
from parcelsight.session import configure
from parcelsight.sources.adapter import HUB_STATE, raw_tables
from parcelsight.sources.tables import RawTables

MODULES = ("quality", "preparation", "derived", "aggregates", "reporting", "statistics",
           "splitting", "decisions", "modelling", "streams")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class Inputs:
    """What a query starts from: the raw tables and the analysis tables behind them."""

    spark: SparkSession
    sf_dir: str
    hub: str = HUB_STATE

    @cached_property
    def tables(self) -> RawTables:
        return raw_tables(self.spark, self.sf_dir)

    @cached_property
    def orders(self) -> DataFrame:
        return prepare.delivery_orders(self.tables)

    def items(self, *columns: str) -> DataFrame:
        return prepare.analysis_items(self.tables, columns or None)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to six places: engines add in different orders."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df


def register(name: str, sql: str | None = None):
    def add(plan: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(plan(Inputs(configure(spark), sf_dir)))

        _QUERIES[name] = run
        if sql is not None:
            _ORACLES[name] = with_prelude(sql)
        return plan

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"parcelsight.plans.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
