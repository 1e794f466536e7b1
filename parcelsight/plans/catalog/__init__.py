"""Named queries over a data folder, each with an independent SQL twin where one exists."""

from parcelsight.plans.catalog.registry import oracles, queries

__all__ = ["oracles", "queries"]
