"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import details, events, extraction, items, items_sql, layers, repair, selected, skeletons, training, units

MODULES = [(events.QUERIES, events.SQL), (items.QUERIES, items_sql.SQL), (units.QUERIES, units.SQL), (extraction.QUERIES, extraction.SQL), (layers.QUERIES, layers.SQL), (repair.QUERIES, repair.SQL), (skeletons.QUERIES, skeletons.SQL), (details.QUERIES, details.SQL), (selected.QUERIES, selected.SQL), (training.QUERIES, training.SQL)]
FLAGSHIP = events.event_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for made, _ in MODULES for k, f in made.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for _, sql in MODULES for k, s in sql.items()}
