"""Every query of the deal engine by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.registry import ORACLES, QUERIES
from quarry.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("operators.analytics", "operators.listing", "operators.linking", "operators.gates", "operators.cleaning", "operators.upkeep", "operators.enrichment", "operators.extraction", "operators.filings", "operators.minting", "operators.pages", "operators.reports", "operators.notices", "operators.names", "sources.landed", "streaming.feeds")
for module in MODULES:
    import_module(f"quarry.{module}")


def queries() -> dict[str, Query]:
    return {name: (lambda spark, path, f=f: f(Tables(spark, path))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
