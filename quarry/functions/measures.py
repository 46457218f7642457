"""Aggregates that give the same result in any order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: str | Column) -> Column:
    """Exact sum of money, as a double."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def mean(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.sum(c.cast("decimal(18,2)")).cast("double") / F.count(c), 4)


def count(c: str | Column = "*") -> Column:
    return F.count(c)


def names(c: str | Column) -> Column:
    """Distinct values in order, joined by a bar."""
    return F.array_join(F.array_sort(F.collect_set(c)), "|")


def total_sql(c: str) -> str:
    return f"sum(cast({c} as decimal(18,2)))::double"


def mean_sql(c: str) -> str:
    return f"round(sum(cast({c} as decimal(18,2)))::double / count({c}), 4)"


def names_sql(c: str) -> str:
    return f"string_agg(distinct {c}, '|' order by {c})"
