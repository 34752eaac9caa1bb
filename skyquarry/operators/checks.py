"""Constraints as queries that list what breaks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(df: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose reference isn't null and isn't there."""
    keys = parent.select([F.col(p).alias(f"_{p}") for p in on.values()]).distinct()
    named = df.filter(" AND ".join(f"{c} IS NOT NULL" for c in on))
    return named.join(keys, [F.col(c) == F.col(f"_{p}") for c, p in on.items()], "left_anti")


def partly_there(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where some but not all of the columns are null."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return df.filter((n > 0) & (n < len(columns)))


def not_lower(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) != F.lower(column))


def outside(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(list(domain)))
