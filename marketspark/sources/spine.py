"""Date spines, anchors and literal grids."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def day_spine(bounds: DataFrame, lo: Column, hi: Column, name: str = "day") -> DataFrame:
    """Every day between two columns of a one-row table."""
    return bounds.select(F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias(name))


def month_spine(bounds: DataFrame, lo: Column, hi: Column, as_of: date, name: str = "date") -> DataFrame:
    """First of each month from ``lo`` to ``hi`` plus the as-of date, each date once."""
    months = F.sequence(F.trunc(lo, "MM"), F.trunc(hi, "MM"), F.expr("interval 1 month"))
    return bounds.select(
        F.explode(F.array_distinct(F.array_append(months, F.lit(as_of)))).alias(name)
    )


def event_anchors(df: DataFrame, columns: Sequence[str], as_of: date, name: str = "date") -> DataFrame:
    """Distinct non-null values of the given date columns plus the as-of date."""
    anchor = F.explode(F.array(*[F.col(c) for c in columns], F.lit(as_of))).alias(name)
    return df.select(anchor).filter(F.col(name).isNotNull()).distinct()


def literal_grid(spark: SparkSession, values: Sequence[float], name: str) -> DataFrame:
    """A fixed list of values as rows, generated inside the plan."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def stock_constants(spark: SparkSession, stock: dict[str, int]) -> DataFrame:
    """Stock per category from a parameter."""
    return spark.createDataFrame(sorted(stock.items()), "category string, stock int")
