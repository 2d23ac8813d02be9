"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def to_long(df: DataFrame, ids: Sequence[str], measures: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(measures), name, value)


def latest_date(df: DataFrame) -> DataFrame:
    """Latest value over every ``*_date`` column, as a one-row table."""
    columns = [c for c in df.columns if c.endswith("_date")]
    return to_long(df.select(*columns), [], columns, "kind", "date").agg(F.max("date").alias("date"))


def wide_difference(
    df: DataFrame, groups: Sequence[str], position: str, value: str, name: str
) -> DataFrame:
    """Value at position 2 minus value at position 1, one row per group."""
    at = [F.max(F.when(F.col(position) == k, F.col(value))) for k in (1, 2)]
    return df.groupBy(*groups).agg((at[1] - at[0]).alias(name))


def map_groups(
    df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply ``fn`` to each group as a pandas frame and stack the results.

    Each group is held by one task: aggregate first, so that a group is a series of months or the
    moments of a model and not the rows themselves.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def stack_params(df: DataFrame, name: str, values: Sequence[int], keep: Column) -> DataFrame:
    """Rows repeated once per parameter they belong to: ``keep`` may refer to the column ``name``."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values]))).filter(keep)
