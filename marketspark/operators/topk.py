"""Record lists that keep ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def top_with_ties(df: DataFrame, column: str, n: int, largest: bool = True) -> DataFrame:
    """Rows whose value reaches the n-th largest (smallest) one; nulls are never selected.

    The n-th value comes from a per-partition top n, so nothing is sorted globally.
    """
    known = df.filter(F.col(column).isNotNull())
    order = F.col(column).desc() if largest else F.col(column).asc()
    edge = known.select(column).orderBy(order).limit(n)
    if largest:
        return known.filter(F.col(column) >= edge.agg(F.min(column).alias("edge")).scalar())
    return known.filter(F.col(column) <= edge.agg(F.max(column).alias("edge")).scalar())


def group_peaks(
    df: DataFrame, groups: Sequence[str], column: str, calendar_groups: bool = False
) -> DataFrame:
    """Rows at the maximum of their group, ties kept; the maxima combine map-side.

    ``calendar_groups``: the groups are years or months, so their maxima can be broadcast and the
    rows stay where they are. Otherwise the optimizer decides from the size it sees.
    """
    peaks = df.groupBy(*groups).agg(F.max(column).alias("peak")).filter(F.col("peak").isNotNull())
    if calendar_groups:
        peaks = F.broadcast(peaks)
    return df.join(peaks, list(groups)).filter(F.col(column) == F.col("peak")).drop("peak")
