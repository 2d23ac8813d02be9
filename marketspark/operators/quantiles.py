"""Exact quantiles of columns with any number of distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.operators.ordered import order_slices


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join in which a null key matches a null key."""
    if not keys:
        return left.crossJoin(right)  # both sides are one row: the only group
    renamed = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    )
    return left.join(renamed, match, how).drop(*[f"{k}__r" for k in keys])


def exact_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    slices: int | None = None,
    calendar_groups: bool = False,
) -> DataFrame:
    """Quantiles with linear interpolation per group, one column per entry of ``probs``.

    ``percentile`` keeps a map of every distinct value of a group in one task. Here equal values
    collapse first, value slices are counted, and only the slices that hold a wanted rank are
    sorted. Nulls carry no weight; a group without any value gives null. ``calendar_groups``: the
    groups are years or months, so the slices to look into can be broadcast.
    """
    groups = list(groups)
    counted = df.groupBy(*groups, value).agg(F.count(value).alias("n"))
    # The sample reads `n` too, so all three uses of `counted` share one shuffle of the input.
    sliced = order_slices(counted, value, slices, sample=F.when(F.col("n") > 0, F.col(value)))
    per_slice = sliced.groupBy(*groups, "order_slice").agg(F.sum("n").alias("n"))
    by_slice = Window.partitionBy(*groups).orderBy("order_slice")
    whole = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    until = by_slice.rowsBetween(Window.unboundedPreceding, 0)
    # At most `slices` rows per group.
    placed = per_slice.select(
        *groups,
        "order_slice",
        F.sum("n").over(whole).alias("total"),
        (F.sum("n").over(until) - F.col("n")).alias("start"),
        F.sum("n").over(until).alias("stop"),
    )
    ranks: dict[str, tuple[Column, Column, Column]] = {}
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        ranks[name] = (F.floor(at), F.ceil(at), at - F.floor(at))
    wanted_here = reduce(
        lambda a, b: a | b,
        [
            (F.col("start") <= rank) & (rank < F.col("stop"))
            for low, high, _ in ranks.values()
            for rank in (low, high)
        ],
    )
    wanted = placed.filter(wanted_here)
    if calendar_groups:
        wanted = F.broadcast(wanted)  # at most two slices per quantile and group
    inside = same_keys(sliced, wanted, groups + ["order_slice"], "inner")
    by_value = (
        Window.partitionBy(*groups, "order_slice")
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    stepped = inside.withColumn("stop", F.col("start") + F.sum("n").over(by_value)).withColumn(
        "start", F.col("stop") - F.col("n")
    )
    picks = []
    for name, (low, high, _) in ranks.items():
        for end, rank in (("low", low), ("high", high)):
            hit = (F.col("start") <= rank) & (rank < F.col("stop"))
            picks.append(F.min(F.when(hit, F.col(value))).cast("double").alias(f"{name}__{end}"))
    picks.append(F.first("total").alias("total"))
    found = stepped.groupBy(*groups).agg(*picks)
    quantiles = found.select(
        *groups,
        *[
            (
                F.col(f"{name}__low")
                + (F.col(f"{name}__high") - F.col(f"{name}__low")) * fraction
            ).alias(name)
            for name, (_, _, fraction) in ranks.items()
        ],
    )
    if not groups:
        return quantiles
    return same_keys(per_slice.select(*groups).distinct(), quantiles, groups, "left")


def small_domain_median(value: str | Column) -> Column:
    """Median of a column of few distinct values, such as days: its value map is bounded."""
    column = F.col(value) if isinstance(value, str) else value
    return F.percentile(column.cast("double"), F.lit(0.5))
