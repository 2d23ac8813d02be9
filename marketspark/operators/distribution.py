"""Distribution summaries: box plots and density curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from marketspark.operators.quantiles import exact_quantiles, same_keys
from marketspark.sources.snapshot import materialize

# Fixed values of the rule-of-thumb bandwidth.
BANDWIDTH_FACTOR = 0.9
IQR_TO_SD = 1.34


def box_stats(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR and the number of outliers per group.

    For values of few distinct levels (days): equal values collapse first.
    """
    levels = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    quartiles = levels.groupBy(*groups).agg(
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q")
    ).select(*groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return (
        levels.join(quartiles, list(groups))
        .groupBy(*groups, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
        )
    )


def box_outliers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """The rows beyond the whiskers; the limits are written first so that their size is known."""
    stats = materialize(box_stats(df, groups, value).select(*groups, "q1", "q3"), "box-limits")
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return (
        df.join(stats, list(groups))
        .filter((F.col(value) < F.col("q1") - reach) | (F.col(value) > F.col("q3") + reach))
        .drop("q1", "q3")
    )


def density(df: DataFrame, groups: Sequence[str], value: str, points: int = 512) -> DataFrame:
    """Gaussian kernel density on an even grid over the range of each group.

    Every value is shared between its two neighbours of ``points`` bins that reach four bandwidths
    past the data; bins combine map-side. The kernel then runs over bins, at most ``points`` squared
    pairs per group whatever the number of rows, and the curve is read off at the grid points by
    linear interpolation. Groups of fewer than two values have no curve.
    """
    groups = list(groups)
    known = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    quartiles = exact_quantiles(known, groups, value, {"q1": 0.25, "q3": 0.75})
    spread = known.groupBy(*groups).agg(
        F.count("*").alias("n"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
    ).filter(F.col("n") >= 2)
    width = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / IQR_TO_SD)
    fallback = F.when(F.col("sd") > 0, F.col("sd")).when(F.col("lo") != 0, F.abs("lo")).otherwise(1.0)
    frame = same_keys(spread, quartiles, groups, "inner").select(
        *groups,
        "n",
        "lo",
        "hi",
        (
            BANDWIDTH_FACTOR
            * F.when(width > 0, width).otherwise(fallback)
            * F.pow(F.col("n").cast("double"), F.lit(-0.2))
        ).alias("bw"),
    ).withColumns(
        {
            "start": F.col("lo") - 4 * F.col("bw"),
            "step": (F.col("hi") - F.col("lo") + 8 * F.col("bw")) / (points - 1),
        }
    )
    # One row per group, read three times below.
    frame = materialize(frame, "density-frame")
    at = (F.col(value) - F.col("start")) / F.col("step")
    bins = (
        same_keys(known.select(*groups, value), frame, groups, "inner")
        .withColumns({"bin": F.floor(at), "share": at - F.floor(at)})
        .select(
            *groups,
            "n",
            F.inline(
                F.array(
                    F.struct(F.col("bin"), (1 - F.col("share")).alias("w")),
                    F.struct((F.col("bin") + 1).alias("bin"), F.col("share").alias("w")),
                )
            ),
        )
        .groupBy(*groups, "bin")
        .agg((F.sum("w") / F.first("n")).alias("mass"))
    )
    knots = frame.withColumn("knot", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    offset = (F.col("knot") - F.col("bin")) * F.col("step") / F.col("bw")
    kernel = F.exp(-0.5 * offset * offset) / (F.col("bw") * math.sqrt(2 * math.pi))
    curve = same_keys(knots, bins, groups, "inner").groupBy(*groups, "knot").agg(
        F.sum(F.col("mass") * kernel).alias("height")
    )
    # At most `points` rows per group.
    along = Window.partitionBy(*groups).orderBy("knot")
    segments = curve.withColumn("next_height", F.lead("height").over(along))
    grid_value = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("grid_no") / (points - 1)
    grid = frame.withColumn(
        "grid_no", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    ).withColumn("grid", grid_value)
    position = (F.col("grid") - F.col("start")) / F.col("step")
    placed = grid.withColumns(
        {"knot": F.floor(position).cast("int"), "part": position - F.floor(position)}
    )
    return same_keys(placed, segments, groups + ["knot"], "inner").select(
        *groups,
        "grid_no",
        "grid",
        (F.col("height") + (F.col("next_height") - F.col("height")) * F.col("part")).alias("density"),
    )
