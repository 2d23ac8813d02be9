"""Local regression over dates."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import comb

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marketspark.functions.stats import t_quantile_975

FLAT = 10**12  # a fit whose determinant is this much below its weights' cube is not determined
_POWERS = 13  # the weight has degree 9, a fit needs its first four moments


class _Days:
    """Days of a calendar with the sums of their rows, in whole numbers.

    The tricube weight is a polynomial on each side of an anchor, so a fit needs power sums over two
    ranges of days, which are differences of running power sums. Those of high powers would cancel in
    floating point. Days are whole numbers, and so are anchors and bandwidths in units of
    1 / (grid - 1) day; the sums of values are rounded to 60 bits of the largest one. All sums are
    then exact integers, and a fit is rounded once.
    """

    def __init__(self, x: list[int], n: list[int], sy: list[float], unit: int):
        self.first, self.unit = x[0], unit
        self.x = [unit * (day - x[0]) for day in x]
        largest = max((abs(v) for v in sy), default=0.0) or 1.0
        self.scale = largest / (1 << 60)
        values = [round(v / self.scale) for v in sy]
        self.rows = [0, *accumulate(n)]
        self.counts = [[0, *accumulate(c * at**k for c, at in zip(n, self.x))] for k in range(2 * _POWERS - 3)]
        self.sums = [[0, *accumulate(v * at**k for v, at in zip(values, self.x))] for k in range(_POWERS - 1)]

    def bandwidth(self, at: int, wanted: int) -> int:
        """Distance to the ``wanted``-th nearest row."""
        low, high = 0, self.x[-1]
        while low < high:
            mid = (low + high) // 2
            held = self.rows[bisect_right(self.x, at + mid)] - self.rows[bisect_left(self.x, at - mid)]
            low, high = (low, mid) if held >= wanted else (mid + 1, high)
        return low

    @staticmethod
    def moments(running: list[list[int]], begin: int, end: int, at: int) -> list[int]:
        """Power sums about ``at`` of the days from ``begin`` to before ``end``."""
        plain = [sums[end] - sums[begin] for sums in running]
        shift = [(-at) ** k for k in range(len(plain))]
        return [sum(comb(j, k) * shift[j - k] * plain[k] for k in range(j + 1)) for j in range(len(plain))]

    def weighed(self, running: list[list[int]], ranges, at: int, h: int, power: int, count: int) -> list[int]:
        """Sums of weight^(power / 3) u^k for k < ``count``, times h^(3 power + 4)."""
        out = [0] * count
        scale = [h ** (3 * power + 4 - k) for k in range(3 * power + count)]
        for side, begin, end in ranges:
            about = self.moments(running[: 3 * power + count], begin, end, at)
            for k in range(count):
                out[k] += sum(comb(power, m) * (-side) ** m * about[3 * m + k] * scale[3 * m + k] for m in range(power + 1))
        return out

    def fit(self, at: int, span: float) -> tuple[float, float, float] | None:
        """Value at ``at``, squared norm of its smoother row, weight of a row there; None if not determined."""
        h = self.bandwidth(at, int(self.rows[-1] * span + 1e-5))
        if not h:
            return None
        middle = bisect_right(self.x, at)
        ranges = [(-1, bisect_right(self.x, at - h), middle), (1, middle, bisect_left(self.x, at + h))]
        s = self.weighed(self.counts, ranges, at, h, 3, 5)
        t = self.weighed(self.sums, ranges, at, h, 3, 3)
        v = self.weighed(self.counts, ranges, at, h, 6, 5)
        a0, a1, a2 = s[2] * s[4] - s[3] * s[3], s[2] * s[3] - s[1] * s[4], s[1] * s[3] - s[2] * s[2]
        det = s[0] * a0 + s[1] * a1 + s[2] * a2
        if det * FLAT <= s[0] ** 3:
            return None
        norm2 = a0 * a0 * v[0] + 2 * a0 * a1 * v[1] + (a1 * a1 + 2 * a0 * a2) * v[2] + 2 * a1 * a2 * v[3] + a2 * a2 * v[4]
        # s and t carry h^13 and v h^22: det has 39 of those powers, a 26, norm2 74.
        unit = h**13
        return (a0 * t[0] + a1 * t[1] + a2 * t[2]) / det * self.scale, norm2 * unit * unit / (det * det * h**22), a0 * unit / det


def loess(
    df: DataFrame,
    day: str,
    y: str,
    span: float = 0.75,
    grid: int = 80,
    band: bool = True,
) -> DataFrame:
    """Local quadratic fit with tricube weights on an even grid: (x, fitted[, lower, upper]).

    ``x`` counts days. Rows of one day share their weight, so they collapse to (n, sum y, sum y²)
    first, and everything after that is bounded by the calendar: one row per day goes to the driver
    and to the tasks, which fit the anchors from running power sums. The bandwidth of a grid point is
    the distance to its ``floor(span * n)``-th nearest row; a point whose bandwidth is zero, or whose
    window does not determine a fit, is left out. The band needs the fit on every day for the
    residual variance; its degrees of freedom are the trace of (I - L)(I - L)'.
    """
    spark = df.sparkSession
    value = F.col(y).cast("double")
    points = (
        df.filter(F.col(day).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.unix_date(day).alias("x"))
        .agg(F.count("*").alias("n"), F.sum(value).alias("sy"), F.sum(value * value).alias("sy2"))
        .toPandas()  # one row per calendar day
        .sort_values("x")
    )
    days = [points[c].tolist() for c in ("x", "n", "sy")]
    shared = spark.sparkContext.broadcast(days)
    unit = max(grid - 1, 1)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calendar = None
        for batch in batches:
            calendar = calendar or _Days(*shared.value, unit)
            found = [(at, *row) for at in batch["at"].tolist() if (row := calendar.fit(at, span))]
            yield pd.DataFrame(found, columns=["at", "fitted", "norm2", "own"])

    def fits(anchors: list[int]) -> DataFrame:
        at = spark.createDataFrame([(a,) for a in anchors], "at long").repartition(spark.sparkContext.defaultParallelism)
        return at.mapInPandas(fit, "at long, fitted double, norm2 double, own double")

    first, last = (days[0][0], days[0][-1]) if len(points) else (0, 0)
    curve = fits([(last - first) * g for g in range(grid)] if len(points) else []).select(
        (F.lit(float(first)) + F.col("at") / unit).alias("x"), "fitted", "norm2"
    )
    if not band:
        return curve.select("x", "fitted")
    sums = spark.createDataFrame(points.assign(at=(points["x"] - first) * unit), "x int, n long, sy double, sy2 double, at long")
    residuals = sums.join(fits([unit * (x - first) for x in days[0]]), "at").agg(
        F.sum(F.col("sy2") - 2 * F.col("fitted") * F.col("sy") + F.col("n") * F.col("fitted") * F.col("fitted")).alias("rss"),
        (F.sum("n") - 2 * F.sum(F.col("n") * F.col("own")) + F.sum(F.col("n") * F.col("norm2"))).alias("free"),
    )
    half = (
        t_quantile_975(F.floor("free"))
        * F.sqrt(F.col("rss") / F.nullif(F.col("free"), F.lit(0.0)))
        * F.sqrt("norm2")
    )
    return curve.crossJoin(F.broadcast(residuals)).select(  # one row
        "x", "fitted", (F.col("fitted") - half).alias("lower"), (F.col("fitted") + half).alias("upper")
    )
