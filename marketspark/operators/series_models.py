"""Autoregression, smoothing and boosted trees of many monthly series, chosen per series.

Series come as (``key``, ``month``, ``value``) with one row per month and need not be free of gaps.
A month is a row, so a series is small whatever table is behind it; all series are fitted at once,
spread by key. Results are (``key``, ``month``, ``actual``, ``predicted``) with a null actual on the
months after the last one, as in ``forecast``. Keys must not be null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.operators.reshape import map_groups
from marketspark.operators.sweep import nested_fits

SEASON = 12
MOST_DIFFERENCES = 2
KPSS_5 = 0.463  # critical value of the test for a level series at 5 %
NOISE = 1e-20  # a variance below this share of the mean square is rounding
ALPHAS = (0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95)
BETAS = (0.02, 0.1, 0.3, 0.5, 0.8)
GAMMAS = (0.02, 0.1, 0.3, 0.5, 0.8)
NORMAL_95 = 1.959964


def gap_free(series: DataFrame, key: str) -> DataFrame:
    """(key, i, month, value, filled): every month from the first to the last value.

    ``filled`` puts a missing month on the line between its neighbours.
    """
    known = series.filter(F.col("value").isNotNull()).select(key, "month", F.col("value").cast("double").alias("value"))
    span = known.groupBy(key).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    months = span.select(key, F.posexplode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("i", "month"))
    in_order = Window.partitionBy(key).orderBy("i")
    upto, onward = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.struct("i", "value"))
    full = months.join(known, [key, "month"], "left").withColumns(
        {"left": F.last(at, ignorenulls=True).over(upto), "right": F.first(at, ignorenulls=True).over(onward)}
    )
    share = (F.col("i") - F.col("left.i")) / (F.col("right.i") - F.col("left.i"))
    between = F.col("left.value") + (F.col("right.value") - F.col("left.value")) * share
    return full.select(key, "i", "month", "value", F.coalesce("value", between).alias("filled"))


def differences(spine: DataFrame, key: str) -> DataFrame:
    """(key, i, month, d, z): the series differenced d times, for d up to ``MOST_DIFFERENCES``."""
    in_order = Window.partitionBy(key).orderBy("i")
    x, one, two = F.col("filled"), F.lag("filled", 1).over(in_order), F.lag("filled", 2).over(in_order)
    forms = [x, x - one, x - 2 * one + two]
    named = spine.withColumns({f"z{d}": z for d, z in enumerate(forms)})
    stacked = F.array(*[F.struct(F.lit(d).alias("d"), F.col(f"z{d}").alias("z")) for d in range(len(forms))])
    return named.select(key, "i", "month", F.inline(stacked)).filter(F.col("z").isNotNull())


def kpss(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, n, kpss): test statistic for a level series; null if the series does not vary.

    Squared partial sums of the deviations over their long-run variance, with Bartlett weights on
    floor(3 sqrt(n) / 13) autocovariances.
    """
    lists = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value)))[value].alias("z"))
    add = lambda a, v: a + v
    total = lambda values: F.aggregate(values, F.lit(0.0), add)
    n, lags = F.size("z"), F.floor(3 * F.sqrt(F.size("z").cast("double")) / 13).cast("int")
    centred = lists.select(*keys, n.alias("n"), lags.alias("lags"), F.expr("transform(z, v -> v - aggregate(z, 0D, (a, b) -> a + b) / size(z))").alias("e"), total(F.transform("z", lambda v: v * v)).alias("square"))
    partial = F.aggregate(
        "e",
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q")),
        lambda a, v: F.struct((a["s"] + v).alias("s"), (a["q"] + (a["s"] + v) * (a["s"] + v)).alias("q")),
    )["q"]
    weight = lambda lag: F.when(lag == 0, 1.0).otherwise(2.0 * (1 - lag / (F.col("lags") + 1)))
    product = lambda lag: total(F.zip_with(F.slice("e", lag + 1, F.col("n")), F.slice("e", F.lit(1), F.col("n") - lag), lambda a, b: a * b))
    long_run = F.aggregate(F.sequence(F.lit(0), F.least("lags", F.col("n") - 1)), F.lit(0.0), lambda a, lag: a + weight(lag) * product(lag))
    moments = centred.select(*keys, "n", "square", partial.alias("q"), long_run.alias("long_run"))
    varies = F.col("long_run") > NOISE * F.col("square")
    return moments.select(*keys, "n", "square", F.when(varies, F.col("q") / (F.col("n") * F.col("long_run"))).alias("kpss"))


def chosen_differences(rows: DataFrame, key: str) -> DataFrame:
    """(key, d): the fewest differences after which the series passes for level."""
    tests = kpss(rows, [key, "d"], "i", "z")
    # Differences of rounding errors do not vary: compare with the series itself.
    level = F.max(F.when(F.col("d") == 0, F.col("square")))
    passed = F.col("kpss").isNull() | (F.col("kpss") <= KPSS_5) | (F.col("square") <= NOISE * F.col("level"))
    scaled = tests.withColumn("level", level.over(Window.partitionBy(key)))
    return scaled.groupBy(key).agg(F.coalesce(F.min(F.when(passed, F.col("d"))), F.max("d")).alias("d"))


def autoregression_models(spine: DataFrame, key: str, most: int = 5) -> DataFrame:
    """One row per series: differences, order, constant, ``phi`` (zero beyond the order), AICc.

    The cross products of a row with all its lags are one grouped sum; the orders are nested, so a
    sweep of one lag after the other gives every fit. Series differenced twice have no constant.
    All orders are compared on the rows that have all lags; without such a row the mean is the model.
    """
    stacked = differences(spine, key)
    picked = stacked.join(chosen_differences(stacked, key), [key, "d"])
    in_order = Window.partitionBy(key).orderBy("i")
    mean = F.when(F.col("d") < 2, F.avg("z").over(Window.partitionBy(key))).otherwise(0.0)
    rows = picked.withColumns({"mean": mean, **{f"lag{k}": F.lag("z", k).over(in_order) for k in range(1, most + 1)}})
    terms = [F.when(F.col("d") < 2, 1.0).otherwise(0.0), *(F.col(f"lag{k}") - F.col("mean") for k in range(1, most + 1)), F.col("z") - F.col("mean")]
    complete = F.col(f"lag{most}").isNotNull()
    sums = [F.array(*[F.coalesce(F.sum(F.when(complete, a * b)), F.lit(0.0)) for b in terms]) for a in terms]
    square = F.avg(F.col("z") * F.col("z"))
    grouped = rows.groupBy(key, "d").agg(F.first("mean").alias("mean"), F.count_if(complete).cast("double").alias("n"), square.alias("square"), F.array(*sums).alias("products"))
    fits = grouped.withColumn("fits", nested_fits("products", most + 1))
    size = lambda p: p + 1.0 + F.when(F.col("d") < 2, 1.0).otherwise(0.0)

    def scored(fit: Column, p: Column) -> Column:
        k, n = size(p), F.col("n")
        spread = F.greatest(fit["rss"] / n, NOISE * F.col("square"), F.lit(1e-300))
        aicc = n * F.log(spread) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        return F.struct(F.when(n - k - 1 > 0, aicc).otherwise(float("inf")).alias("aicc"), p.alias("order"), fit["beta"].alias("beta"))

    best = fits.withColumn("best", F.array_min(F.transform("fits", scored)))
    none = F.isnan("best.aicc") | (F.col("best.aicc") == float("inf"))
    beta = F.when(none, F.array_repeat(F.lit(0.0), most + 1)).otherwise(F.col("best.beta"))
    ready = best.select(key, "d", "mean", F.when(none, 0).otherwise(F.col("best.order")).alias("order"), F.when(~none, F.col("best.aicc")).alias("aicc"), beta.alias("beta"))
    phi = F.slice("beta", 2, most)
    held = 1 - F.aggregate(phi, F.lit(0.0), lambda a, v: a + v)
    return ready.select(
        key, F.col("d").alias("differences"), "order", (F.col("beta")[0] + F.col("mean") * held).alias("constant"), phi.alias("phi"), "aicc"
    )


def autoregression(spine: DataFrame, models: DataFrame, key: str, months: int = 24, most: int = 5) -> DataFrame:
    """One-step predictions on the months of the spine and forecasts after them.

    ``most`` is that of ``models``. Differences are undone: the forecast of a differenced series is
    added up from the last value.
    """
    in_order = Window.partitionBy(key).orderBy("i")
    x, before, before2 = F.col("filled"), F.lag("filled", 1).over(in_order), F.lag("filled", 2).over(in_order)
    base = F.when(F.col("differences") == 0, 0.0).when(F.col("differences") == 1, before).otherwise(2 * before - before2)
    rows = spine.join(models, key).withColumns({"base": base, "step": x - before}).withColumn("z", x - F.col("base"))
    past = [F.lag("z", k).over(in_order) for k in range(1, most + 1)]
    lagged = rows.withColumn("past", F.array(*past))
    used = F.slice("phi", F.lit(1), F.col("order"))
    weighed = F.zip_with(used, F.slice("past", F.lit(1), F.col("order")), lambda a, b: a * b)
    step_ahead = F.col("constant") + F.aggregate(weighed, F.lit(0.0), lambda a, v: a + v)
    fitted = lagged.select(key, "month", F.col("value").alias("actual"), (F.col("base") + step_ahead).alias("predicted"))

    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("i").desc()))
    last = lagged.withColumn("newest", newest).filter("newest = 1")
    history = F.concat(F.array("z"), "past")
    start = F.struct(
        F.transform(history, lambda v: F.coalesce(v, F.lit(0.0))).alias("z"),
        F.col("filled").alias("level"), F.coalesce("step", F.lit(0.0)).alias("step"), F.array().cast("array<double>").alias("out"),
    )

    def move(state: Column, _: Column) -> Column:
        z = F.col("constant") + F.aggregate(F.zip_with(used, F.slice(state["z"], F.lit(1), F.col("order")), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        step = F.when(F.col("differences") == 2, state["step"] + z).otherwise(z)
        level = F.when(F.col("differences") == 0, z).otherwise(state["level"] + step)
        return F.struct(
            F.concat(F.array(z), F.slice(state["z"], 1, most)).alias("z"), level.alias("level"), step.alias("step"), F.concat(state["out"], F.array(level)).alias("out")
        )

    ahead = F.aggregate(F.sequence(F.lit(1), F.lit(months)), start, move)["out"]
    future = last.select(key, "month", F.posexplode(ahead).alias("k", "predicted")).select(
        key, F.add_months("month", F.col("k") + 1).alias("month"), F.lit(None).cast("double").alias("actual"), "predicted"
    )
    return fitted.unionByName(future)


def _candidates() -> list[tuple[bool, int, np.ndarray]]:
    """Per form: trend, season, and its weights (alpha, beta, gamma) as rows."""
    forms = []
    for trend, season in ((False, 0), (True, 0), (False, SEASON), (True, SEASON)):
        grid = [(a, b, g) for a in ALPHAS for b in (BETAS if trend else (0.0,)) for g in (GAMMAS if season else (0.0,))]
        forms.append((trend, season, np.array(grid)))
    return forms


def _start(filled: np.ndarray, trend: bool, season: int) -> tuple[float, float, np.ndarray]:
    if not season:
        reach = min(len(filled), SEASON) - 1
        return filled[0], (filled[reach] - filled[0]) / max(reach, 1) if trend else 0.0, np.zeros(SEASON)
    level = filled[:season].mean()
    return level, (filled[season : 2 * season].mean() - level) / season if trend else 0.0, filled[:season] - level


def _pass(y: np.ndarray, filled: np.ndarray, trend: bool, season: int, weights: np.ndarray):
    """All weights at once over the series: squared errors, one-step predictions, last states.

    A missing month has no error: level and trend move on.
    """
    alpha, beta, gamma = weights.T
    first_level, first_trend, first_season = _start(filled, trend, season)
    level, slope = np.full(len(alpha), first_level), np.full(len(alpha), first_trend)
    seasonal = np.tile(first_season, (len(alpha), 1))
    squares, fitted = np.zeros(len(alpha)), np.empty((len(y), len(alpha)))
    for i, value in enumerate(y):
        fitted[i] = level + slope + seasonal[:, i % SEASON]
        error = np.zeros(len(alpha)) if np.isnan(value) else value - fitted[i]
        level = level + slope + alpha * error
        slope = slope + alpha * beta * error
        seasonal[:, i % SEASON] += gamma * (1 - alpha) * error
        squares += error * error
    return squares, fitted, level, slope, seasonal


def _smoothed(pdf: pd.DataFrame, months: int) -> pd.DataFrame:
    pdf = pdf.sort_values("i")
    y, filled = pdf["value"].to_numpy(float), pdf["filled"].to_numpy(float)
    n, observed, ahead = len(y), int((~np.isnan(y)).sum()), np.arange(1, months + 1)
    best = None
    for trend, season, weights in _candidates():
        size = 2 + 2 * trend + (season + 1 if season else 0)
        if observed < size + 3 or n < 2 * season:
            continue
        squares, fitted, level, slope, seasonal = _pass(y, filled, trend, season, weights)
        at = int(np.argmax(squares <= squares.min() * (1 + 1e-9)))  # the first of those that tie
        spread = max(squares[at] / observed, NOISE * (filled**2).mean(), 1e-300)
        aicc = observed * np.log(spread) + 2 * size + 2 * size * (size + 1) / (observed - size - 1)
        if best is None or aicc < best[0]:
            alpha, beta, gamma = weights[at]
            steps = ahead[:-1]
            effect = alpha + alpha * beta * steps + gamma * (1 - alpha) * (steps % SEASON == 0)
            variance = squares[at] / (observed - size) * (1 + np.concatenate([[0.0], np.cumsum(effect**2)]))
            best = (aicc, fitted[:, at], level[at] + slope[at] * ahead + seasonal[at, (n + ahead - 1) % SEASON], NORMAL_95 * np.sqrt(variance), weights[at], trend, bool(season))
    mean = np.nanmean(y)
    _, fitted, forecast, half, weights, trend, season = best or (0, np.full(n, mean), np.full(months, mean), np.full(months, np.nan), np.full(3, np.nan), False, False)
    last = pd.Timestamp(pdf["month"].iloc[-1])
    dates = [(last + pd.DateOffset(months=int(k))).date() for k in ahead]
    none = np.full(n, np.nan)
    return pd.DataFrame(
        {
            pdf.columns[0]: pdf.iloc[0, 0], "month": [*pdf["month"], *dates], "actual": np.concatenate([y, np.full(months, np.nan)]),
            "predicted": np.concatenate([fitted, forecast]), "lower": np.concatenate([none, forecast - half]), "upper": np.concatenate([none, forecast + half]),
            "trend": trend, "season": season, "alpha": weights[0], "beta": weights[1], "gamma": weights[2],
        }
    )


def smoothing(spine: DataFrame, key: str, months: int = 24) -> DataFrame:
    """Additive exponential smoothing with 95 % intervals of its forecasts.

    Form (trend, season or neither) by corrected AIC, weights by least squares over a fixed grid, all
    of it as one vector in a single pass over the months. ``lower`` and ``upper`` come from the
    variance of an h-step forecast of the state form; (``alpha``, ``beta``, ``gamma``) are the weights.
    """
    kind = spine.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, month date, actual double, predicted double, lower double, upper double, trend boolean, season boolean, alpha double, beta double, gamma double"
    found = map_groups(spine.select(key, "i", "month", "value", "filled"), [key], lambda pdf: _smoothed(pdf, months), schema)
    known = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return found.select(key, "month", *(known(c) for c in ("actual", "predicted", "lower", "upper")), "trend", "season", *(known(c) for c in ("alpha", "beta", "gamma")))


def _best_splits(residual, weight, node, bins, nodes: int, widths: list[int], least: int) -> list[tuple[int, int] | None]:
    """Per node the (feature, last bin to the left) that lowers squared error most; the first of those that tie."""
    scores, cuts = [], []
    for feature, width in enumerate(widths):
        cell = node * width + bins[feature]
        sums = np.bincount(cell, residual * weight, nodes * width).reshape(nodes, width).cumsum(1)
        counts = np.bincount(cell, weight, nodes * width).reshape(nodes, width).cumsum(1)
        left, n_left = sums[:, :-1], counts[:, :-1]
        right, n_right = sums[:, -1:] - left, counts[:, -1:] - n_left
        enough = (n_left >= least) & (n_right >= least)
        gain = np.where(enough, left**2 / np.maximum(n_left, 1) + right**2 / np.maximum(n_right, 1), -np.inf)
        scores.append(gain)
        cuts += [(feature, cut) for cut in range(width - 1)]
    scores = np.concatenate(scores, 1)
    top = scores.max(1, keepdims=True)
    first = np.argmax(scores >= top - 1e-9 * np.abs(top), 1)
    return [cuts[at] if np.isfinite(top[k, 0]) else None for k, at in enumerate(first)]


def _boosted(pdf: pd.DataFrame, rounds: int, rate: float, depth: int, bins: int, least: int) -> np.ndarray:
    """Sum of the trees on every row; rows without a residual only get a prediction."""
    weight = pdf["residual"].notna().to_numpy(float)
    target = np.nan_to_num(pdf["residual"].to_numpy(float))
    features, widths = [pdf["t_bin"].to_numpy(), pdf["season"].to_numpy() - 1], [bins, SEASON]
    predicted = np.zeros(len(pdf))
    for _ in range(rounds):
        residual, node = target - predicted, np.zeros(len(pdf), int)
        for level in range(depth):
            splits = _best_splits(residual, weight, node, features, 2**level, widths, least)
            right = np.zeros(len(pdf), int)
            for k, split in enumerate(splits):
                if split is not None:
                    right = np.where((node == k) & (features[split[0]] > split[1]), 1, right)
            node = 2 * node + right
        sums, counts = np.bincount(node, residual * weight, 2**depth), np.bincount(node, weight, 2**depth)
        predicted = predicted + rate * (sums / np.maximum(counts, 1))[node]
    return predicted


def boosted_residuals(
    base: DataFrame, key: str, rounds: int = 15, rate: float = 0.1, depth: int = 2, bins: int = 16, least: int = 2
) -> DataFrame:
    """``base`` (key, month, actual, predicted) improved by boosted trees on its residuals.

    One model per key, however many keys there are. A tree grows level by level: the residuals'
    sums per node and bin of each feature (time in ``bins`` equal spans of the months with a
    residual, calendar month) give the split that lowers squared error most, with ``least`` rows on
    each side. Later months fall into the last span.
    """
    residual = F.col("actual") - F.col("predicted")
    whole = Window.partitionBy(key)
    day = F.unix_date("month").cast("double")
    known = F.when(residual.isNotNull(), day)
    first, last = F.min(known).over(whole), F.max(known).over(whole)
    span = F.coalesce(F.floor((day - first) * bins / F.nullif(last - first, F.lit(0.0))), F.lit(0))
    rows = base.select(
        key, "month", "actual", "predicted", residual.alias("residual"), F.month("month").alias("season"),
        F.least(F.greatest(span, F.lit(0)), F.lit(bins - 1)).cast("int").alias("t_bin"),
    )
    schema = f"{key} {base.schema[key].dataType.simpleString()}, month date, actual double, predicted double, correction double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        return pdf.assign(correction=_boosted(pdf, rounds, rate, depth, bins, least))[[key, "month", "actual", "predicted", "correction"]]

    fitted = map_groups(rows, [key], fit, schema)
    known_or_null = lambda c: F.when(~F.isnan(c), F.col(c))
    return fitted.select(key, "month", known_or_null("actual").alias("actual"), (known_or_null("predicted") + F.col("correction")).alias("predicted"))
