"""Models of many monthly series at once.

Every model takes (``key``, ``month``, ``value``), fits one model per key and returns
(``key``, ``month``, ``actual``, ``predicted``): fitted values on the observed months and forecasts,
with a null actual, on the months after them. A series has one row per month, so it is small
whatever the size of the listing table behind it; series are spread over tasks by key.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.operators.absorbed import absorbed_ols
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.regression import linear_form, multi_ols


def monthly_median(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Exact median of ``value`` per key and month."""
    rows = df.filter(F.col(day).isNotNull() & F.col(value).isNotNull()).select(
        key, F.trunc(day, "MM").alias("month"), F.col(value).alias("amount")
    )
    return exact_quantiles(rows, [key, "month"], "amount", {"value": 0.5})


def with_future(series: DataFrame, key: str, months: int) -> DataFrame:
    """The series plus a null value for each of the months after its last one."""
    last = series.groupBy(key).agg(F.max("month").alias("last"))
    ahead = F.sequence(F.add_months("last", 1), F.add_months("last", months), F.expr("interval 1 month"))
    future = last.select(key, F.explode(ahead).alias("month"))
    return series.select(key, "month", "value").unionByName(future, allowMissingColumns=True)


def _result(df: DataFrame, key: str, predicted: Column) -> DataFrame:
    return df.select(key, "month", F.col("value").alias("actual"), predicted.alias("predicted"))


def seasonal_trend(series: DataFrame, key: str, months: int = 24) -> DataFrame:
    """Linear trend plus one level per calendar month.

    The slope comes from deviations around the mean of each calendar month; a calendar month never
    observed has no prediction.
    """
    x = F.unix_date("month").cast("double")
    dated = series.filter(F.col("value").isNotNull()).withColumns({"x": x, "season": F.month("month")})
    levels = dated.groupBy(key, "season").agg(
        F.regr_sxx("value", "x").alias("sxx"),
        F.regr_sxy("value", "x").alias("sxy"),
        F.avg("x").alias("x_mean"),
        F.avg("value").alias("y_mean"),
    )
    slopes = levels.groupBy(key).agg(
        F.coalesce(F.sum("sxy") / F.nullif(F.sum("sxx"), F.lit(0.0)), F.lit(0.0)).alias("slope")
    )
    scored = (
        with_future(series, key, months)
        .withColumns({"x": x, "season": F.month("month")})
        .join(levels.select(key, "season", "x_mean", "y_mean"), [key, "season"], "left")
        .join(slopes, key)
    )
    return _result(scored, key, F.col("y_mean") + F.col("slope") * (F.col("x") - F.col("x_mean")))


def autoregressive(series: DataFrame, key: str, months: int = 24) -> DataFrame:
    """First-order autoregression on the previous observed month, forecast in closed form."""
    in_order = Window.partitionBy(key).orderBy("month")
    lagged = series.filter(F.col("value").isNotNull()).withColumn("before", F.lag("value").over(in_order))
    model = lagged.groupBy(key).agg(
        F.when(F.regr_sxx("value", "before") > 0, F.regr_slope("value", "before"))
        .otherwise(0.0)
        .alias("phi"),
        F.regr_avgx("value", "before").alias("before_mean"),
        F.regr_avgy("value", "before").alias("value_mean"),
        F.max_by("value", "month").alias("last_value"),
        F.max("month").alias("last"),
    ).withColumn("drift", F.col("value_mean") - F.col("phi") * F.col("before_mean"))
    steps = F.months_between("month", "last").cast("int")
    power = F.pow(F.col("phi"), steps.cast("double"))
    geometric = F.when(F.col("phi") == 1, steps.cast("double")).otherwise(
        (1 - power) / F.nullif(1 - F.col("phi"), F.lit(0.0))
    )
    ahead = power * F.col("last_value") + F.col("drift") * geometric
    scored = (
        with_future(series, key, months)
        .join(lagged.select(key, "month", "before"), [key, "month"], "left")
        .join(model, key)
    )
    one_step = F.col("drift") + F.col("phi") * F.col("before")
    return _result(scored, key, F.when(F.col("month") > F.col("last"), ahead).otherwise(one_step))


def _scaled_time(df: DataFrame, key: str) -> DataFrame:
    """Add ``t``: 0 at the first observed month of a series and 1 at its last."""
    span = df.filter(F.col("value").isNotNull()).groupBy(key).agg(
        F.min("month").alias("first"), F.max("month").alias("last")
    )
    length = F.nullif(F.datediff("last", "first"), F.lit(0))
    return (
        df.join(span, key)
        .withColumn("t", F.coalesce(F.datediff("month", "first") / length, F.lit(0.0)))
        .drop("first", "last")
    )


def _fit_terms(full: DataFrame, key: str, terms: list[str]) -> DataFrame:
    models = multi_ols(full.filter(F.col("value").isNotNull()), [key], "value", terms)
    return _result(full.join(models, key), key, linear_form(terms))


def fourier_trend(series: DataFrame, key: str, months: int = 24, harmonics: int = 3) -> DataFrame:
    """Linear trend plus yearly waves."""
    angle = 2 * math.pi * F.month("month") / 12
    waves = {}
    for k in range(1, harmonics + 1):
        waves[f"sin{k}"] = F.sin(angle * k)
        waves[f"cos{k}"] = F.cos(angle * k)
    full = _scaled_time(with_future(series, key, months), key).withColumns(
        {"one": F.lit(1.0), **waves}
    )
    return _fit_terms(full, key, ["one", "t", *waves])


def hinge_trend(series: DataFrame, key: str, months: int = 24) -> DataFrame:
    """Trend with a bend at each quartile of the observed months, plus calendar-month levels."""
    full = _scaled_time(with_future(series, key, months), key)
    knots = full.filter(F.col("value").isNotNull()).groupBy(key).agg(
        F.percentile("t", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("knots")
    )
    bends = {f"bend{i}": F.greatest(F.col("t") - F.col("knots")[i], F.lit(0.0)) for i in range(3)}
    levels = {f"month{k}": (F.month("month") == k).cast("double") for k in range(2, 13)}
    full = full.join(knots, key).withColumns({"one": F.lit(1.0), **bends, **levels})
    return _fit_terms(full, key, ["one", "t", *bends, *levels])


def model_table(models: dict[str, DataFrame]) -> DataFrame:
    """Fitted values and forecasts of several models under each other."""
    tagged = [df.withColumn("model", F.lit(name)) for name, df in models.items()]
    return reduce(DataFrame.unionByName, tagged)


def accuracy(table: DataFrame, keys: list[str]) -> DataFrame:
    """Error measures of each model over the observed months."""
    error = F.col("actual") - F.col("predicted")
    return (
        table.filter(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("months"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.avg(F.abs(error / F.nullif(F.col("actual"), F.lit(0.0)))).alias("mape"),
        )
    )


def categorical_ols(df: DataFrame, y: str, numbers: list[str], categories: list[str]) -> DataFrame:
    """Coefficients of ``y`` on numbers and categories; the first level of each is the base.

    The last category is absorbed: name the one of most levels there.
    """
    return absorbed_ols(df, y, numbers, categories[:-1], categories[-1])


def date_features(df: DataFrame, day: str) -> DataFrame:
    """Replace a date by month, day of week, year and its standardised number."""
    number = F.unix_date(day).cast("double")
    moments = df.agg(F.avg(number).alias("mean"), F.stddev_samp(number).alias("sd"))
    return (
        df.crossJoin(F.broadcast(moments))  # one row
        .withColumns(
            {
                f"{day}_month": F.month(day),
                f"{day}_dow": F.dayofweek(day),
                f"{day}_year": F.year(day),
                "date_num": (number - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0)),
            }
        )
        .drop(day, "mean", "sd")
    )
