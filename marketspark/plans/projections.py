"""Year-end projections from the lines through each year's running totals."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.operators.regression import ols, predict
from marketspark.plans.reports import last_sale_day, sale_counter, value_by_year


def value_models(listings: DataFrame) -> DataFrame:
    """Line of the running amount on the day of the year, per sale year."""
    return ols(value_by_year(listings), ["sale_year"], "market_value", "day_of_year")


def value_days(listings: DataFrame) -> Column:
    """The days to score: the first of the year and the median last sale day."""
    return F.array(F.lit(1.0), last_sale_day(listings).scalar())


def sale_count_models(listings: DataFrame) -> DataFrame:
    return ols(sale_counter(listings), ["sale_year"], "sale_count", "day_of_year")


def score(models: DataFrame, days: Column) -> DataFrame:
    """Each year's line at each of an array of days."""
    return predict(models.withColumn("day_of_year", F.explode(days)), "day_of_year")


def value_scores(listings: DataFrame) -> DataFrame:
    return score(value_models(listings), value_days(listings))


def sale_count_scores(listings: DataFrame, days: tuple[int, ...]) -> DataFrame:
    return score(sale_count_models(listings), F.array(*[F.lit(d) for d in days]))


def year_end(models: DataFrame, days: Column) -> DataFrame:
    """Each year's line at the last of the days, next to its highest running value ``y_max``."""
    return predict(models.withColumn("day_of_year", F.array_max(days)), "day_of_year")


def year_end_range(listings: DataFrame, days: tuple[int, ...], as_of: date) -> DataFrame:
    """Expected range of the running year: value in millions and number of sales."""
    this_year = F.col("sale_year") == as_of.year
    money_end = year_end(value_models(listings), value_days(listings)).filter(this_year).select(
        "sale_year",
        F.bround(F.col("lower") / 1e6, 1).alias("value_lower"),
        F.bround(F.col("upper") / 1e6, 1).alias("value_upper"),
    )
    count_end = year_end(sale_count_models(listings), F.array(F.lit(max(days)))).filter(this_year).select(
        "sale_year",
        F.floor("lower").alias("sales_lower"),
        F.ceil("upper").alias("sales_upper"),
    )
    return money_end.join(count_end, "sale_year")


def actual_and_predicted(models: DataFrame, days: Column, as_of: date) -> DataFrame:
    """Each year's highest running total next to its line at the last day."""
    return year_end(models, days).select(
        "sale_year",
        F.col("y_max").alias("actual"),
        "fitted",
        "lower",
        "upper",
        (F.col("sale_year") != F.lit(as_of.year)).alias("predicted"),
    )


def money(column: str) -> Column:
    """Dollars as millions."""
    return F.col(column).cast("double") / 1e6
