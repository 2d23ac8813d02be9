"""Least squares as grouped aggregates: no model objects and no rows on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from marketspark.functions.dates import next_year_start
from marketspark.functions.stats import f_p_value, t_p_value, t_quantile_975
from marketspark.operators.enrich import recent
from marketspark.operators.ordered import null_poisoned_sum, running_sums
from marketspark.operators.quantiles import same_keys
from marketspark.operators.reshape import stack_params


def ols(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Straight line of ``y`` on ``x`` per group, one row of moments and estimates each.

    Rows with a null are left out. Without two distinct ``x`` there is no slope and the fit is the
    mean. The moments combine map-side, so a group of any size shuffles one row per task.
    """
    yd, xd = F.col(y).cast("double"), F.col(x).cast("double")
    moments = (
        df.filter(F.col(y).isNotNull() & F.col(x).isNotNull())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("nobs"),
            F.regr_avgx(yd, xd).alias("x_mean"),
            F.regr_avgy(yd, xd).alias("y_mean"),
            F.regr_sxx(yd, xd).alias("sxx"),
            F.regr_sxy(yd, xd).alias("sxy"),
            F.regr_syy(yd, xd).alias("syy"),
            F.max(yd).alias("y_max"),
        )
        .filter(F.col("nobs") > 0)
    )
    has_slope = (F.col("nobs") >= 2) & (F.col("sxx") > 0)
    fitted = moments.withColumn("slope", F.when(has_slope, F.col("sxy") / F.col("sxx")))
    flat = F.coalesce("slope", F.lit(0.0))
    residual = F.greatest(F.col("syy") - flat * F.col("sxy"), F.lit(0.0))
    return fitted.withColumns(
        {
            "intercept": F.col("y_mean") - flat * F.col("x_mean"),
            "df_residual": F.col("nobs") - F.when(has_slope, 2).otherwise(1),
            "deviance": residual,
        }
    ).withColumn("sigma", F.sqrt(F.col("deviance") / F.nullif(F.col("df_residual"), F.lit(0))))


def fitted_at(x: Column) -> Column:
    return F.col("y_mean") + F.coalesce("slope", F.lit(0.0)) * (x - F.col("x_mean"))


def leverage_at(x: Column) -> Column:
    off = x - F.col("x_mean")
    return 1 / F.col("nobs") + F.when(
        F.col("slope").isNotNull(), off * off / F.col("sxx")
    ).otherwise(0.0)


def predict(models: DataFrame, x: str) -> DataFrame:
    """Score the column ``x`` of model rows: ``fitted`` and the 95 % interval of the mean."""
    at = F.col(x).cast("double")
    half = t_quantile_975(F.col("df_residual")) * F.col("sigma") * F.sqrt(leverage_at(at))
    return models.withColumn("fitted", fitted_at(at)).withColumns(
        {"lower": F.col("fitted") - half, "upper": F.col("fitted") + half}
    )


def glance(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quality of each model; r² is null where ``y`` does not vary."""
    n, rss, syy = F.col("nobs").cast("double"), F.col("deviance"), F.col("syy")
    r2 = F.when(syy > 0, 1 - rss / syy)
    terms = F.col("nobs") - F.col("df_residual")
    mean_square = F.nullif(rss / F.nullif(F.col("df_residual"), F.lit(0)), F.lit(0.0))
    log_lik = -n / 2 * (F.log(2 * F.pi() * F.nullif(rss, F.lit(0.0)) / n) + 1)
    return models.select(
        *keys,
        r2.alias("r_squared"),
        (1 - (1 - r2) * (n - 1) / F.nullif(F.col("df_residual"), F.lit(0))).alias("adj_r_squared"),
        "sigma",
        F.when(F.col("slope").isNotNull(), (syy - rss) / mean_square).alias("statistic"),
        F.when(F.col("slope").isNotNull(), 1).alias("df"),
        log_lik.alias("log_lik"),
        (-2 * log_lik + 2 * (terms + 1)).alias("aic"),
        (-2 * log_lik + F.log(n) * (terms + 1)).alias("bic"),
        rss.alias("deviance"),
        "df_residual",
        "nobs",
    )


def with_f_p_value(glanced: DataFrame) -> DataFrame:
    """One row per model goes through Python."""
    return glanced.withColumn("p_value", f_p_value("statistic", F.col("df"), F.col("df_residual")))


def tidy(models: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """Two coefficient rows per model."""
    slope_se = F.col("sigma") / F.sqrt("sxx")
    rows = F.array(
        F.struct(
            F.lit("(Intercept)").alias("term"),
            F.col("intercept").alias("estimate"),
            (F.col("sigma") * F.sqrt(leverage_at(F.lit(0.0)))).alias("std_error"),
        ),
        F.struct(
            F.lit(x).alias("term"),
            F.col("slope").alias("estimate"),
            F.when(F.col("slope").isNotNull(), slope_se).alias("std_error"),
        ),
    )
    return models.select(*keys, "df_residual", F.inline(rows)).withColumn(
        "statistic", F.col("estimate") / F.nullif(F.col("std_error"), F.lit(0.0))
    )


def with_t_p_value(tidied: DataFrame) -> DataFrame:
    return tidied.withColumn("p_value", t_p_value("statistic", F.col("df_residual")))


def augment(df: DataFrame, models: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Fitted value, residual, leverage, standardised residual and Cook's distance per row."""
    joined = same_keys(
        df,
        models.select(*keys, "nobs", "x_mean", "y_mean", "sxx", "slope", "sigma", "df_residual"),
        keys,
        "inner",
    )
    at = F.col(x).cast("double")
    terms = F.col("nobs") - F.col("df_residual")
    scored = joined.withColumns({"fitted": fitted_at(at), "hat": leverage_at(at)}).withColumn(
        "residual", F.col(y).cast("double") - F.col("fitted")
    )
    free = F.nullif(1 - F.col("hat"), F.lit(0.0))
    spread = F.nullif(F.col("sigma"), F.lit(0.0))
    return scored.withColumns(
        {
            "std_residual": F.col("residual") / (spread * F.sqrt(free)),
            "cooks_distance": F.pow(F.col("residual") / (spread * free), F.lit(2.0))
            * F.col("hat")
            / terms,
        }
    ).drop("nobs", "x_mean", "y_mean", "sxx", "slope", "sigma", "df_residual")


def horizon_projection(
    df: DataFrame, day: str, measure: Column, horizons: Sequence[int], as_of: date
) -> DataFrame:
    """What each category adds over the year of ``as_of`` at the rate of the last N days.

    One running total over the longest horizon serves all of them: a shorter horizon only starts
    from another level, which changes neither slope nor r².
    """
    rows = recent(df, day, as_of, max(horizons)).withColumn("measure", measure)
    running = running_sums(
        rows.select("listing_id", "category", day, "measure"),
        {"running": F.col("measure")},
        days=[day],
        tie="listing_id",
        groups=["category"],
    )
    stacked = stack_params(
        running, "period", horizons, F.col(day) > F.date_sub(F.lit(as_of), F.col("period"))
    ).withColumn("x", F.unix_date(day))
    models = ols(stacked, ["category", "period"], "running", "x")
    start = F.trunc(F.lit(as_of), "YEAR")
    year_days = F.datediff(next_year_start(F.lit(as_of)), start)
    return models.select(
        "category",
        "period",
        (F.coalesce("slope", F.lit(0.0)) * year_days).alias("amount"),
        F.when(F.col("syy") > 0, 1 - F.col("deviance") / F.col("syy")).alias("r_squared"),
    )


def trend_points(
    history: DataFrame, day: str, running: str, horizons: Sequence[int], as_of: date
) -> DataFrame:
    """Line through the last N days of an existing running total, scored at its two ends.

    The ends are ``as_of`` minus N days and the next first of January: (date, fitted, period).
    """
    stacked = stack_params(
        history.filter(F.col(day).isNotNull()),
        "period",
        horizons,
        F.col(day) > F.date_sub(F.lit(as_of), F.col("period")),
    ).withColumn("x", F.unix_date(day))
    models = ols(stacked, ["category", "period"], running, "x")
    ends = F.array(F.date_sub(F.lit(as_of), F.col("period")), next_year_start(F.lit(as_of)))
    scored = models.withColumn("date", F.explode(ends))
    return scored.select(
        "category", "period", "date", fitted_at(F.unix_date("date")).alias("fitted")
    )


def recent_history(df: DataFrame, category: str, days: int, as_of: date) -> DataFrame:
    """Running listings and running amount of one category over the last days, in listing order.

    ``cumulative_value`` is null from the first open listing on; ``sold_value`` takes those as zero.
    """
    rows = recent(df, "listing_date", as_of, days, category).select(
        "listing_id", "category", "listing_date", "sale_date", "amount"
    )
    return null_poisoned_sum(
        rows,
        "cumulative_value",
        "amount",
        also={"cumulative_listing": F.lit(1).cast("long"), "sold_value": F.coalesce("amount", F.lit(0))},
        days=["listing_date"],
        tie="listing_id",
    )


def interpolate_at(df: DataFrame, x: str, y: str, at: Column) -> DataFrame:
    """Value of ``y`` at ``at`` on the line between its neighbours, as a one-row table.

    Equal ``x`` are averaged, rows with a null ignored; outside the data the value is null.
    """
    points = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.col(x).alias("x"))
        .agg(F.avg(F.col(y).cast("double")).alias("y"))
    )
    left = F.when(F.col("x") <= at, F.col("x"))
    right = F.when(F.col("x") >= at, F.col("x"))
    ends = points.agg(
        F.max(left).alias("x0"),
        F.max_by("y", left).alias("y0"),
        F.min(right).alias("x1"),
        F.min_by("y", right).alias("y1"),
    )
    share = F.datediff(at, F.col("x0")) / F.nullif(F.datediff(F.col("x1"), F.col("x0")), F.lit(0))
    between = F.col("y0") + (F.col("y1") - F.col("y0")) * share
    return ends.select(F.when(F.col("x0") == F.col("x1"), F.col("y0")).otherwise(between).alias("y"))


@F.pandas_udf(ArrayType(DoubleType()))
def _solve_normal(gram: pd.Series, moments: pd.Series) -> pd.Series:
    """Coefficients from the cross products of one model per row."""
    solved = []
    for g, m in zip(gram, moments):
        size = len(m)
        products = np.zeros((size, size))
        products[np.triu_indices(size)] = g
        products += np.triu(products, 1).T
        scale = np.sqrt(np.where(np.diag(products) > 0, np.diag(products), 1.0))
        inverse = np.linalg.pinv(products / np.outer(scale, scale), rcond=1e-12, hermitian=True)
        solved.append((inverse @ (np.asarray(m) / scale) / scale).tolist())
    return pd.Series(solved)


def multi_ols(df: DataFrame, keys: Sequence[str], y: str, terms: Sequence[str]) -> DataFrame:
    """Least squares of ``y`` on several columns: ``coefficients`` in the order of ``terms``.

    The cross products are plain sums that combine map-side; only one small matrix per group goes
    through Python. Give terms in comparable units, with a column of ones for the intercept.
    """
    columns = [F.col(t).cast("double") for t in terms]
    target = F.col(y).cast("double")
    pairs = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = df.filter(F.col(y).isNotNull()).groupBy(*keys).agg(
        F.array(*[F.sum(columns[i] * columns[j]) for i, j in pairs]).alias("gram"),
        F.array(*[F.sum(c * target) for c in columns]).alias("moments"),
        F.count("*").alias("nobs"),
        F.regr_syy(target, target).alias("syy"),
    )
    return sums.select(
        *keys, "nobs", "syy", _solve_normal("gram", "moments").alias("coefficients")
    )


def linear_form(terms: Sequence[str]) -> Column:
    """Sum of ``coefficients`` times the term columns."""
    total = F.lit(0.0)
    for i, term in enumerate(terms):
        total = total + F.col("coefficients")[i] * F.col(term).cast("double")
    return total
