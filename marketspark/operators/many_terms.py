"""Fits on several columns: coefficients with errors, quality, and leverage of every row.

The cross products are plain sums that combine map-side; the inverse of one small matrix per group is
found by the sweep operator in the JVM, and rows are scored by an expression of their own columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.operators.regression import same_keys
from marketspark.operators.sweep import nested_fits


def fit_terms(df: DataFrame, keys: Sequence[str], y: str, terms: Sequence[str]) -> DataFrame:
    """One model per group: ``beta`` and ``inverse`` in the order of ``terms``, and its moments.

    Rows with a null are left out. Give terms in comparable units, the column of ones first. A term
    that is collinear with those before it has coefficient and error zero.
    """
    columns = [F.col(c).cast("double") for c in (*terms, y)]
    size = len(columns)
    complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    pairs = {(i, j): F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(size) for j in range(i, size)}
    sums = df.filter(complete).groupBy(*keys).agg(
        F.count("*").alias("nobs"), F.regr_syy(columns[-1], columns[-1]).alias("syy"), *pairs.values()
    )
    rows = [F.array(*[F.col(f"p{min(i, j)}_{max(i, j)}") for j in range(size)]) for i in range(size)]
    fits = sums.filter("nobs > 0").select(*keys, "nobs", "syy", F.array(*rows).alias("products"))
    last = fits.withColumn("fit", F.element_at(nested_fits("products", len(terms)), -1))
    rank = F.size(F.filter("fit.used", lambda u: u))
    models = last.select(*keys, "nobs", "syy", F.col("fit.beta").alias("beta"), F.col("fit.inverse").alias("inverse"), F.col("fit.used").alias("used"), F.greatest("fit.rss", F.lit(0.0)).alias("deviance"), rank.alias("rank"))
    return models.withColumn("df_residual", F.col("nobs") - F.col("rank")).withColumn(
        "sigma", F.sqrt(F.col("deviance") / F.nullif(F.col("df_residual"), F.lit(0)))
    )


def fitted_terms(terms: Sequence[str]) -> Column:
    """Value of the model in the row's ``beta``."""
    return sum((F.col("beta")[i] * F.col(t).cast("double") for i, t in enumerate(terms)), F.lit(0.0))


def hat_terms(terms: Sequence[str]) -> Column:
    """Leverage of a row: its terms on both sides of the inverse of the cross products."""
    x = [F.col(t).cast("double") for t in terms]
    total = F.lit(0.0)
    for i in range(len(x)):
        for j in range(i, len(x)):
            both = F.col("used")[i] & F.col("used")[j]
            share = F.when(both, F.col("inverse")[i][j] * x[i] * x[j]).otherwise(0.0)
            total = total + (share if i == j else 2 * share)
    return total


def glance_terms(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quality of each model; r² is null where ``y`` does not vary."""
    n, rss, syy = F.col("nobs").cast("double"), F.col("deviance"), F.col("syy")
    free, slopes = F.nullif(F.col("df_residual"), F.lit(0)), F.col("rank") - 1
    r2 = F.when(syy > 0, 1 - rss / syy)
    log_lik = -n / 2 * (F.log(2 * F.pi() * F.nullif(rss, F.lit(0.0)) / n) + 1)
    return models.select(
        *keys,
        r2.alias("r_squared"),
        (1 - (1 - r2) * (n - 1) / free).alias("adj_r_squared"),
        "sigma",
        ((syy - rss) / F.nullif(slopes, F.lit(0)) / F.nullif(rss / free, F.lit(0.0))).alias("statistic"),
        slopes.alias("df"),
        log_lik.alias("log_lik"),
        (-2 * log_lik + 2 * (F.col("rank") + 1)).alias("aic"),
        (-2 * log_lik + F.log(n) * (F.col("rank") + 1)).alias("bic"),
        rss.alias("deviance"),
        "df_residual",
        "nobs",
    )


def tidy_terms(models: DataFrame, keys: Sequence[str], names: Sequence[str], units: Sequence[Column]) -> DataFrame:
    """One row per model and term; estimate and error are multiplied by the term's unit."""
    rows = [
        F.struct(
            F.lit(name).alias("term"),
            F.when(F.col("used")[i], F.col("beta")[i] * unit).alias("estimate"),
            F.when(F.col("used")[i], F.col("sigma") * F.sqrt(F.col("inverse")[i][i]) * unit).alias("std_error"),
        )
        for i, (name, unit) in enumerate(zip(names, units))
    ]
    return models.select(*keys, "df_residual", F.inline(F.array(*rows))).withColumn(
        "statistic", F.col("estimate") / F.nullif(F.col("std_error"), F.lit(0.0))
    )


def augment_terms(df: DataFrame, models: DataFrame, keys: Sequence[str], y: str, terms: Sequence[str]) -> DataFrame:
    """Fitted value, residual, leverage, standardised residual and Cook's distance per row."""
    model = models.select(*keys, "beta", "inverse", "used", "sigma", "rank")
    joined = same_keys(df, model, keys, "inner") if keys else df.crossJoin(F.broadcast(model))  # one row
    scored = joined.withColumns({"fitted": fitted_terms(terms), "hat": hat_terms(terms)}).withColumn(
        "residual", F.col(y).cast("double") - F.col("fitted")
    )
    free, spread = F.nullif(1 - F.col("hat"), F.lit(0.0)), F.nullif(F.col("sigma"), F.lit(0.0))
    away = F.col("residual") / (spread * free)
    return scored.withColumns(
        {"std_residual": F.col("residual") / (spread * F.sqrt(free)), "cooks_distance": away * away * F.col("hat") / F.col("rank")}
    ).drop("beta", "inverse", "used", "sigma", "rank")
