"""Least squares from cross products by the sweep operator, inside the JVM, one matrix per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

COLLINEAR = 1e-10  # a term whose remaining square is below this share of its own adds nothing


def _cell(matrix: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(matrix, i), j)


def _swept(matrix: Column, pivot: Column) -> Column:
    """``matrix`` (array of rows) with ``pivot`` swept in: its rows then hold inverse and coefficients."""
    d = _cell(matrix, pivot, pivot)

    def cell(value: Column, row: Column, i: Column, j: Column) -> Column:
        return (
            F.when((i == pivot) & (j == pivot), 1 / d)
            .when(i == pivot, value / d)
            .when(j == pivot, -value / d)
            .otherwise(value - F.get(row, pivot) * _cell(matrix, pivot, j) / d)
        )

    return F.transform(matrix, lambda row, i: F.transform(row, lambda value, j: cell(value, row, i, j)))


def nested_fits(products: str, terms: int) -> Column:
    """Fits on the first term, the first two, and so on: an array of (``rss``, ``beta``, ``inverse``, ``used``).

    ``products`` names a column of (terms + 1) x (terms + 1) cross products, the target last. ``beta``
    has a value per term, zero for those not yet in and for those that are collinear with earlier
    ones, for which ``used`` is false. ``inverse`` is the swept matrix; its rows and columns of used terms
    hold the inverse.
    """
    start = F.struct(
        F.col(products).alias("m"),
        F.array().cast("array<boolean>").alias("used"),
        F.array().cast("array<struct<rss:double,beta:array<double>,inverse:array<array<double>>,used:array<boolean>>>").alias("fits"),
    )

    def step(state: Column, pivot: Column) -> Column:
        usable = _cell(state["m"], pivot, pivot) > COLLINEAR * _cell(F.col(products), pivot, pivot)

        def take(matrix: Column, ok: Column) -> Column:
            used = F.concat(state["used"], F.array(ok))
            beta = F.transform(
                F.sequence(F.lit(0), F.lit(terms - 1)),
                lambda i: F.when(F.coalesce(F.get(used, i), F.lit(False)), _cell(matrix, i, F.lit(terms))).otherwise(0.0),
            )
            fit = F.struct(_cell(matrix, F.lit(terms), F.lit(terms)).alias("rss"), beta.alias("beta"), matrix.alias("inverse"), used.alias("used"))
            return F.struct(matrix.alias("m"), used.alias("used"), F.concat(state["fits"], F.array(fit)).alias("fits"))

        # Bound once: a lambda's variable is not copied into the places that name it.
        swept = F.array(F.when(usable, _swept(state["m"], pivot)).otherwise(state["m"]))
        return F.element_at(F.transform(swept, lambda matrix: take(matrix, usable)), 1)

    return F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), start, step)["fits"]
