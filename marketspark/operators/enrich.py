"""Derived columns and row filters over a listing table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.functions.labels import listing_status


def enrich_listings(df: DataFrame, as_of: date) -> DataFrame:
    """Date parts, time on market and status in one projection.

    An open listing has been on the market until ``as_of``; the result may be negative.
    """
    return df.withColumns(
        {
            "listing_year": F.year("listing_date"),
            "listing_month": F.month("listing_date"),
            "sale_year": F.year("sale_date"),
            "sale_month": F.month("sale_date"),
            "day_of_year": F.dayofyear("listing_date"),
            "time_on_market": F.datediff(
                F.coalesce("sale_date", F.lit(as_of)), F.col("listing_date")
            ),
            "status": listing_status(F.col("sale_date"), F.col("under_contract")),
        }
    )


def open_listings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sale_date").isNull())


def unconfirmed_sales(df: DataFrame) -> DataFrame:
    """Sold but still flagged as under contract."""
    return df.filter((F.col("under_contract") == 1) & F.col("sale_date").isNotNull())


def active_listings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sale_date").isNull() & F.col("under_contract").isNull())


# The year of a date is a column of its own, by which tables are laid out.
YEAR_OF = {"listing_date": "listing_year", "sale_date": "sale_year"}


def from_year_of(df: DataFrame, column: str, start: Column) -> DataFrame:
    """The condition on ``column`` in terms of its year, so that whole folders are skipped."""
    year = YEAR_OF.get(column)
    return df.filter(F.col(year) >= F.year(start)) if year in df.columns else df


def recent(
    df: DataFrame, column: str, as_of: date, days: int, category: str | None = None
) -> DataFrame:
    """Strictly later than ``as_of`` minus ``days``."""
    start = F.date_sub(F.lit(as_of), days)
    kept = from_year_of(df, column, start).filter(F.col(column) > start)
    return kept if category is None else kept.filter(F.col("category") == category)


def after_warmup(df: DataFrame, column: str, first: DataFrame, inclusive: bool = False) -> DataFrame:
    """Rows a year after the first date; ``first`` is a one-row, one-column table."""
    start = F.add_months(first.scalar(), 12)
    return df.filter(F.col(column) >= start if inclusive else F.col(column) > start)


def year_to_date(df: DataFrame, column: str, as_of: date) -> DataFrame:
    """Rows whose day of the year is not past that of ``as_of``."""
    return df.filter(F.dayofyear(column) <= F.dayofyear(F.lit(as_of)))


def since(df: DataFrame, column: str, start: date) -> DataFrame:
    return from_year_of(df, column, F.lit(start)).filter(F.col(column) > F.lit(start))


def in_latest_year(df: DataFrame, column: str, latest: DataFrame) -> DataFrame:
    """Rows of the year of the latest date; ``latest`` is a one-row, one-column table."""
    year = YEAR_OF.get(column)
    own = F.col(year) if year in df.columns else F.year(column)
    return df.filter(own == F.year(latest.scalar()))


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def nonzero_sold(df: DataFrame) -> DataFrame:
    return df.filter((F.col("time_on_market") != 0) & F.col("sale_date").isNotNull())
