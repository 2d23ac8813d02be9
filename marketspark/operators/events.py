"""Listings as a stream of +1 / -1 events, running inventory and trailing sales."""

from __future__ import annotations

from collections.abc import Sequence
from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.operators.ordered import running_sums


def listing_events(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One +1 row per listing and one -1 row per sale: (listing_id, event, event_date, y)."""
    events = F.array(
        F.struct(F.lit("listing").alias("event"), F.col("listing_date").alias("event_date"), F.lit(1).alias("y")),
        F.struct(F.lit("sale").alias("event"), F.col("sale_date").alias("event_date"), F.lit(-1).alias("y")),
    )
    return df.select("listing_id", *carry, F.inline(events)).filter(F.col("event_date").isNotNull())


def running_inventory(
    df: DataFrame, tie_rule: str = "interleaved", carry: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Open listings after each event.

    Same-day order: ``interleaved`` goes listing by listing, ``listings_first`` takes all listings of
    the day before its sales.
    """
    if tie_rule not in ("interleaved", "listings_first"):
        raise ValueError(f"unknown tie rule {tie_rule!r}")
    events = listing_events(df, carry).withColumn("is_sale", (F.col("y") < 0).cast("int"))
    days = ["event_date"] if tie_rule == "interleaved" else ["event_date", "is_sale"]
    return running_sums(
        events,
        {"inventory": F.col("y").cast("long")},
        days=days,
        tie="listing_id",
        within=["is_sale"],
        slices=slices,
    ).drop("is_sale")


def inventory_at_listing(
    df: DataFrame, tie_rule: str = "interleaved", carry: Sequence[str] = (), slices: int | None = None
) -> DataFrame:
    """Listings with the inventory their own listing event left; no join back is needed."""
    rows = running_inventory(df, tie_rule, carry, slices).filter(F.col("event") == "listing")
    return rows.drop("event", "y").withColumnRenamed("event_date", "listing_date")


def date_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rows per non-null date: one row per calendar day whatever the size of ``df``."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("day"))
        .agg(F.count("*").alias(name))
    )


def trailing_365_days(
    df: DataFrame,
    dates: DataFrame,
    column: str,
    name: str = "yearly_sales",
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Add to ``dates[column]`` how many sales of ``df`` fell 0 to 364 days before it.

    ``wanted`` holds the same dates in a table that is cheaper to read than ``dates``.

    Each sale day counts for the 365 days from it on: +n on that day, -n 365 days later. The running
    total of these steps is known on every step day; a date between steps takes the latest one.
    """
    sales = date_counts(df, "sale_date", "n")
    steps = sales.select(
        F.inline(
            F.array(
                F.struct("day", "n"),
                F.struct(F.date_add("day", 365).alias("day"), (-F.col("n")).alias("n")),
            )
        )
    )
    return _join_step_total(dates, steps, column, name, wanted)


def trailing_12_months(df: DataFrame, dates: DataFrame, column: str, name: str = "homes_sold") -> DataFrame:
    """Add how many sales fell in (date - 1 calendar year, date], clamping Feb 29 to Feb 28.

    The window of each date is a difference of two running totals, both looked up by date.
    """
    steps = date_counts(df, "sale_date", "n")
    back = dates.select(column).distinct().select(
        F.col(column).alias("at"), F.add_months(column, -12).alias("year_before")
    )
    now = _join_step_total(back, steps, "at", "upto_now")
    both = _join_step_total(now, steps, "year_before", "upto_before")
    counts = both.select(
        F.col("at").alias(column), (F.col("upto_now") - F.col("upto_before")).alias(name)
    )
    return dates.join(F.broadcast(counts), column)


def _join_step_total(
    dates: DataFrame, steps: DataFrame, column: str, name: str, wanted: DataFrame | None = None
) -> DataFrame:
    """Running total of ``steps`` on each date, looked up by equi-join on the date.

    Steps and wanted dates are tables of calendar days, so the window and the broadcast are bounded
    by the calendar and the large side is not shuffled.
    """
    asked = (dates if wanted is None else wanted).select(F.col(column).alias("day")).distinct()
    by_day = steps.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).groupBy("day").agg(F.sum("n").alias("n"))
    total = by_day.select(
        F.col("day").alias(column),
        F.sum("n")
        .over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
        .alias(name),
    )
    return dates.join(F.broadcast(total), column)


def inventory_time(inventory: Column, yearly_sales: Column) -> Column:
    """Months the inventory lasts at the trailing sales rate; null without sales."""
    return inventory / F.nullif(yearly_sales, F.lit(0)) * 12
