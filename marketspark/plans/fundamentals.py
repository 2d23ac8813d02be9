"""Trailing sales, speed and residence time of a market over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.operators.enrich import after_warmup
from marketspark.operators.events import (
    inventory_time,
    running_inventory,
    trailing_12_months,
)
from marketspark.sources.spine import event_anchors, month_spine


def sold_listings(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("sale_date").isNotNull())


def anchor_dates(listings: DataFrame, as_of: date) -> DataFrame:
    return event_anchors(sold_listings(listings), ["listing_date", "sale_date"], as_of)


def first_anchor(listings: DataFrame, as_of: date) -> DataFrame:
    bounds = sold_listings(listings).agg(
        F.least(F.min("listing_date"), F.min("sale_date"), F.lit(as_of)).alias("first")
    )
    return bounds


def sold_at_anchors(listings: DataFrame, as_of: date) -> DataFrame:
    """(date, homes_sold) on every anchor date."""
    return trailing_12_months(listings, anchor_dates(listings, as_of), "date")


def sold_by_month(listings: DataFrame, as_of: date) -> DataFrame:
    """(date, homes_sold) on every first of month and the as-of date."""
    bounds = sold_listings(listings).agg(
        F.least(F.min("listing_date"), F.min("sale_date"), F.lit(as_of)).alias("lo"),
        F.greatest(F.max("listing_date"), F.max("sale_date"), F.lit(as_of)).alias("hi"),
    )
    months = month_spine(bounds, F.col("lo"), F.col("hi"), as_of)
    return trailing_12_months(listings, months, "date")


def market_speed_at_events(listings: DataFrame, as_of: date) -> DataFrame:
    """Months of inventory after each event on an anchor date, from a year after the first one."""
    inventory = running_inventory(listings).withColumnRenamed("event_date", "date")
    # One row per calendar day.
    joined = inventory.join(F.broadcast(sold_at_anchors(listings, as_of)), "date")
    warm = after_warmup(joined, "date", first_anchor(listings, as_of), inclusive=True)
    return warm.withColumn("market_speed", inventory_time(F.col("inventory"), F.col("homes_sold")))


def monthly_inventory(listings: DataFrame) -> DataFrame:
    """Mean running inventory over the events of each month."""
    return (
        running_inventory(listings)
        .groupBy(F.trunc("event_date", "MM").alias("date"))
        .agg(F.avg("inventory").alias("inventory"))
    )


def market_speed_by_month(listings: DataFrame, as_of: date) -> DataFrame:
    joined = monthly_inventory(listings).join(sold_by_month(listings, as_of), "date")
    warm = after_warmup(joined, "date", first_anchor(listings, as_of), inclusive=True)
    return warm.withColumn("market_speed", inventory_time(F.col("inventory"), F.col("homes_sold")))


def residence_time(listings: DataFrame, stock: Column, as_of: date) -> DataFrame:
    """Years a home stays with its owner at the trailing sales rate."""
    warm = after_warmup(
        sold_by_month(listings, as_of), "date", first_anchor(listings, as_of), inclusive=True
    )
    return warm.withColumn("residence_time", stock / F.nullif(F.col("homes_sold"), F.lit(0)))
