"""How many months of stock are on the market at each listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketspark.operators.events import (
    inventory_at_listing,
    inventory_time,
    trailing_365_days,
)


def listings_with_inventory(
    listings: DataFrame, tie_rule: str = "interleaved", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Listings with inventory, trailing-year sales and months of inventory."""
    at_listing = inventory_at_listing(listings, tie_rule, carry)
    return trailing_365_days(
        listings, at_listing, "listing_date", wanted=listings.select("listing_date")
    ).withColumn(
        "inventory_time", inventory_time(F.col("inventory"), F.col("yearly_sales"))
    )
