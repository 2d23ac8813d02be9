"""The eight panels of the yearly dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.plans.flagship import listings_with_inventory
from marketspark.plans.reports import count_by, market_value, median_days, median_price
from marketspark.operators.quantiles import exact_quantiles, small_domain_median
from marketspark.sources.snapshot import materialize


def listed(listings: DataFrame) -> DataFrame:
    return count_by(listings, ["listing_year"], "count")


def sold(listings: DataFrame) -> DataFrame:
    return count_by(listings.filter(F.col("sale_year").isNotNull()), ["sale_year"], "count")


def median_time_on_market(listings: DataFrame) -> DataFrame:
    """Open listings count with their time so far."""
    return median_days(listings, ["listing_year"], "time_on_market", "time_on_market")


def median_sale_price(listings: DataFrame) -> DataFrame:
    return median_price(listings.filter(F.col("sale_year").isNotNull()), ["sale_year"], "sale_price")


def average_inventory(with_inventory: DataFrame) -> DataFrame:
    return with_inventory.groupBy("listing_year").agg(F.avg("inventory").alias("inventory"))


def inventory_rows(listings: DataFrame) -> DataFrame:
    """(listing_year, inventory, inventory_time) per listing, written once for the panels on it."""
    rows = listings_with_inventory(listings, carry=("listing_year",))
    return materialize(rows.select("listing_year", "inventory", "inventory_time"), "inventory-rows")


def median_inventory_time(with_inventory: DataFrame) -> DataFrame:
    """The first year is 0: it has no trailing year yet."""
    per_year = exact_quantiles(
        with_inventory,
        ["listing_year"],
        "inventory_time",
        {"inventory_time": 0.5},
        calendar_groups=True,
    )
    first_year = with_inventory.agg(F.min("listing_year").alias("first")).scalar()
    return per_year.withColumn(
        "inventory_time",
        F.when(F.col("listing_year") == first_year, F.lit(0.0)).otherwise(F.col("inventory_time")),
    )


def total_value(listings: DataFrame) -> DataFrame:
    return market_value(listings.filter(F.col("sale_year").isNotNull()), ["sale_year"])


def turnover(listings: DataFrame, stock: Column) -> DataFrame:
    return sold(listings).select("sale_year", (F.col("count") / stock).alias("turnover"))


def all_panels(listings: DataFrame, stock: Column) -> DataFrame:
    """(panel, year, value) of all eight panels.

    Every listing is written once with its inventory and what else the panels need. Counts, sums and
    the median of days then take one grouped pass, in which a listing is a row of its listing year
    and one of its sale year, and the other medians one exact-quantile pass with the panel as a group.
    """
    carried = ("listing_year", "sale_year", "time_on_market", "amount")
    rows = materialize(
        listings_with_inventory(listings, carry=carried).select(*carried, "inventory", "inventory_time"), "dashboard-rows"
    )
    none = F.lit(None)
    sides = F.array(
        F.struct(F.lit("listed").alias("side"), F.col("listing_year").alias("year"), F.col("inventory"), F.col("time_on_market").alias("days"), none.cast("decimal(18,2)").alias("amount")),
        F.struct(F.lit("sold").alias("side"), F.col("sale_year").alias("year"), none.cast("long").alias("inventory"), none.cast("int").alias("days"), F.col("amount").cast("decimal(18,2)").alias("amount")),
    )
    happened = (F.col("side") == "listed") | F.col("year").isNotNull()
    counted = rows.select(F.inline(sides)).filter(happened).groupBy("side", "year").agg(
        F.count("*").cast("double").alias("n"), F.avg("inventory").alias("inventory"), small_domain_median("days").alias("days"), F.sum("amount").cast("double").alias("amount")
    )

    def panel(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("panel"), "year", value.alias("value"))

    listed_panels = F.array(panel("listed", F.col("n")), panel("inventory", F.col("inventory")), panel("time_on_market", F.col("days")))
    sold_panels = F.array(panel("sold", F.col("n")), panel("market_value", F.col("amount")), panel("turnover", F.col("n") / stock))
    sums = counted.select(F.inline(F.when(F.col("side") == "listed", listed_panels).otherwise(sold_panels)))

    values = F.array(
        *[
            F.struct(F.lit(name).alias("panel"), F.col(year).alias("year"), F.col(value).cast("double").alias("value"))
            for name, year, value in (
                ("sale_price", "sale_year", "amount"),
                ("inventory_time", "listing_year", "inventory_time"),
            )
        ]
    )
    measured = rows.select(F.inline(values)).filter((F.col("panel") != "sale_price") | F.col("year").isNotNull())
    medians = exact_quantiles(measured, ["panel", "year"], "value", {"median": 0.5}, calendar_groups=True)
    first_year = rows.agg(F.min("listing_year").alias("first")).scalar()
    no_trailing_year = (F.col("panel") == "inventory_time") & (F.col("year") == first_year)
    return sums.unionByName(
        medians.select("panel", "year", F.when(no_trailing_year, F.lit(0.0)).otherwise(F.col("median")).alias("value"))
    )
