"""Grouped reports: counts, medians, sums and ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from marketspark.operators.enrich import after_warmup
from marketspark.operators.events import running_inventory
from marketspark.operators.ordered import carry_forward, running_sums
from marketspark.operators.quantiles import exact_quantiles, small_domain_median
from marketspark.operators.topk import group_peaks
from marketspark.plans.flagship import listings_with_inventory
from marketspark.sources.snapshot import materialize


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per group; a null key is a group of its own."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def frequent_counts(df: DataFrame, keys: Sequence[str], at_least: int, name: str = "n") -> DataFrame:
    return count_by(df, keys, name).filter(F.col(name) >= at_least)


def median_price(df: DataFrame, keys: Sequence[str], name: str = "median_price") -> DataFrame:
    """Exact median amount; amounts have no bound on their distinct values."""
    return exact_quantiles(df, keys, "amount", {name: 0.5})


def median_days(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median of a day count, whose distinct values are bounded by the calendar."""
    return df.groupBy(*keys).agg(small_domain_median(value).alias(name))


def market_value(df: DataFrame, keys: Sequence[str], name: str = "market_value") -> DataFrame:
    """Sum of the amounts, 0 for a group without any."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias(name))


def above_next(value: Column, step: int) -> Column:
    """The multiple of ``step`` strictly above ``value``."""
    return (F.floor(value / step) + 1) * step


def up_to_next(value: Column, step: int) -> Column:
    """``value`` or the next multiple of ``step``."""
    return F.ceil(value / step) * step


def axis_limits(listings: DataFrame) -> DataFrame:
    """Chart limits as one row. The sales limit includes the group of unsold listings."""
    by_listing = count_by(listings, ["listing_year"]).agg(F.max("n").alias("listed"))
    by_sale = count_by(listings, ["sale_year"]).agg(
        F.max("n").alias("sold_or_open"),
        F.max(F.when(F.col("sale_year").isNotNull(), F.col("n"))).alias("sold"),
    )
    prices = median_price(
        listings.filter(F.col("status") == "Sold"), ["sale_year", "category"], "median"
    ).agg(F.max("median").alias("price"))
    inventory = running_inventory(listings, "listings_first").filter(
        F.col("event") == "listing"
    ).agg(F.max("inventory").alias("inventory"))
    one_row = by_listing.crossJoin(by_sale).crossJoin(prices).crossJoin(inventory)
    return one_row.select(
        above_next(F.col("listed"), 10).alias("listing_axis"),
        above_next(F.col("sold_or_open"), 10).alias("sale_axis"),
        above_next(F.col("price"), 100_000).alias("price_axis"),
        up_to_next(F.col("inventory"), 10).alias("inventory_axis"),
        up_to_next(F.col("listed"), 10).alias("listing_count_axis"),
        up_to_next(F.col("sold"), 10).alias("sale_count_axis"),
    )


def pinned_month(year: Column) -> Column:
    """Even dates over ``year`` for the rows of a table of at most twelve months."""
    position = F.row_number().over(Window.orderBy("month"))
    return F.date_add(
        F.make_date(year, F.lit(1), F.lit(1)), F.floor(F.lit(364.0) * (position - 1) / 11).cast("int")
    )


def seasonal_inventory(listings: DataFrame, latest_year: Column) -> DataFrame:
    """Median and mean inventory per calendar month over all years, pinned to even dates."""
    events = materialize(
        running_inventory(listings).select(F.month("event_date").alias("month"), "inventory"),
        "inventory-events",
    )
    means = events.groupBy("month").agg(F.avg("inventory").alias("mean_inventory"))
    medians = exact_quantiles(
        events, ["month"], "inventory", {"median_inventory": 0.5}, calendar_groups=True
    )
    return means.join(medians, "month").withColumn("display_date", pinned_month(latest_year))


def monthly_average_sales(listings: DataFrame) -> DataFrame:
    """Mean trailing-year sales over the listings of a month, gaps filled within the year."""
    rows = listings_with_inventory(listings, carry=("listing_year", "listing_month"))
    first = listings.agg(F.min("listing_date").alias("first"))
    monthly = (
        after_warmup(rows, "listing_date", first)
        .groupBy("listing_year", "listing_month")
        .agg(F.avg("yearly_sales").alias("average_sales"))
    )
    filled = carry_forward(
        monthly, "average_sales", groups=["listing_year"], order="listing_month"
    )
    return filled.withColumn("date", F.make_date("listing_year", "listing_month", F.lit(1)))


def last_sale_day(listings: DataFrame) -> DataFrame:
    """Median over years of the latest sale day of each year, every tied sale counting once."""
    per_day = count_by(
        listings.filter(F.col("sale_date").isNotNull()).select(
            "sale_year", F.dayofyear("sale_date").alias("day_of_year")
        ),
        ["sale_year", "day_of_year"],
    )
    last = group_peaks(per_day, ["sale_year"], "day_of_year", calendar_groups=True)
    return last.agg(
        F.percentile("day_of_year", F.lit(0.5), F.col("n")).alias("last_sale_day")
    )


def value_by_year(listings: DataFrame) -> DataFrame:
    """Running amount within each sale year, in order of sale date and id."""
    sold = listings.filter(F.col("sale_date").isNotNull()).select(
        "listing_id", "sale_year", "sale_date", "amount",
        F.dayofyear("sale_date").alias("day_of_year"),
    )
    return running_sums(
        sold,
        {"market_value": F.col("amount")},
        days=["sale_date"],
        tie="listing_id",
        groups=["sale_year"],
    )


def sale_counter(listings: DataFrame) -> DataFrame:
    """Running number of sales within each sale year."""
    sold = listings.filter(F.col("sale_date").isNotNull()).select(
        "listing_id", "sale_year", "sale_date", F.dayofyear("sale_date").alias("day_of_year")
    )
    return running_sums(
        sold,
        {"sale_count": F.lit(1).cast("long")},
        days=["sale_date"],
        tie="listing_id",
        groups=["sale_year"],
    )


def value_total(listings: DataFrame) -> DataFrame:
    """Running amount over all time and days since the first sale."""
    sold = listings.filter(F.col("sale_date").isNotNull()).select("listing_id", "sale_date", "amount")
    first = sold.agg(F.min("sale_date").alias("first")).scalar()
    return running_sums(
        sold, {"total_amount": F.col("amount")}, days=["sale_date"], tie="listing_id"
    ).withColumn("time", F.datediff("sale_date", first))
