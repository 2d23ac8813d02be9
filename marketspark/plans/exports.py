"""The file outputs of a market: research extracts, record list, yearly overviews, enriched table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.operators import enrich
from marketspark.operators.ordered import running_count
from marketspark.operators.topk import top_with_ties
from marketspark.operators.turnover import category_turnover
from marketspark.plans import reports
from marketspark.plans.flagship import listings_with_inventory
from marketspark.sources.files import write_csv

OPEN_COLUMNS = ["listing_date", "time_on_market", "category", "under_contract"]


def extracts(listings: DataFrame, item: str) -> dict[str, DataFrame]:
    """Lists to follow up by hand; ``item`` is the column that names a listing."""

    def longest_first(df: DataFrame) -> DataFrame:
        return df.select(item, *OPEN_COLUMNS).orderBy(F.col("time_on_market").desc_nulls_last(), item)

    return {
        "unconfirmed_sales": enrich.unconfirmed_sales(listings).select(
            item, "listing_date", "sale_date", "amount", "category", "under_contract"
        ),
        "unsold": longest_first(enrich.open_listings(listings)),
        "on_market": longest_first(enrich.active_listings(listings)),
        "top_sales": top_with_ties(
            listings.filter(F.col("sale_date").isNotNull()), "amount", 10
        ).select(item, "amount", "sale_date"),
    }


def processed(listings: DataFrame) -> DataFrame:
    """Enriched listings with inventory, yearly counter and months of inventory."""
    inventory = listings_with_inventory(listings, "listings_first").drop("listing_date")
    counter = running_count(
        listings.select("listing_id", "listing_year", "listing_date"),
        "listing_count",
        days=["listing_date"],
        tie="listing_id",
        groups=["listing_year"],
    ).select("listing_id", "listing_count")
    return listings.join(inventory, "listing_id").join(counter, "listing_id")


def overviews(listings: DataFrame, stock: DataFrame) -> dict[str, DataFrame]:
    """Yearly report tables and the enriched table; ``stock`` is (category, stock)."""
    sold: Column = F.col("status") == "Sold"
    return {
        "listing_overview_by_year": reports.count_by(
            listings, ["listing_year", "category", "status"], "listed_total"
        ),
        "sales_overview_by_year": reports.count_by(
            listings, ["sale_year", "category", "status"], "sold_total"
        ),
        "median_time_on_market": reports.median_days(
            listings, ["listing_year", "category", "status"], "time_on_market", "median_time"
        ),
        "turnover_by_category": category_turnover(listings, stock, scale=100),
        "median_price": reports.median_price(listings.filter(sold), ["sale_year", "category"]),
        "processed": processed(listings),
    }


def write_all(listings: DataFrame, stock: DataFrame, item: str, folder: str) -> list[str]:
    """Write every output as CSV under ``folder``; returns the paths."""
    outputs = {**extracts(listings, item), **overviews(listings, stock)}
    paths = []
    for name, table in outputs.items():
        paths.append(f"{folder.rstrip('/')}/{name}")
        write_csv(table, paths[-1])
    return paths
