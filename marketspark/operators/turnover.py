"""Turnover of areas and categories against their stock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from marketspark.functions.dates import years_of
from marketspark.functions.labels import bucket_stock, bucket_turnover, street_label, street_of
from marketspark.functions.stats import Z_975


def with_category_dim(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Inner join on ``category``; the optimizer broadcasts the dimension when it is small."""
    return df.join(categories, "category")


def label_streets(
    df: DataFrame, categories: DataFrame, unsuffixed: Sequence[str] = (), address: str = "address"
) -> DataFrame:
    """Add ``street``: the address without number, suffixed by the category abbreviation."""
    return with_category_dim(df, categories).withColumn(
        "street",
        street_label(street_of(F.col(address)), F.col("abbreviation"), unsuffixed),
    )


def counts_on_stock(counts: DataFrame, stock: DataFrame, key: str, count: str) -> DataFrame:
    """Every group of the stock table with its count, 0 without any; other groups are dropped."""
    return counts.join(stock, key, "right").withColumn(count, F.coalesce(count, F.lit(0)))


def unmatched_groups(counts: DataFrame, stock: DataFrame, key: str) -> DataFrame:
    """The counted groups a join to the stock table loses, e.g. for a spelling difference."""
    return counts.join(stock, key, "left_anti")


def area_turnover(counts: DataFrame, stock: DataFrame, listings: DataFrame, key: str = "street") -> DataFrame:
    """Turnover and residence time per area; residence is null where nothing was listed."""
    span_days = listings.agg(F.datediff(F.max("listing_date"), F.min("listing_date")).alias("d"))
    joined = counts_on_stock(counts, stock, key, "listed")
    turnover = F.col("listed") / F.nullif(F.col("stock"), F.lit(0))
    return joined.withColumn("turnover", turnover).withColumns(
        {
            "residence_time": years_of(span_days.scalar()) / F.nullif(F.col("turnover"), F.lit(0.0)),
            "stock_bin": bucket_stock(F.col("stock")),
        }
    )


def turnover_limits(turnover: DataFrame, listings: DataFrame) -> DataFrame:
    """Overall turnover plus and minus its normal 95 % margin over the areas: (lower, upper)."""
    listed = listings.agg(F.count("*").alias("n")).scalar()
    spread = turnover.agg(
        F.stddev_samp("turnover").alias("sd"),
        F.count("*").alias("areas"),
        F.sum("stock").alias("stock"),
    )
    overall = listed / F.col("stock")
    margin = F.lit(Z_975) * F.col("sd") / F.sqrt("areas")
    return spread.select((overall - margin).alias("lower"), (overall + margin).alias("upper"))


def label_turnover(turnover: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``turnover_label``; ``limits`` is the one-row table of :func:`turnover_limits`."""
    return (
        turnover.crossJoin(F.broadcast(limits))  # one row
        .withColumn(
            "turnover_label", bucket_turnover(F.col("turnover"), F.col("lower"), F.col("upper"))
        )
        .drop("lower", "upper")
    )


def category_turnover(listings: DataFrame, stock: DataFrame, scale: float = 1.0) -> DataFrame:
    """Listings per year and category over the stock of the category; unknown category gives 0."""
    counted = listings.groupBy("listing_year", "category").agg(F.count("*").alias("listed"))
    share = F.col("listed") / F.nullif(F.col("stock"), F.lit(0)) * scale
    return (
        counted.join(stock, "category", "left")
        .withColumn("turnover", F.coalesce(share, F.lit(0.0)))
        .drop("stock")
    )
