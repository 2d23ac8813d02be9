"""Order tables seen as a listing market: an order is listed on its date, sold on first shipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketspark.sources.schema import MONEY


def listings_from_orders(
    orders: DataFrame, lineitem: DataFrame, customer: DataFrame, nation: DataFrame
) -> DataFrame:
    """One row per order.

    Line items meet their order by its key if they ship no earlier, and the least ship date is a
    hash aggregate on the partitioning of that join.
    """
    shipped = lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("ship_date"))
    listed = orders.select(
        F.col("o_orderkey").alias("listing_id"),
        F.col("o_custkey").alias("entity_id"),
        F.to_date("o_orderdate").alias("listing_date"),
        F.col("o_totalprice").cast(MONEY).alias("price"),
        F.when(F.col("o_orderstatus") == "P", F.lit(1)).alias("under_contract"),
    )
    owner = customer.select(
        F.col("c_custkey").alias("entity_id"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_nationkey").alias("n_nationkey"),
    ).join(nation.select("n_nationkey", F.col("n_name").alias("area")), "n_nationkey")
    in_time = (F.col("listing_id") == F.col("l_orderkey")) & (F.col("ship_date") >= F.col("listing_date"))
    return (
        listed.join(shipped, in_time, "left")
        .groupBy(*listed.columns)
        .agg(F.min("ship_date").alias("sale_date"))
        .join(owner, "entity_id")
        .select(
            "listing_id",
            "entity_id",
            "area",
            "category",
            "listing_date",
            "sale_date",
            F.when(F.col("sale_date").isNotNull(), F.col("price")).alias("amount"),
            "under_contract",
        )
    )


def stock_by(customer: DataFrame, nation: DataFrame, *keys: str) -> DataFrame:
    """How many entities exist per ``area`` and/or ``category``: the stock turnover is measured on."""
    named = customer.join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area")),
        "c_nationkey",
    ).withColumnRenamed("c_mktsegment", "category")
    return named.groupBy(*keys).agg(F.count("*").alias("stock"))
