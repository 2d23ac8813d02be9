"""Listing-market analytics as plain ``DataFrame -> DataFrame`` operators on Spark."""

from marketspark.config import MarketConfig

__all__ = ["MarketConfig"]
