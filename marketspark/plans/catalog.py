"""All registered queries."""

from marketspark.plans import (  # noqa: F401
    queries_columns,
    queries_joins,
    queries_models,
    queries_records,
    queries_reports,
    queries_series,
    queries_sources,
    queries_windows,
)
from marketspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
