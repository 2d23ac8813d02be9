"""Queries by name, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketspark.plans.market import AS_OF, Market

# The listing view and its enriched form, over the order tables.
BASE_SQL = f"""
with params as (select date '{AS_OF}' as as_of),
sold_orders as (
  select o.o_orderkey, min(cast(l.l_shipdate as date)) as sale_date
  from orders o join lineitem l on l.l_orderkey = o.o_orderkey and l.l_shipdate >= o.o_orderdate
  group by o.o_orderkey),
l as (
  select o.o_orderkey as listing_id, o.o_custkey as entity_id, n.n_name as area,
         c.c_mktsegment as category, cast(o.o_orderdate as date) as listing_date, s.sale_date,
         case when s.sale_date is not null then cast(o.o_totalprice as decimal(18,2)) end as amount,
         case when o.o_orderstatus = 'P' then 1 end as under_contract
  from orders o join customer c on c.c_custkey = o.o_custkey
  join nation n on n.n_nationkey = c.c_nationkey
  left join sold_orders s on s.o_orderkey = o.o_orderkey),
e as (
  select l.*, cast(year(listing_date) as int) as listing_year,
         cast(month(listing_date) as int) as listing_month,
         cast(year(sale_date) as int) as sale_year, cast(month(sale_date) as int) as sale_month,
         cast(dayofyear(listing_date) as int) as day_of_year,
         cast(coalesce(sale_date, (select as_of from params)) - listing_date as int) as time_on_market,
         case when sale_date is not null then 'Sold' when under_contract = 1 then 'Under Contract'
              else 'For Sale' end as status
  from l)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a plan over a :class:`Market` under ``name``; ``sql`` is its twin, if it has one."""

    def register(plan: Callable[[Market], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plan(Market(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"{BASE_SQL.strip()}{',' + ctes.strip() if ctes else ''}\n{sql.strip()}"
        return plan

    return register


def rounded(column: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for comparison across engines."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def sql_rounded(expr: str, digits: int = 6) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


def as_double(column: str) -> Column:
    return F.col(column).cast("double")
