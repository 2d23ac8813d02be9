"""Joins."""

from pyspark.sql import functions as F

from marketspark.operators.events import running_inventory, trailing_365_days
from marketspark.operators.ordered import frequent_groups, running_count
from marketspark.operators.reshape import stack_params, to_long
from marketspark.operators.turnover import counts_on_stock, with_category_dim
from marketspark.operators import enrich
from marketspark.operators.enrich import year_to_date
from marketspark.plans import fundamentals
from marketspark.plans.market import AS_OF
from marketspark.plans.queries_columns import (
    STREETS_SQL,
    category_dim,
    street_counts,
    street_stock,
)
from marketspark.plans.queries_sources import ANCHORS_SQL
from marketspark.plans.queries_windows import EVENTS_SQL, SALES_365_SQL
from marketspark.plans.registry import query, rounded, sql_rounded

MIN_GROUP = 12


@query(
    "join_inventory_at_listing",
    "select e.listing_id, e.category, inv.inventory from e join inv on inv.listing_id = e.listing_id and event = 'listing'",
    EVENTS_SQL,
)
def join_inventory_at_listing(m):
    listed = running_inventory(m.listings).filter(F.col("event") == "listing")
    return m.listings.select("listing_id", "category").join(
        listed.select("listing_id", "inventory"), "listing_id"
    )


@query("join_natural_dim", "select listing_id, category, abbreviation from e join dim using (category)", STREETS_SQL)
def join_natural_dim(m):
    return with_category_dim(m.listings.select("listing_id", "category"), category_dim(m))


@query("join_right_stock", "select street, stock, listed from turn", STREETS_SQL)
def join_right_stock(m):
    return counts_on_stock(street_counts(m), street_stock(m), "street", "listed").select(
        "street", "stock", "listed"
    )


YTD_SQL = """
ytd_l as (select listing_year as year, cast(count(*) as bigint) as listings from e, params
          where dayofyear(listing_date) <= dayofyear(as_of) group by 1),
ytd_s as (select sale_year as year, cast(count(*) as bigint) as sales from e, params
          where dayofyear(sale_date) <= dayofyear(as_of) group by 1),
ytd as (select year, listings, sales from ytd_l join ytd_s using (year))
"""


def ytd_pair(m):
    """Listings and sales of each year up to the day of the year of the as-of date."""
    listed = year_to_date(m.listings, "listing_date", AS_OF).groupBy(
        F.col("listing_year").alias("year")
    ).agg(F.count("*").alias("listings"))
    sold = year_to_date(m.listings, "sale_date", AS_OF).groupBy(
        F.col("sale_year").alias("year")
    ).agg(F.count("*").alias("sales"))
    return listed.join(sold, "year")


@query("join_ytd_pair", "select year, listings, sales from ytd", YTD_SQL)
def join_ytd_pair(m):
    return ytd_pair(m)


@query("agg_ytd", "select year, 'sales' as type, sales as count from ytd union all select year, 'listings', listings from ytd", YTD_SQL)
def agg_ytd(m):
    return to_long(ytd_pair(m), ["year"], ["sales", "listings"], "type", "count")


@query("reshape_ytd_long", "select year, 'sales' as type, sales as count from ytd union all select year, 'listings', listings from ytd", YTD_SQL)
def reshape_ytd_long(m):
    return to_long(ytd_pair(m), ["year"], ["sales", "listings"], "type", "count")


DAILY_SQL = "daily_sales as (select sale_date as d, count(*) as n from e where sale_date is not null group by 1)"
SOLD_12MO_SQL = f"""
{ANCHORS_SQL},
{DAILY_SQL},
first_anchor as (select min(date) as first from anchors),
sold_anchor as (
  select date, coalesce(cast(sum(n) as bigint), 0) as homes_sold
  from anchors left join daily_sales
    on d <= date and d > cast(date - interval 1 year as date) group by 1),
months as (
  select cast(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
                                     interval 1 month)) as date) as date from anchors
  union select as_of from params),
sold_month as (
  select date, coalesce(cast(sum(n) as bigint), 0) as homes_sold
  from months left join daily_sales
    on d <= date and d > cast(date - interval 1 year as date) group by 1)
"""


@query(
    "join_market_speed",
    f"""select listing_id, event, date, inventory, homes_sold,
        {sql_rounded('inventory / cast(nullif(homes_sold, 0) as double) * 12')} as market_speed
        from (select listing_id, event, event_date as date, inventory from inv) join sold_anchor using (date)
        where date >= (select first + interval 1 year from first_anchor)""",
    EVENTS_SQL + "," + SOLD_12MO_SQL,
)
def join_market_speed(m):
    return fundamentals.market_speed_at_events(m.listings, AS_OF).select(
        "listing_id", "event", "date", "inventory", "homes_sold",
        rounded("market_speed").alias("market_speed"),
    )


@query(
    "join_frequent_groups",
    f"""select listing_id, entity_id from e where entity_id in
        (select entity_id from e group by 1 having count(*) >= {MIN_GROUP})""",
)
def join_frequent_groups(m):
    return frequent_groups(m.listings.select("listing_id", "entity_id"), "entity_id", MIN_GROUP)


@query("join_trailing_365d", "select listing_id, listing_date, yearly_sales from li", EVENTS_SQL + "," + SALES_365_SQL)
def join_trailing_365d(m):
    dated = m.listings.select("listing_id", "listing_date")
    return trailing_365_days(m.listings, dated, "listing_date")


@query("join_trailing_12mo", "select date, homes_sold from sold_anchor", SOLD_12MO_SQL)
def join_trailing_12mo(m):
    return fundamentals.sold_at_anchors(m.listings, AS_OF)


@query(
    "join_positional",
    """select listing_id, category, cast(row_number() over (partition by listing_year
       order by listing_date, listing_id) as bigint) as listing_count from e""",
)
def join_positional(m):
    counted = running_count(
        m.listings.select("listing_id", "listing_year", "listing_date"),
        "listing_count",
        days=["listing_date"],
        tie="listing_id",
        groups=["listing_year"],
    )
    return m.listings.select("listing_id", "category").join(
        counted.select("listing_id", "listing_count"), "listing_id"
    )


@query(
    "join_params",
    """select period, category, cast(count(*) as bigint) as listed from e, params,
       (values (60), (120), (180), (270), (360)) t(period)
       where listing_date > as_of - period group by 1, 2""",
)
def join_params(m):
    recent = F.col("listing_date") > F.date_sub(F.lit(AS_OF), F.col("period"))
    return (
        stack_params(
            enrich.recent(m.listings, "listing_date", AS_OF, max(m.config.horizons)).select("category", "listing_date"),
            "period",
            m.config.horizons,
            recent,
        )
        .groupBy("period", "category")
        .agg(F.count("*").alias("listed"))
    )


MONTHLY_SQL = """
monthly as (select cast(date_trunc('month', event_date) as date) as date, avg(inventory) as inventory
            from inv group by 1)
"""


@query("agg_monthly_inventory", f"select date, {sql_rounded('inventory')} as inventory from monthly", EVENTS_SQL + "," + MONTHLY_SQL)
def agg_monthly_inventory(m):
    return fundamentals.monthly_inventory(m.listings).select("date", rounded("inventory").alias("inventory"))


@query(
    "win_market_speed",
    f"""select date, {sql_rounded('inventory')} as inventory, homes_sold,
        {sql_rounded('inventory / cast(nullif(homes_sold, 0) as double) * 12')} as market_speed
        from monthly join sold_month using (date)
        where date >= (select first + interval 1 year from first_anchor)""",
    EVENTS_SQL + "," + MONTHLY_SQL + "," + SOLD_12MO_SQL,
)
def win_market_speed(m):
    return fundamentals.market_speed_by_month(m.listings, AS_OF).select(
        "date", rounded("inventory").alias("inventory"), "homes_sold",
        rounded("market_speed").alias("market_speed"),
    )


@query(
    "win_residence_time",
    f"""select date, homes_sold,
        {sql_rounded('(select count(*) from customer) / cast(nullif(homes_sold, 0) as double)')} as residence_time
        from sold_month where date >= (select first + interval 1 year from first_anchor)""",
    SOLD_12MO_SQL,
)
def win_residence_time(m):
    return fundamentals.residence_time(m.listings, m.total_stock.scalar(), AS_OF).select(
        "date", "homes_sold", rounded("residence_time").alias("residence_time")
    )
