"""Order-dependent reports."""

from datetime import date

from pyspark.sql import functions as F

from marketspark.functions.dates import months_of, normalize_doy, normalize_year
from marketspark.functions.labels import resale_label
from marketspark.operators.enrich import recent, since
from marketspark.operators.events import listing_events, running_inventory
from marketspark.operators.ordered import (
    carry_forward,
    previous_value,
    repeated_keys,
    running_count,
    running_sums,
    trailing_rows,
)
from marketspark.operators.regression import interpolate_at, recent_history
from marketspark.operators.reshape import stack_params
from marketspark.plans import reports
from marketspark.plans.flagship import listings_with_inventory
from marketspark.plans.market import AS_OF
from marketspark.plans.registry import query, rounded, sql_rounded

EVENTS_SQL = """
ev as (
  select listing_id, 'listing' as event, listing_date as event_date, 1 as y, 0 as is_sale from e
  union all
  select listing_id, 'sale', sale_date, -1, 1 from e where sale_date is not null),
inv as (
  select listing_id, event, event_date,
         cast(sum(y) over (order by event_date, listing_id, is_sale rows unbounded preceding) as bigint)
           as inventory
  from ev)
"""
SALES_365_SQL = """
daily as (select sale_date as d, count(*) as n from e where sale_date is not null group by 1),
ys as (
  select x.listing_date, coalesce(cast(sum(n) as bigint), 0) as yearly_sales
  from (select distinct listing_date from e) x
  left join daily on d <= x.listing_date and d > x.listing_date - 365
  group by 1),
li as (
  select e.*, inv.inventory, ys.yearly_sales,
         case when ys.yearly_sales > 0 then inv.inventory / cast(ys.yearly_sales as double) * 12 end
           as inventory_time
  from e join inv on inv.listing_id = e.listing_id and inv.event = 'listing'
  join ys on ys.listing_date = e.listing_date)
"""


@query(
    "win_running_inventory",
    "select listing_id, event, event_date, inventory from inv",
    EVENTS_SQL,
)
def win_running_inventory(m):
    return running_inventory(m.listings).select("listing_id", "event", "event_date", "inventory")


@query(
    "win_running_inventory_bind",
    """select listing_id, event, event_date,
       cast(sum(y) over (order by event_date, is_sale, listing_id rows unbounded preceding) as bigint)
         as inventory from ev""",
    EVENTS_SQL,
)
def win_running_inventory_bind(m):
    return running_inventory(m.listings, "listings_first").select(
        "listing_id", "event", "event_date", "inventory"
    )


@query(
    "win_inventory_time",
    f"select listing_id, inventory, yearly_sales, {sql_rounded('inventory_time')} as inventory_time from li",
    EVENTS_SQL + "," + SALES_365_SQL,
)
def win_inventory_time(m):
    return listings_with_inventory(m.listings).select(
        "listing_id", "inventory", "yearly_sales", rounded("inventory_time").alias("inventory_time")
    )


def year_counter(listings, carry=()):
    """Running listing count within the listing year."""
    return running_count(
        listings.select("listing_id", "listing_year", "listing_date", *carry),
        "listing_count",
        days=["listing_date"],
        tie="listing_id",
        groups=["listing_year"],
    )


@query(
    "win_listing_counter",
    """select listing_id, listing_year, listing_date, cast(row_number() over (partition by listing_year
       order by listing_date, listing_id) as bigint) as listing_count from e""",
)
def win_listing_counter(m):
    return year_counter(m.listings)


@query(
    "win_sale_counter",
    """select listing_id, sale_year, sale_date, cast(dayofyear(sale_date) as int) as day_of_year,
       cast(row_number() over (partition by sale_year order by sale_date, listing_id) as bigint) as sale_count
       from e where sale_date is not null""",
)
def win_sale_counter(m):
    return reports.sale_counter(m.listings)


@query(
    "win_event_counter",
    """select listing_id, event, cast(year(event_date) as int) as year,
       cast(date '2020-01-01' + cast(dayofyear(event_date) as int) as date) as display_date,
       cast(abs(sum(y) over (partition by year(event_date), event order by event_date, listing_id
            rows unbounded preceding)) as bigint) as count_up from ev""",
    EVENTS_SQL,
)
def win_event_counter(m):
    events = listing_events(m.listings).withColumn("year", F.year("event_date"))
    counted = running_sums(
        events,
        {"count_up": F.col("y").cast("long")},
        days=["event_date"],
        tie="listing_id",
        groups=["year", "event"],
    )
    return counted.select(
        "listing_id", "event", "year", normalize_doy(F.col("event_date"), 0).alias("display_date"),
        F.abs("count_up").alias("count_up"),
    )


@query(
    "win_value_by_year",
    """select listing_id, sale_year, sale_date, cast(dayofyear(sale_date) as int) as day_of_year,
       cast(sum(amount) over (partition by sale_year order by sale_date, listing_id rows unbounded preceding)
            as double) as market_value from e where sale_date is not null""",
)
def win_value_by_year(m):
    return reports.value_by_year(m.listings).select(
        "listing_id", "sale_year", "sale_date", "day_of_year",
        F.col("market_value").cast("double").alias("market_value"),
    )


@query(
    "win_value_total",
    """select listing_id, sale_date, cast(sale_date - (select min(sale_date) from e) as int) as time,
       cast(sum(amount) over (order by sale_date, listing_id rows unbounded preceding) as double)
         as total_amount from e where sale_date is not null""",
)
def win_value_total(m):
    return reports.value_total(m.listings).select(
        "listing_id", "sale_date", "time", F.col("total_amount").cast("double").alias("total_amount")
    )


PERIODS_SQL = "periods as (select unnest([60, 120, 180, 270, 360]) as period)"


@query(
    "win_period_cumulative",
    """select listing_id, category, period, sale_date,
       cast(sum(amount) over w as double) as total_amount, cast(count(*) over w as bigint) as sales
       from e, params, periods where amount is not null and sale_date > as_of - period
       window w as (partition by period, category order by sale_date, listing_id rows unbounded preceding)""",
    PERIODS_SQL,
)
def win_period_cumulative(m):
    rows = recent(m.sales, "sale_date", AS_OF, max(m.config.horizons)).select(
        "listing_id", "category", "sale_date", "amount"
    )
    stacked = stack_params(
        rows, "period", m.config.horizons, F.col("sale_date") > F.date_sub(F.lit(AS_OF), F.col("period"))
    )
    summed = running_sums(
        stacked,
        {"total_amount": F.col("amount"), "sales": F.lit(1).cast("long")},
        days=["sale_date"],
        tie="listing_id",
        groups=["period", "category"],
    )
    return summed.select(
        "listing_id", "category", "period", "sale_date",
        F.col("total_amount").cast("double").alias("total_amount"), "sales",
    )


HISTORY_SQL = """
hist as (
  select *, cast(row_number() over w as bigint) as cumulative_listing,
         case when count(*) filter (where amount is null) over w = 0
              then cast(sum(amount) over w as double) end as cumulative_value
  from e, params where listing_date > as_of - 360 and category = 'BUILDING'
  window w as (order by listing_date, listing_id rows unbounded preceding))
"""


def history(m):
    return recent_history(m.listings, "BUILDING", max(m.config.trend_horizons), AS_OF)


@query(
    "win_cumulative_nullpoison",
    "select listing_id, listing_date, cumulative_listing, cumulative_value from hist",
    HISTORY_SQL,
)
def win_cumulative_nullpoison(m):
    return history(m).select(
        "listing_id", "listing_date", "cumulative_listing",
        F.col("cumulative_value").cast("double").alias("cumulative_value"),
    )


INTERP_SQL = """
pts as (select listing_date as x, avg(cumulative_listing) as y from hist group by 1),
nb as (select max(x) filter (where x <= d) as x0, min(x) filter (where x >= d) as x1, max(d) as d
       from pts, (select cast(date_trunc('year', as_of) as date) as d from params)),
base as (
  select case when x0 = x1 then a.y else a.y + (b.y - a.y) * (d - x0) / cast(nullif(x1 - x0, 0) as double) end as y
  from nb left join pts a on a.x = x0 left join pts b on b.x = x1)
"""


@query(
    "win_rebased_cumulative",
    f"""select listing_id, listing_date, {sql_rounded('cumulative_listing - (select y from base)')}
        as cumulative_listing from hist""",
    HISTORY_SQL + "," + INTERP_SQL,
)
def win_rebased_cumulative(m):
    rows = history(m)
    base = interpolate_at(rows, "listing_date", "cumulative_listing", F.trunc(F.lit(AS_OF), "YEAR"))
    rebased = F.col("cumulative_listing") - base.scalar()
    return rows.select("listing_id", "listing_date", rounded(rebased).alias("cumulative_listing"))


REBASED_VALUE_SQL = (
    HISTORY_SQL
    + """,
hv as (select *, cast(sum(coalesce(amount, 0)) over (order by listing_date, listing_id rows unbounded preceding) as double) as sold_value from hist),
"""
    + INTERP_SQL.replace("cumulative_listing", "sold_value").replace("from hist", "from hv")
    + """,
ptn as (select listing_date as x, avg(cumulative_value) as y from hist where cumulative_value is not null group by 1),
nbn as (select max(x) filter (where x <= d) as x0, min(x) filter (where x >= d) as x1, max(d) as d from ptn, (select max(d) as d from nb)),
basen as (
  select case when x0 = x1 then a.y else a.y + (b.y - a.y) * (d - x0) / cast(nullif(x1 - x0, 0) as double) end as y
  from nbn left join ptn a on a.x = x0 left join ptn b on b.x = x1)
"""
)


@query(
    "win_rebased_value",
    f"""select listing_id, listing_date, {sql_rounded('sold_value - (select y from base)', 2)} as cumulative_value,
        {sql_rounded('cumulative_value - (select y from basen)', 2)} as null_after_null from hv""",
    REBASED_VALUE_SQL,
)
def win_rebased_value(m):
    """Running amount less its value at the start of the year: open listings as zero, and as the end of all values."""
    rows, at = history(m), F.trunc(F.lit(AS_OF), "YEAR")
    base = {c: interpolate_at(rows, "listing_date", c, at).scalar() for c in ("sold_value", "cumulative_value")}
    return rows.select(
        "listing_id", "listing_date", rounded(F.col("sold_value").cast("double") - base["sold_value"], 2).alias("cumulative_value"),
        rounded(F.col("cumulative_value").cast("double") - base["cumulative_value"], 2).alias("null_after_null"),
    )


@query("interp_at_value", f"select {sql_rounded('y', 2)} as y from base", REBASED_VALUE_SQL)
def interp_at_value(m):
    base = interpolate_at(history(m), "listing_date", "sold_value", F.trunc(F.lit(AS_OF), "YEAR"))
    return base.select(rounded("y", 2).alias("y"))


@query("interp_at", f"select {sql_rounded('y')} as y from base", HISTORY_SQL + "," + INTERP_SQL)
def interp_at(m):
    at = F.trunc(F.lit(AS_OF), "YEAR")
    base = interpolate_at(history(m), "listing_date", "cumulative_listing", at)
    return base.select(rounded("y").alias("y"))


RESALE_SQL = """
rs as (
  select listing_id, entity_id, listing_date,
         (listing_date - lag(sale_date) over (partition by entity_id order by listing_date, listing_id))
           / 30.4375e0 as lag_time
  from e where entity_id in (select entity_id from e group by 1 having count(*) > 1))
"""


def resale_lags(listings):
    """Months between a sale and the next listing of the same entity."""
    before = previous_value(
        listings.select("listing_id", "entity_id", "listing_date", "sale_date"),
        "previous_sale",
        "sale_date",
        key="entity_id",
        day="listing_date",
        tie="listing_id",
        repeated_only=True,
    )
    return before.withColumn("lag_time", months_of(F.datediff("listing_date", "previous_sale")))


@query(
    "win_resale_lag",
    f"select listing_id, entity_id, {sql_rounded('lag_time')} as lag_time from rs",
    RESALE_SQL,
)
def win_resale_lag(m):
    return resale_lags(m.listings).select("listing_id", "entity_id", rounded("lag_time").alias("lag_time"))


def resale_report(m):
    """Resale lags with their label, shortest first."""
    lags = resale_lags(m.listings).filter(F.col("lag_time").isNotNull())
    return lags.orderBy("lag_time", "listing_id").select(
        "listing_id",
        rounded("lag_time").alias("lag_time"),
        resale_label(F.col("entity_id").cast("string"), F.col("lag_time")).alias("label"),
    )


@query(
    "win_resale_report",
    f"""select listing_id, {sql_rounded('lag_time')} as lag_time,
        entity_id || ' (' || cast(round_even(lag_time, 1) + 0.0 as varchar) || ')' as label
        from rs where lag_time is not null""",
    RESALE_SQL,
)
def win_resale_report(m):
    return resale_report(m)


@query(
    "resale_label",
    """select listing_id, entity_id || ' (' || cast(round_even(lag_time, 1) + 0.0 as varchar) || ')' as label
       from rs where lag_time is not null""",
    RESALE_SQL,
)
def resale_label_query(m):
    return resale_report(m).select("listing_id", "label")


@query(
    "win_inventory_overlay",
    f"""select 'year' as series, listing_id, event, cast(year(event_date) as int) as year,
        case when not (month(event_date) = 2 and day(event_date) = 29)
             then make_date(2001, month(event_date), day(event_date)) end as display_date,
        cast(inventory as double) as inventory from inv
        union all
        select 'mean', null, null, null,
        cast(date '2001-01-01' + cast(floor(364.0 * (row_number() over (order by month) - 1) / 11) as int) as date),
        {sql_rounded('mean_inventory')} from (select month(event_date) as month, avg(inventory) as mean_inventory
                                            from inv group by 1)""",
    EVENTS_SQL,
)
def win_inventory_overlay(m):
    latest = F.year(m.last_event().scalar())
    years = running_inventory(m.listings).select(
        F.lit("year").alias("series"),
        "listing_id",
        "event",
        F.year("event_date").alias("year"),
        normalize_year(F.col("event_date"), latest).alias("display_date"),
        F.col("inventory").cast("double").alias("inventory"),
    )
    means = running_inventory(m.listings).groupBy(F.month("event_date").alias("month")).agg(
        F.avg("inventory").alias("inventory")
    )
    profile = means.select(
        F.lit("mean").alias("series"),
        reports.pinned_month(latest).alias("display_date"),
        rounded("inventory").alias("inventory"),
    )
    return years.unionByName(profile, allowMissingColumns=True)


@query(
    "win_duplicates",
    "select listing_id, entity_id from e where entity_id in (select entity_id from e group by 1 having count(*) > 1)",
)
def win_duplicates(m):
    return repeated_keys(m.listings.select("listing_id", "entity_id"), "entity_id")


ROLLING_SQL = """
rl as (
  select listing_id, listing_date,
         case when row_number() over w >= 19 then median(cast(time_on_market as double)) over f end as time_med,
         case when row_number() over w >= 19 then avg(cast(time_on_market as double)) over f end as time_av
  from e where sale_date is not null
  window w as (order by listing_date, listing_id),
         f as (order by listing_date, listing_id rows 18 preceding))
"""


def rolling(m, aggregates):
    rows = m.sold.select("listing_id", "listing_date", F.col("time_on_market").cast("double").alias("t"))
    rolled = trailing_rows(
        rows, aggregates, rows=m.config.rolling_rows, day="listing_date", tie="listing_id"
    )
    return since(rolled, "listing_date", date(1998, 1, 1))


@query(
    "win_rolling_median",
    f"select listing_id, {sql_rounded('time_med')} as time_med from rl where listing_date > date '1998-01-01'",
    ROLLING_SQL,
)
def win_rolling_median(m):
    rolled = rolling(m, {"time_med": F.percentile("t", F.lit(0.5))})
    return rolled.select("listing_id", rounded("time_med").alias("time_med"))


@query(
    "win_rolling_mean",
    f"select listing_id, {sql_rounded('time_av')} as time_av from rl where listing_date > date '1998-01-01'",
    ROLLING_SQL,
)
def win_rolling_mean(m):
    rolled = rolling(m, {"time_av": F.avg("t")})
    return rolled.select("listing_id", rounded("time_av").alias("time_av"))


@query(
    "win_locf",
    f"""select listing_year, listing_month,
        {sql_rounded('last_value(a ignore nulls) over (partition by listing_year order by listing_month)')} as average_price
        from (select y.listing_year, cast(y.listing_month as int) as listing_month, a
              from (select listing_year, unnest(range(1, 13)) as listing_month from (select distinct listing_year from e)) y
              left join (select listing_year, listing_month, avg(amount) as a from e group by 1, 2) m
                on m.listing_year = y.listing_year and m.listing_month = y.listing_month)""",
)
def win_locf(m):
    average = m.listings.groupBy("listing_year", "listing_month").agg(
        F.avg(F.col("amount").cast("double")).alias("average_price")
    )
    months = m.listings.select("listing_year").distinct().withColumn(
        "listing_month", F.explode(F.sequence(F.lit(1), F.lit(12)))
    )
    monthly = months.join(average, ["listing_year", "listing_month"], "left")
    return carry_forward(
        monthly, "average_price", groups=["listing_year"], order="listing_month"
    ).withColumn("average_price", rounded("average_price"))
