"""Aggregated reports and the dashboard."""

from datetime import date

from pyspark.sql import functions as F

from marketspark.functions.dates import caption_date
from marketspark.operators import distribution
from marketspark.operators.enrich import since
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.topk import group_peaks
from marketspark.operators.turnover import category_turnover, turnover_limits
from marketspark.plans import dashboard, reports
from marketspark.plans.flagship import listings_with_inventory
from marketspark.plans.queries_columns import STREETS_SQL, street_counts, street_turnover
from marketspark.plans.queries_joins import MIN_GROUP
from marketspark.plans.queries_windows import EVENTS_SQL, SALES_365_SQL
from marketspark.plans.registry import query, rounded, sql_rounded

LI_SQL = EVENTS_SQL + "," + SALES_365_SQL
COUNT = "cast(count(*) as bigint)"


@query("agg_listed_by_year", f"select listing_year, category, status, {COUNT} as listed_total from e group by 1, 2, 3")
def agg_listed_by_year(m):
    return reports.count_by(m.listings, ["listing_year", "category", "status"], "listed_total")


@query("agg_sold_by_year", f"select sale_year, category, status, {COUNT} as sold_total from e group by 1, 2, 3")
def agg_sold_by_year(m):
    return reports.count_by(m.listings, ["sale_year", "category", "status"], "sold_total")


@query(
    "agg_turnover_category",
    f"""select listing_year, category, listed, {sql_rounded('listed / cast(stock as double)')} as turnover,
        {sql_rounded('listed * 100 / cast(stock as double)')} as percent
        from (select listing_year, category, {COUNT} as listed from e group by 1, 2)
        join (select c_mktsegment as category, count(*) as stock from customer group by 1) using (category)""",
)
def agg_turnover_category(m):
    share = category_turnover(m.listings, m.stock("category"))
    return share.select(
        "listing_year", "category", "listed", rounded("turnover").alias("turnover"),
        rounded(F.col("turnover") * 100).alias("percent"),
    )


@query(
    "agg_median_price",
    f"""select sale_year, category, {sql_rounded('median(cast(amount as double))')} as median_price
        from e where status = 'Sold' group by 1, 2""",
)
def agg_median_price(m):
    priced = reports.median_price(m.listings.filter(F.col("status") == "Sold"), ["sale_year", "category"])
    return priced.withColumn("median_price", rounded("median_price"))


@query(
    "agg_median_tom",
    f"""select listing_year, category, status, {sql_rounded('median(cast(time_on_market as double))')} as median_time
        from e group by 1, 2, 3""",
)
def agg_median_tom(m):
    return reports.median_days(
        m.listings, ["listing_year", "category", "status"], "time_on_market", "median_time"
    ).withColumn("median_time", rounded("median_time"))


@query(
    "agg_axis_max",
    """select (listed // 10 + 1) * 10 as listing_axis, (sold_or_open // 10 + 1) * 10 as sale_axis,
       cast((floor(price / 100000) + 1) * 100000 as bigint) as price_axis,
       cast(ceil(inventory / 10.0) * 10 as bigint) as inventory_axis,
       cast(ceil(listed / 10.0) * 10 as bigint) as listing_count_axis,
       cast(ceil(sold / 10.0) * 10 as bigint) as sale_count_axis
       from (select max(n) as listed from (select count(*) as n from e group by listing_year)),
            (select max(n) as sold_or_open, max(n) filter (where sale_year is not null) as sold
             from (select sale_year, count(*) as n from e group by sale_year)),
            (select max(p) as price from (select median(cast(amount as double)) as p from e
             where status = 'Sold' group by sale_year, category)),
            (select max(i) as inventory from (select event,
             sum(y) over (order by event_date, is_sale, listing_id rows unbounded preceding) as i from ev)
             where event = 'listing')""",
    EVENTS_SQL,
)
def agg_axis_max(m):
    return reports.axis_limits(m.listings)


SEASON_SQL = """
season as (select cast(month(event_date) as int) as month, avg(inventory) as mean_inventory,
           median(cast(inventory as double)) as median_inventory from inv group by 1)
"""


@query(
    "agg_seasonal_inventory",
    f"""select month, {sql_rounded('mean_inventory')} as mean_inventory,
        {sql_rounded('median_inventory')} as median_inventory,
        cast(date '2001-01-01' + cast(floor(364.0 * (row_number() over (order by month) - 1) / 11) as int) as date)
          as display_date from season""",
    EVENTS_SQL + "," + SEASON_SQL,
)
def agg_seasonal_inventory(m):
    season = reports.seasonal_inventory(m.listings, F.year(m.last_event().scalar()))
    return season.select(
        "month", rounded("mean_inventory").alias("mean_inventory"),
        rounded("median_inventory").alias("median_inventory"), "display_date",
    )


@query(
    "agg_monthly_avg_sales",
    f"""select listing_year, listing_month, make_date(listing_year, listing_month, 1) as date,
        {sql_rounded('avg(yearly_sales)')} as average_sales from li
        where listing_date > (select min(listing_date) + interval 1 year from e) group by 1, 2""",
    LI_SQL,
)
def agg_monthly_avg_sales(m):
    return reports.monthly_average_sales(m.listings).withColumn("average_sales", rounded("average_sales"))


@query("agg_count_by_street", "select street, listed from cnt", STREETS_SQL)
def agg_count_by_street(m):
    return street_counts(m)


@query(
    "agg_turnover_area",
    f"""select street, stock, listed, {sql_rounded('turnover')} as turnover,
        {sql_rounded('residence_time')} as residence_time, stock_bin from turn""",
    STREETS_SQL,
)
def agg_turnover_area(m):
    return street_turnover(m).select(
        "street", "stock", "listed", rounded("turnover").alias("turnover"),
        rounded("residence_time").alias("residence_time"), "stock_bin",
    )


@query(
    "agg_turnover_limits",
    f"select {sql_rounded('lower')} as lower, {sql_rounded('upper')} as upper from lim",
    STREETS_SQL,
)
def agg_turnover_limits(m):
    limits = turnover_limits(street_turnover(m), m.listings)
    return limits.select(rounded("lower").alias("lower"), rounded("upper").alias("upper"))


@query(
    "agg_year_range",
    """select min(sale_year) as first_sale_year, max(sale_year) as last_sale_year,
       min(listing_date) as first_date, greatest(max(listing_date), max(sale_date)) as last_date,
       strftime(greatest(max(listing_date), max(sale_date)), '%b %d, %Y') as caption from e""",
)
def agg_year_range(m):
    last = F.greatest(F.max("listing_date"), F.max("sale_date"))
    return m.listings.agg(
        F.min("sale_year").alias("first_sale_year"),
        F.max("sale_year").alias("last_sale_year"),
        F.min("listing_date").alias("first_date"),
        last.alias("last_date"),
        caption_date(last).alias("caption"),
    )


@query(
    "agg_distinct_years",
    """select cast(count(distinct listing_year) as bigint) as listing_years,
       cast(count(distinct sale_year) as bigint) as sale_years from e""",
)
def agg_distinct_years(m):
    return m.listings.agg(
        F.countDistinct("listing_year").alias("listing_years"),
        F.countDistinct("sale_year").alias("sale_years"),
    )


@query(
    "agg_market_value",
    "select sale_year, category, cast(coalesce(sum(amount), 0) as double) as market_value from e group by 1, 2",
)
def agg_market_value(m):
    return reports.market_value(m.listings, ["sale_year", "category"])


@query("dash_listed", f"select listing_year, {COUNT} as count from e group by 1")
def dash_listed(m):
    return dashboard.listed(m.listings)


@query("dash_sold", f"select sale_year, {COUNT} as count from e where sale_year is not null group by 1")
def dash_sold(m):
    return dashboard.sold(m.listings)


@query(
    "dash_median_tom",
    f"select listing_year, {sql_rounded('median(cast(time_on_market as double))')} as time_on_market from e group by 1",
)
def dash_median_tom(m):
    return dashboard.median_time_on_market(m.listings).withColumn("time_on_market", rounded("time_on_market"))


@query(
    "dash_median_price",
    f"""select sale_year, {sql_rounded('median(cast(amount as double))')} as sale_price
        from e where sale_year is not null group by 1""",
)
def dash_median_price(m):
    return dashboard.median_sale_price(m.listings).withColumn("sale_price", rounded("sale_price"))


@query("dash_avg_inventory", f"select listing_year, {sql_rounded('avg(inventory)')} as inventory from li group by 1", LI_SQL)
def dash_avg_inventory(m):
    rows = listings_with_inventory(m.listings, carry=("listing_year",))
    return dashboard.average_inventory(rows).withColumn("inventory", rounded("inventory"))


TIME_SQL = """case when listing_year = (select min(listing_year) from e) then 0.0
  else median(inventory_time) end"""


@query(
    "dash_inventory_time",
    f"select listing_year, {sql_rounded(TIME_SQL)} as inventory_time from li group by 1",
    LI_SQL,
)
def dash_inventory_time(m):
    rows = dashboard.inventory_rows(m.listings)
    return dashboard.median_inventory_time(rows).withColumn("inventory_time", rounded("inventory_time"))


@query(
    "dash_market_value",
    "select sale_year, cast(coalesce(sum(amount), 0) as double) as market_value from e where sale_year is not null group by 1",
)
def dash_market_value(m):
    return dashboard.total_value(m.listings)


@query(
    "dash_turnover",
    f"""select sale_year, {sql_rounded('count(*) / cast((select count(*) from customer) as double)')} as turnover
        from e where sale_year is not null group by 1""",
)
def dash_turnover(m):
    return dashboard.turnover(m.listings, m.total_stock.scalar()).withColumn("turnover", rounded("turnover"))


@query(
    "dash_all",
    f"""select panel, year, {sql_rounded('value')} as value from (
        select 'listed' as panel, listing_year as year, cast(count(*) as double) as value from e group by 2
        union all select 'sold', sale_year, count(*) from e where sale_year is not null group by 2
        union all select 'time_on_market', listing_year, median(cast(time_on_market as double)) from e group by 2
        union all select 'sale_price', sale_year, median(cast(amount as double)) from e where sale_year is not null group by 2
        union all select 'inventory', listing_year, avg(inventory) from li group by 2
        union all select 'inventory_time', listing_year, {TIME_SQL} from li group by 2
        union all select 'market_value', sale_year, cast(sum(amount) as double) from e where sale_year is not null group by 2
        union all select 'turnover', sale_year, count(*) / cast((select count(*) from customer) as double)
          from e where sale_year is not null group by 2)""",
    LI_SQL,
)
def dash_all(m):
    return dashboard.all_panels(m.listings, m.total_stock.scalar()).withColumn("value", rounded("value"))


@query(
    "agg_monthly_price",
    f"""select cast(date_trunc('month', sale_date) as date) as month,
        {sql_rounded('median(cast(amount as double))')} as amount
        from e where category = 'BUILDING' and sale_date is not null group by 1""",
)
def agg_monthly_price(m):
    rows = m.sold.filter(F.col("category") == "BUILDING").select(
        F.trunc("sale_date", "MM").alias("month"), "amount"
    )
    return exact_quantiles(
        rows, ["month"], "amount", {"amount_median": 0.5}, calendar_groups=True
    ).select(
        "month", rounded("amount_median").alias("amount")
    )


LAST_DAY_SQL = """
last_day as (
  select median(d) as last_sale_day from (
    select cast(dayofyear(sale_date) as double) as d,
           rank() over (partition by sale_year order by dayofyear(sale_date) desc) as r
    from e where sale_date is not null) where r = 1)
"""


@query("agg_last_sale_day", f"select {sql_rounded('last_sale_day')} as last_sale_day from last_day", LAST_DAY_SQL)
def agg_last_sale_day(m):
    return reports.last_sale_day(m.listings).select(rounded("last_sale_day").alias("last_sale_day"))


@query("agg_having_min", f"select entity_id, {COUNT} as n from e group by 1 having count(*) >= {MIN_GROUP}")
def agg_having_min(m):
    return reports.frequent_counts(m.listings, ["entity_id"], MIN_GROUP)


VALUE_SQL = """
vby as (
  select listing_id, sale_year, sale_date, cast(dayofyear(sale_date) as int) as day_of_year,
         sum(amount) over (partition by sale_year order by sale_date, listing_id rows unbounded preceding)
           as market_value
  from e where sale_date is not null)
"""


@query(
    "agg_year_peak",
    """select listing_id, sale_year, sale_date, cast(market_value as double) as market_value from vby
       where market_value = (select max(v.market_value) from vby v where v.sale_year = vby.sale_year)""",
    VALUE_SQL,
)
def agg_year_peak(m):
    return group_peaks(
        reports.value_by_year(m.listings), ["sale_year"], "market_value", calendar_groups=True
    ).select(
        "listing_id", "sale_year", "sale_date", F.col("market_value").cast("double").alias("market_value")
    )


@query(
    "agg_violin_quantiles",
    f"""select sale_year, category, {sql_rounded("quantile_cont(a, 0.25)")} as q1,
        {sql_rounded("quantile_cont(a, 0.5)")} as median, {sql_rounded("quantile_cont(a, 0.75)")} as q3
        from (select *, cast(amount as double) as a from e) where status = 'Sold' group by 1, 2""",
)
def agg_violin_quantiles(m):
    quantiles = exact_quantiles(
        m.sold, ["sale_year", "category"], "amount", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return quantiles.select("sale_year", "category", *[rounded(c).alias(c) for c in ("q1", "median", "q3")])


GRID = 512
VIOLIN_SQL = f"""
vs as (
  select sale_year, category, count(*) as n, stddev_samp(a) as sd, min(a) as lo, max(a) as hi,
         quantile_cont(a, 0.75) - quantile_cont(a, 0.25) as iqr
  from (select sale_year, category, cast(amount as double) as a from e where sale_date is not null)
  group by 1, 2 having count(*) >= 2),
vb as (
  select *, 0.9e0 * case when least(sd, iqr / 1.34e0) > 0 then least(sd, iqr / 1.34e0)
       when sd > 0 then sd when lo <> 0 then abs(lo) else 1 end * pow(n, -0.2e0) as bw from vs),
vf as (select *, lo - 4 * bw as start, (hi - lo + 8 * bw) / {GRID - 1} as step from vb),
va as (
  select vf.*, (cast(amount as double) - start) / step as off
  from e join vf on e.sale_year = vf.sale_year and e.category = vf.category where sale_date is not null),
vm as (
  select sale_year, category, bin, sum(w) as mass from (
    select sale_year, category, cast(floor(off) as int) as bin, (1 - (off - floor(off))) / n as w from va
    union all
    select sale_year, category, cast(floor(off) as int) + 1, (off - floor(off)) / n from va) group by 1, 2, 3),
vc as (
  select vf.sale_year, vf.category, knot,
         sum(mass * exp(-0.5e0 * pow((knot - bin) * step / bw, 2)) / (bw * sqrt(2 * pi()))) as height
  from vf cross join (select cast(unnest(range({GRID})) as int) as knot)
  join vm on vm.sale_year = vf.sale_year and vm.category = vf.category group by 1, 2, 3),
vg as (
  select sale_year, category, g as grid_no, lo + (hi - lo) * g / {GRID - 1} as grid,
         (lo + (hi - lo) * g / {GRID - 1} - start) / step as pos
  from vf cross join (select cast(unnest(range({GRID})) as int) as g))
"""


@query(
    "agg_violin_stats",
    f"""select vg.sale_year, vg.category, grid_no, {sql_rounded('grid', 3)} as grid,
        {sql_rounded('1e6 * (a.height + (b.height - a.height) * (pos - floor(pos)))', 6)} as density_per_million
        from vg join vc a on a.sale_year = vg.sale_year and a.category = vg.category and a.knot = floor(pos)
        join vc b on b.sale_year = vg.sale_year and b.category = vg.category and b.knot = floor(pos) + 1""",
    VIOLIN_SQL,
)
def agg_violin_stats(m):
    curve = distribution.density(m.sold, ["sale_year", "category"], "amount", points=GRID)
    return curve.select(
        "sale_year", "category", "grid_no", rounded("grid", 3).alias("grid"),
        rounded(F.col("density") * 1e6).alias("density_per_million"),
    )


@query(
    "agg_violin_time",
    f"""select vg.listing_year, vg.category, grid_no, {sql_rounded('grid', 3)} as grid,
        {sql_rounded('1e3 * (a.height + (b.height - a.height) * (pos - floor(pos)))', 6)} as density_per_thousand
        from vg join vc a on a.listing_year = vg.listing_year and a.category = vg.category and a.knot = floor(pos)
        join vc b on b.listing_year = vg.listing_year and b.category = vg.category and b.knot = floor(pos) + 1""",
    VIOLIN_SQL.replace("sale_year", "listing_year").replace("amount", "time_on_market"),
)
def agg_violin_time(m):
    """Density of the time on market of sold listings by listing year and category."""
    curve = distribution.density(m.sold, ["listing_year", "category"], "time_on_market", points=GRID)
    return curve.select(
        "listing_year", "category", "grid_no", rounded("grid", 3).alias("grid"),
        rounded(F.col("density") * 1e3).alias("density_per_thousand"),
    )


@query(
    "agg_violin_time_quantiles",
    f"""select listing_year, category, {sql_rounded("quantile_cont(a, 0.25)")} as q1,
        {sql_rounded("quantile_cont(a, 0.5)")} as median, {sql_rounded("quantile_cont(a, 0.75)")} as q3
        from (select *, cast(time_on_market as double) as a from e) where status = 'Sold' group by 1, 2""",
)
def agg_violin_time_quantiles(m):
    quantiles = exact_quantiles(
        m.sold, ["listing_year", "category"], "time_on_market", {"q1": 0.25, "median": 0.5, "q3": 0.75}
    )
    return quantiles.select("listing_year", "category", *[rounded(c).alias(c) for c in ("q1", "median", "q3")])


BOX_SINCE = date(1998, 1, 1)
BOX_SQL = f"""
bx as (select * from e where sale_date is not null and listing_date > date '{BOX_SINCE}'),
bq as (select listing_year, quantile_cont(cast(time_on_market as double), 0.25) as q1,
       quantile_cont(cast(time_on_market as double), 0.5) as median,
       quantile_cont(cast(time_on_market as double), 0.75) as q3 from bx group by 1),
bo as (select bx.*, q1, median, q3,
       time_on_market < q1 - 1.5 * (q3 - q1) or time_on_market > q3 + 1.5 * (q3 - q1) as outlier
       from bx join bq using (listing_year))
"""


@query(
    "agg_boxplot_stats",
    f"""select listing_year, {sql_rounded('q1')} as q1, {sql_rounded('median')} as median, {sql_rounded('q3')} as q3,
        min(time_on_market) filter (where not outlier) as whisker_low,
        max(time_on_market) filter (where not outlier) as whisker_high,
        cast(count(*) filter (where outlier) as bigint) as outliers from bo group by listing_year, q1, median, q3""",
    BOX_SQL,
)
def agg_boxplot_stats(m):
    stats = distribution.box_stats(since(m.sold, "listing_date", BOX_SINCE), ["listing_year"], "time_on_market")
    return stats.withColumns({c: rounded(c) for c in ("q1", "median", "q3")})


@query("agg_boxplot_outliers", "select listing_id, listing_year, time_on_market from bo where outlier", BOX_SQL)
def agg_boxplot_outliers(m):
    rows = since(m.sold, "listing_date", BOX_SINCE)
    return distribution.box_outliers(rows, ["listing_year"], "time_on_market").select(
        "listing_id", "listing_year", "time_on_market"
    )
