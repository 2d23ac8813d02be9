"""Derived columns, filters and extracts."""

from datetime import date

from pyspark.sql import functions as F

from marketspark.functions import dates, labels
from marketspark.operators import enrich
from marketspark.operators.turnover import (
    area_turnover,
    counts_on_stock,
    label_streets,
    label_turnover,
    turnover_limits,
)
from marketspark.plans.market import AS_OF
from marketspark.plans.registry import query, rounded, sql_rounded

OPEN_COLUMNS = ["listing_id", "listing_date", "time_on_market", "category", "under_contract"]
OPEN_SQL = "select " + ", ".join(OPEN_COLUMNS) + " from e"


@query(
    "enrich_listings",
    """select listing_id, listing_year, listing_month, sale_year, sale_month, day_of_year,
       time_on_market, status from e""",
)
def enrich_listings(m):
    return enrich.enrich_listings(m.raw_listings, AS_OF).select(
        "listing_id", "listing_year", "listing_month", "sale_year", "sale_month", "day_of_year",
        "time_on_market", "status",
    )


@query("time_on_market", "select listing_id, time_on_market from e")
def time_on_market(m):
    return m.listings.select("listing_id", "time_on_market")


@query("listing_status", "select listing_id, status from e")
def listing_status(m):
    return m.listings.select("listing_id", "status")


@query(
    "category_order",
    """select listing_id,
       case category when 'BUILDING' then 1 when 'AUTOMOBILE' then 2 when 'MACHINERY' then 3
                     when 'HOUSEHOLD' then 4 when 'FURNITURE' then 5 end as category_rank,
       case category when 'BUILDING' then 5 when 'AUTOMOBILE' then 4 when 'MACHINERY' then 3
                     when 'HOUSEHOLD' then 2 when 'FURNITURE' then 1 end as reversed_rank,
       case status when 'Sold' then 1 when 'Under Contract' then 2 when 'For Sale' then 3 end as status_rank
       from e""",
)
def category_order(m):
    order = m.config.category_order
    return m.listings.select(
        "listing_id",
        labels.rank_in(F.col("category"), order).alias("category_rank"),
        labels.rank_in(F.col("category"), order[::-1]).alias("reversed_rank"),
        labels.rank_in(F.col("status"), m.config.status_order).alias("status_rank"),
    )


@query(
    "project_columns",
    """select listing_id, entity_id, area, category, listing_date as date, sale_date, under_contract
       from e""",
)
def project_columns(m):
    listings = m.listings
    span = listings.columns
    first, last = span.index("listing_id"), span.index("sale_date")
    return (
        listings.select(*span[first : last + 1], "amount", "under_contract")
        .drop("amount")
        .withColumnRenamed("listing_date", "date")
    )


@query("filter_open", OPEN_SQL + " where sale_date is null")
def filter_open(m):
    return enrich.open_listings(m.listings).select(*OPEN_COLUMNS)


@query("filter_unconfirmed", OPEN_SQL + " where under_contract = 1 and sale_date is not null")
def filter_unconfirmed(m):
    return enrich.unconfirmed_sales(m.listings).select(*OPEN_COLUMNS)


@query("filter_active", OPEN_SQL + " where sale_date is null and under_contract is null")
def filter_active(m):
    return enrich.active_listings(m.listings).select(*OPEN_COLUMNS)


@query(
    "filter_recent",
    """select listing_id, listing_date, category from e, params
       where listing_date > as_of - 360 and category = 'BUILDING'""",
)
def filter_recent(m):
    kept = enrich.recent(m.listings, "listing_date", AS_OF, 360, "BUILDING")
    return kept.select("listing_id", "listing_date", "category")


@query(
    "filter_after_warmup",
    """select listing_id, listing_date, listing_date > start as strictly_after,
       listing_date <= (select cast(max(listing_date) - interval 6 month as date) from e) as before_note
       from e, (select cast(min(listing_date) + interval 1 year as date) as start from e)
       where listing_date >= start""",
)
def filter_after_warmup(m):
    kept = enrich.after_warmup(m.listings, "listing_date", m.first("listing_date"), inclusive=True)
    strict = F.col("listing_date") > F.add_months(m.first("listing_date").scalar(), 12)
    note = F.add_months(m.listings.agg(F.max("listing_date").alias("d")).scalar(), -6)
    return kept.select(
        "listing_id",
        "listing_date",
        strict.alias("strictly_after"),
        (F.col("listing_date") <= note).alias("before_note"),
    )


@query(
    "filter_ytd",
    """select listing_id, listing_date from e, params
       where dayofyear(listing_date) <= dayofyear(as_of)""",
)
def filter_ytd(m):
    return enrich.year_to_date(m.listings, "listing_date", AS_OF).select("listing_id", "listing_date")


@query(
    "filter_latest_year",
    """select listing_id, listing_date from e where listing_year =
       (select greatest(max(year(listing_date)), max(year(sale_date))) from e)""",
)
def filter_latest_year(m):
    kept = enrich.in_latest_year(m.listings, "listing_date", m.last_event())
    return kept.select("listing_id", "listing_date")


@query("filter_since", "select listing_id, listing_date from e where listing_date > date '1998-01-01'")
def filter_since(m):
    return enrich.since(m.listings, "listing_date", date(1998, 1, 1)).select("listing_id", "listing_date")


@query(
    "filter_not_null",
    """select listing_id, sale_date, cast(amount as double) as amount from e
       where sale_date is not null and amount is not null""",
)
def filter_not_null(m):
    kept = enrich.present(m.listings, ["sale_date", "amount"])
    return kept.select("listing_id", "sale_date", F.col("amount").cast("double").alias("amount"))


@query(
    "filter_nonzero_sold",
    "select listing_id, time_on_market from e where sale_date is not null and time_on_market <> 0",
)
def filter_nonzero_sold(m):
    return enrich.nonzero_sold(m.listings).select("listing_id", "time_on_market")


@query(
    "normalize_year",
    """select listing_id,
       case when not (month(listing_date) = 2 and day(listing_date) = 29)
            then make_date(2001, month(listing_date), day(listing_date)) end as display_date,
       cast(case when not (month(listing_date) = 2 and day(listing_date) = 29)
            then listing_date + interval 1 year end as date) as year_later
       from e""",
)
def normalize_year(m):
    latest = F.year(m.last_event().scalar())
    return m.listings.select(
        "listing_id",
        dates.normalize_year(F.col("listing_date"), latest).alias("display_date"),
        dates.plus_years(F.col("listing_date"), 1).alias("year_later"),
    )


@query(
    "normalize_doy",
    """select listing_id, cast(date '2020-01-01' + cast(day_of_year - 1 as int) as date) as display_date,
       cast(date '2020-01-01' + day_of_year as date) as shifted_date from e""",
)
def normalize_doy(m):
    d = F.col("listing_date")
    return m.listings.select(
        "listing_id",
        dates.normalize_doy(d).alias("display_date"),
        dates.normalize_doy(d, 0).alias("shifted_date"),
    )


STREETS_SQL = """
dim as (
  select distinct c_mktsegment as category,
         case when c_mktsegment <> 'BUILDING' then substr(c_mktsegment, 1, 2) end as abbreviation
  from customer),
st as (
  select e.*, case when abbreviation is null or area = 'NATION_3' then area
                   else area || ' ' || abbreviation end as street
  from e join dim using (category)),
street_stock as (
  select case when abbreviation is null or n_name = 'NATION_3' then n_name
              else n_name || ' ' || abbreviation end as street, cast(count(*) as bigint) as stock
  from customer join nation on n_nationkey = c_nationkey join dim on dim.category = c_mktsegment group by 1),
cnt as (select street, cast(count(*) as bigint) as listed from st group by 1),
turn as (
  select street, stock, coalesce(listed, 0) as listed,
         coalesce(listed, 0) / cast(stock as double) as turnover,
         case when listed > 0 then (select (max(listing_date) - min(listing_date)) / 365.25e0 from e)
              / (listed / cast(stock as double)) end as residence_time,
         case when stock > 0 and stock <= 10 then '10 homes or less per street'
              when stock > 10 and stock <= 20 then '11-20 homes per street'
              when stock > 20 then 'over 20 homes per street' end as stock_bin
  from street_stock left join cnt using (street)),
lim as (
  select (select count(*) from e) / cast(sum(stock) as double)
           - 1.959963984540054e0 * stddev_samp(turnover) / sqrt(count(*)) as lower,
         (select count(*) from e) / cast(sum(stock) as double)
           + 1.959963984540054e0 * stddev_samp(turnover) / sqrt(count(*)) as upper
  from turn)
"""


def category_dim(m):
    """(category, abbreviation) over the segments; one of them goes without."""
    short = F.when(F.col("category") != "BUILDING", F.substring("category", 1, 2))
    return m.stock("category").select("category", short.alias("abbreviation"))


def streets(m):
    """Listings with an address of three digits, blank and area, and their street label."""
    number = F.lpad((F.col("entity_id") % 1000).cast("string"), 3, "0")
    addressed = m.listings.withColumn("address", F.concat(number, F.lit(" "), "area"))
    return label_streets(addressed, category_dim(m), m.config.unsuffixed_areas)


def street_stock(m):
    """Stock per street label."""
    labelled = labels.street_label(
        F.col("area"), F.col("abbreviation"), m.config.unsuffixed_areas
    )
    return (
        m.stock("area", "category")
        .join(category_dim(m), "category")
        .groupBy(labelled.alias("street"))
        .agg(F.sum("stock").alias("stock"))
    )


def street_counts(m):
    return streets(m).groupBy("street").agg(F.count("*").alias("listed"))


def street_turnover(m):
    return area_turnover(street_counts(m), street_stock(m), m.listings)


@query("street_from_address", "select listing_id, street from st", STREETS_SQL)
def street_from_address(m):
    return streets(m).select("listing_id", "street")


@query("bucket_stock", "select street, stock, stock_bin from turn", STREETS_SQL)
def bucket_stock(m):
    return street_stock(m).select("street", "stock", labels.bucket_stock(F.col("stock")).alias("stock_bin"))


@query(
    "bucket_turnover",
    f"""select street, {sql_rounded('turnover')} as turnover,
        case when turnover > 0 and turnover <= lower then 'low'
             when turnover > lower and turnover <= upper then 'ave'
             when turnover > upper and turnover <= upper * 2 then 'higher'
             when turnover > upper * 2 then 'high' end as turnover_label
        from turn, lim""",
    STREETS_SQL,
)
def bucket_turnover(m):
    turnover = street_turnover(m)
    labelled = label_turnover(turnover, turnover_limits(turnover, m.listings))
    return labelled.select("street", rounded("turnover").alias("turnover"), "turnover_label")


@query("null_to_zero", "select street, listed from turn", STREETS_SQL)
def null_to_zero(m):
    return counts_on_stock(street_counts(m), street_stock(m), "street", "listed").select("street", "listed")


@query("flag_predicted", "select listing_id, sale_year <> year(as_of) as predicted from e, params")
def flag_predicted(m):
    return m.listings.select(
        "listing_id", (F.col("sale_year") != F.lit(AS_OF.year)).alias("predicted")
    )
