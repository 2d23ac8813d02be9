"""Sorted extracts, record lists, set operations and reshaping."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marketspark.operators import enrich
from marketspark.operators.events import listing_events
from marketspark.operators.forecast import monthly_median
from marketspark.operators.ordered import dense_ranks
from marketspark.operators.reshape import latest_date, map_groups, wide_difference
from marketspark.operators.topk import group_peaks, top_with_ties
from marketspark.plans.queries_columns import OPEN_COLUMNS, OPEN_SQL, STREETS_SQL, street_turnover
from marketspark.plans.queries_windows import EVENTS_SQL
from marketspark.plans.registry import query, rounded, sql_rounded
from marketspark.sources.snapshot import materialize


@query("sort_listing_date", "select listing_id, listing_date, sale_date from e")
def sort_listing_date(m):
    return m.listings.select("listing_id", "listing_date", "sale_date").orderBy(
        F.col("listing_date").asc_nulls_last(), "listing_id"
    )


def longest_first(df):
    return df.select(*OPEN_COLUMNS).orderBy(F.col("time_on_market").desc_nulls_last(), "listing_id")


@query("sort_desc_tom", OPEN_SQL)
def sort_desc_tom(m):
    return longest_first(m.listings)


@query(
    "extract_unconfirmed",
    """select listing_id, listing_date, sale_date, cast(amount as double) as amount, category, under_contract
       from e where under_contract = 1 and sale_date is not null""",
)
def extract_unconfirmed(m):
    return enrich.unconfirmed_sales(m.listings).select(
        "listing_id", "listing_date", "sale_date", F.col("amount").cast("double").alias("amount"),
        "category", "under_contract",
    )


@query("extract_unsold", OPEN_SQL + " where sale_date is null")
def extract_unsold(m):
    return longest_first(enrich.open_listings(m.listings))


@query("extract_on_market", OPEN_SQL + " where sale_date is null and under_contract is null")
def extract_on_market(m):
    return longest_first(enrich.active_listings(m.listings))


def _ranked(column, direction, n, where="sale_date is not null"):
    return f"""select listing_id, entity_id, cast({column} as double) as {column} from (
        select *, rank() over (order by {column} {direction}) as r from e
        where {where} and {column} is not null) where r <= {n}"""


def _record(df, column):
    return df.select("listing_id", "entity_id", F.col(column).cast("double").alias(column))


@query("topk_longest", _ranked("time_on_market", "desc", 20, "true"))
def topk_longest(m):
    return _record(top_with_ties(m.listings, "time_on_market", 20), "time_on_market")


@query("topk_shortest", _ranked("time_on_market", "asc", 20, "sale_date is not null and time_on_market <> 0"))
def topk_shortest(m):
    sold = enrich.nonzero_sold(m.listings)
    return _record(top_with_ties(sold, "time_on_market", 20, largest=False), "time_on_market")


@query("topk_price_high", _ranked("amount", "desc", 20))
def topk_price_high(m):
    return _record(top_with_ties(m.sold, "amount", 20), "amount")


@query(
    "topk_price_low",
    f"""select r.*, concat_ws('.', cast(entity_id as varchar), cast(sale_date as varchar)) as entity_sale
        from ({_ranked("amount", "asc", 20)}) r join (select listing_id, sale_date from e) using (listing_id)""",
)
def topk_price_low(m):
    lowest = top_with_ties(m.sold, "amount", 20, largest=False)
    return lowest.select(
        "listing_id", "entity_id", F.col("amount").cast("double").alias("amount"),
        F.concat_ws(".", F.col("entity_id").cast("string"), F.col("sale_date").cast("string")).alias("entity_sale"),
    )


@query(
    "topk_per_group",
    """select listing_id, sale_year, day_of_sale from (
         select listing_id, sale_year, cast(dayofyear(sale_date) as int) as day_of_sale,
                rank() over (partition by sale_year order by dayofyear(sale_date) desc) as r
         from e where sale_date is not null) where r = 1""",
)
def topk_per_group(m):
    sold = m.sold.select("listing_id", "sale_year", F.dayofyear("sale_date").alias("day_of_sale"))
    return group_peaks(sold, ["sale_year"], "day_of_sale", calendar_groups=True).select("listing_id", "sale_year", "day_of_sale")


@query(
    "order_by_metric",
    f"""select street, {sql_rounded('turnover')} as turnover,
        cast(dense_rank() over (order by round(turnover, 6)) as int) as position from turn""",
    STREETS_SQL,
)
def order_by_metric(m):
    turnover = street_turnover(m).select("street", rounded("turnover").alias("turnover"))
    return dense_ranks(materialize(turnover, "street-turnover"), "turnover", "position")


@query("reshape_events", "select listing_id, event, event_date, cast(y as int) as y from ev", EVENTS_SQL)
def reshape_events(m):
    return listing_events(m.listings)


@query("reshape_latest_date", "select greatest(max(listing_date), max(sale_date)) as date from e")
def reshape_latest_date(m):
    return latest_date(m.listings.select("listing_date", "sale_date"))


@query(
    "set_union_all",
    """select listing_id, listing_date as event_date, 'listing' as type from e
       union all select listing_id, sale_date, 'sale' from e""",
)
def set_union_all(m):
    listed = m.listings.select("listing_id", F.col("listing_date").alias("event_date"), F.lit("listing").alias("type"))
    sold = m.listings.select("listing_id", F.col("sale_date").alias("event_date"), F.lit("sale").alias("type"))
    return listed.unionByName(sold)


@query("set_distinct", "select distinct listing_year, category from e")
def set_distinct(m):
    return m.listings.select("listing_year", "category").distinct()


@query(
    "reshape_wide_delta",
    f"""select category, listing_year, {sql_rounded('n2 - n1')} as difference from (
        select category, listing_year, max(n) filter (where half = 1) as n1, max(n) filter (where half = 2) as n2
        from (select category, listing_year, case when listing_month <= 6 then 1 else 2 end as half, count(*) as n
              from e group by 1, 2, 3) group by 1, 2)""",
)
def reshape_wide_delta(m):
    half = F.when(F.col("listing_month") <= 6, 1).otherwise(2)
    counts = m.listings.groupBy("category", "listing_year", half.alias("half")).agg(F.count("*").alias("n"))
    wide = wide_difference(counts, ["category", "listing_year"], "half", "n", "difference")
    return wide.withColumn("difference", rounded("difference"))


@query(
    "reshape_nest",
    f"""select category, {sql_rounded('regr_slope(v, x)')} as slope, cast(count(*) as bigint) as months from (
        select category, date_trunc('month', sale_date) as d, median(cast(amount as double)) as v,
               (date_trunc('month', sale_date)::date - date '1995-01-01') / 365.25e0 as x
        from e where sale_date is not null group by all) group by 1""",
)
def reshape_nest(m):
    def line(pdf: pd.DataFrame) -> pd.DataFrame:
        x = (pd.to_datetime(pdf["month"]) - pd.Timestamp("1995-01-01")).dt.days / 365.25
        slope = np.polyfit(x, pdf["value"], 1)[0] if len(pdf) > 1 else None
        return pd.DataFrame({"category": pdf["category"].iloc[:1], "slope": [slope], "months": [len(pdf)]})

    series = monthly_median(m.sold, "category", "sale_date", "amount")
    fitted = map_groups(series, ["category"], line, "category string, slope double, months long")
    return fitted.withColumn("slope", rounded("slope"))
