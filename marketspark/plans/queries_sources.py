"""Readers, writers, spines and constants."""

from pyspark.sql import functions as F

from marketspark.operators.enrich import enrich_listings
from marketspark.plans.market import AS_OF
from marketspark.plans.registry import as_double, query
from marketspark.sources import files, schema, snapshot, spine

LISTING_ROW = "listing_id", "entity_id", "area", "category", "listing_date", "sale_date"
LISTING_SQL = f"select {', '.join(LISTING_ROW)}, cast(amount as double) as amount, under_contract from l"


def _file_shape(m):
    """Listings in the shape of a listing file; the order id stands in for the house number."""
    return m.raw_listings.select(
        F.concat_ws(" ", F.col("listing_id").cast("string"), "area").alias("address"),
        F.col("listing_date").alias("listingdate"),
        F.col("sale_date").alias("saledate"),
        "amount",
        F.col("category").alias("hometype"),
        F.col("under_contract").alias("undercontract"),
    )


@query(
    "src_listings",
    """select concat_ws(' ', cast(listing_id as varchar), area) as address, listing_date as listingdate,
       sale_date as saledate, cast(amount as double) as amount, category as hometype,
       under_contract as undercontract from l""",
)
def src_listings(m):
    path = snapshot.scratch_path(m.spark, "listing-file")
    files.write_csv(_file_shape(m), path, null_value="", date_format="MM-dd-yyyy")
    return files.read_listings(m.spark, path).withColumn("amount", as_double("amount"))


@query(
    "src_dimension",
    """select n_name as streetname, cast(count(*) as int) as numberofhomes
       from customer join nation on n_nationkey = c_nationkey group by 1""",
)
def src_dimension(m):
    padded = m.stock("area").select(
        F.concat(F.lit(" "), "area").alias("streetname"),
        F.concat(F.col("stock").cast("string"), F.lit(" ")).alias("numberofhomes"),
    )
    path = snapshot.scratch_path(m.spark, "dimension-file")
    padded.write.csv(
        path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return files.read_dimension(m.spark, path, schema.STREET_STOCK_FILE)


PROCESSED_SQL = """select cast(entity_id as varchar) as address, listing_date as listingdate,
  sale_date as saledate, category as hometype, under_contract as undercontract,
  listing_year as listingyear, sale_year as saleyear, day_of_year as dayofyear,
  time_on_market as timeonmarket, status from e"""
PROCESSED = {
    "listingdate": "listing_date",
    "saledate": "sale_date",
    "hometype": "category",
    "undercontract": "under_contract",
    "listingyear": "listing_year",
    "saleyear": "sale_year",
    "dayofyear": "day_of_year",
    "timeonmarket": "time_on_market",
    "status": "status",
}


def _processed(m):
    return enrich_listings(m.raw_listings, AS_OF).select(
        F.col("entity_id").cast("string").alias("address"),
        *[F.col(old).alias(new) for new, old in PROCESSED.items()],
    )


def _processed_round_trip(m, name):
    path = snapshot.scratch_path(m.spark, name)
    written = _processed(m)
    files.write_csv(written, path)
    return files.read_processed(m.spark, path, written.schema)


@query("src_processed", PROCESSED_SQL)
def src_processed(m):
    return _processed_round_trip(m, "processed-file")


@query("snk_csv", PROCESSED_SQL + " where sale_date is null")
def snk_csv(m):
    path = snapshot.scratch_path(m.spark, "extract-file")
    extract = _processed(m).filter(F.col("saledate").isNull())
    files.write_csv(extract, path)
    return files.read_processed(m.spark, path, extract.schema)


@query(
    "src_constants",
    """select c_mktsegment as category, cast(count(*) as bigint) as stock from customer group by 1
       union all select 'all', cast(count(*) as bigint) from customer""",
)
def src_constants(m):
    per_category = m.stock("category")
    return per_category.unionByName(
        per_category.agg(F.sum("stock").alias("stock")).select(F.lit("all").alias("category"), "stock")
    )


SNAPSHOT_SQL = f"""select {', '.join(LISTING_ROW)}, listing_year, sale_year, time_on_market, status,
  cast(amount as double) as amount from e"""
SNAPSHOT_ROW = [*LISTING_ROW, "listing_year", "sale_year", "time_on_market", "status"]


@query("snk_snapshot", SNAPSHOT_SQL)
def snk_snapshot(m):
    written = snapshot.materialize(
        enrich_listings(m.raw_listings, AS_OF), "snapshot-round-trip", "listing_year"
    )
    return written.select(*SNAPSHOT_ROW, as_double("amount").alias("amount"))


@query("src_snapshot", SNAPSHOT_SQL)
def src_snapshot(m):
    return m.listings.select(*SNAPSHOT_ROW, as_double("amount").alias("amount"))


@query(
    "src_month_spine",
    """select distinct date from (
         select cast(unnest(generate_series(date_trunc('month', least(min(listing_date), min(sale_date))),
                date_trunc('month', greatest(max(listing_date), max(sale_date), (select as_of from params))),
                interval 1 month)) as date) as date from l where sale_date is not null
         union all select as_of from params)""",
)
def src_month_spine(m):
    bounds = m.sold.agg(
        F.least(F.min("listing_date"), F.min("sale_date")).alias("lo"),
        F.greatest(F.max("listing_date"), F.max("sale_date"), F.lit(AS_OF)).alias("hi"),
    )
    return spine.month_spine(bounds, F.col("lo"), F.col("hi"), AS_OF)


ANCHORS_SQL = """
anchors as (
  select listing_date as date from l where sale_date is not null
  union select sale_date from l where sale_date is not null
  union select as_of from params)
"""


@query("src_event_anchors", "select date from anchors", ANCHORS_SQL)
def src_event_anchors(m):
    return spine.event_anchors(m.sold, ["listing_date", "sale_date"], AS_OF)


@query(
    "src_literal_grid",
    """select sale_year, x as day_of_year from (select distinct sale_year from e where sale_year is not null)
       cross join (values (1), (91), (182), (365)) t(x)""",
)
def src_literal_grid(m):
    years = m.sold.select("sale_year").distinct()
    return years.crossJoin(spine.literal_grid(m.spark, m.config.sale_count_days, "day_of_year"))
