"""One market over the order tables: what every registered query starts from."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from marketspark.config import MarketConfig
from marketspark.operators.enrich import enrich_listings
from marketspark.sources.adapter import listings_from_orders, stock_by
from marketspark.sources.snapshot import materialize

AS_OF = date(2001, 8, 1)

_snapshots: dict[tuple, DataFrame] = {}


class Market:
    """Tables of one data folder.

    ``listings`` is the enriched listing table. It is written once per session to the shared folder,
    laid out by listing year, because most reports read it more than once: each then scans only its
    own columns instead of joining orders and line items again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        segments = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")
        self.config = MarketConfig(
            as_of=AS_OF, category_order=segments, unsuffixed_areas=("NATION_3",)
        )

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def raw_listings(self) -> DataFrame:
        return listings_from_orders(
            self.table("orders"), self.table("lineitem"), self.table("customer"), self.table("nation")
        )

    def once(self, name: str, build, partition_by: str | None = None) -> DataFrame:
        """The table ``name`` of this folder, written the first time a session asks for it.

        It is written anew once one of the tables it comes from has changed.
        """
        key = (self.spark.sparkContext.applicationId, self.dir, self._stamps(), name)
        if key not in _snapshots:
            _snapshots[key] = materialize(build(), name, partition_by)
        return _snapshots[key]

    def _stamps(self) -> tuple[int, ...]:
        """When each table was last written, as its file system tells."""
        context = self.spark.sparkContext
        path_of = context._jvm.org.apache.hadoop.fs.Path
        paths = [path_of(f"{self.dir}/{name}.parquet") for name in ("orders", "lineitem", "customer", "nation")]
        return tuple(p.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in paths)

    @property
    def listings(self) -> DataFrame:
        return self.once(
            "listings",
            lambda: enrich_listings(self.raw_listings, self.config.as_of),
            partition_by="listing_year",
        )

    @property
    def sold(self) -> DataFrame:
        return self.listings.filter(F.col("sale_date").isNotNull())

    @property
    def sales(self) -> DataFrame:
        """The sold listings laid out by sale year, for reports on the sales since a date."""
        columns = ["listing_id", "category", "sale_date", "sale_year", "amount"]
        return self.once("sales", lambda: self.sold.select(columns), partition_by="sale_year")

    def stock(self, *keys: str) -> DataFrame:
        """Entities per key, as a dimension table of known size."""
        return self.once(
            "stock-" + "-".join(keys),
            lambda: stock_by(self.table("customer"), self.table("nation"), *keys),
        )

    @property
    def total_stock(self) -> DataFrame:
        return self.table("customer").agg(F.count("*").alias("stock"))

    def first(self, column: str, df: DataFrame | None = None) -> DataFrame:
        return (self.listings if df is None else df).agg(F.min(column).alias("first"))

    def last_event(self) -> DataFrame:
        """Latest listing or sale date."""
        return self.listings.agg(
            F.greatest(F.max("listing_date"), F.max("sale_date")).alias("last")
        )
