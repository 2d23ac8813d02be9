from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketspark.sources import files, schema, snapshot, spine
from marketspark.sources.adapter import listings_from_orders, stock_by

AS_OF = date(2022, 5, 9)


def test_listing_file_with_bom_comments_and_empty_fields(spark, tmp_path):
    path = tmp_path / "listings.csv"
    path.write_text(
        "﻿address,listingdate,saledate,amount,hometype,undercontract\n"
        "11 Larch,02-14-2015,11-30-2015,98750,cabin,\n"
        "12 Maple,10-05-2019,12-24-2019,410300,cabin,1\n"
        "13 Larch,08-21-2020,,,cabin,1\n"
        "# corrected by hand,,,,\n",
        encoding="utf-8",
    )
    rows = files.read_listings(spark, str(path)).collect()
    assert [r.address for r in rows] == ["11 Larch", "12 Maple", "13 Larch"]
    assert rows[0].listingdate == date(2015, 2, 14) and rows[0].amount == Decimal("98750.00")
    assert rows[0].undercontract is None
    assert rows[2].saledate is None and rows[2].amount is None and rows[2].undercontract == 1


def test_dimension_trims_blanks_and_keeps_missing_abbreviation(spark, tmp_path):
    streets = tmp_path / "streets.csv"
    streets.write_text("streetname,numberofhomes\nOak,5 \nElm,27 \n")
    types = tmp_path / "types.csv"
    types.write_text("hometype,hometypeAB\ntownhome,TH\npatio home, PH\nresidential,\n")
    stock = files.read_dimension(spark, str(streets), schema.STREET_STOCK_FILE)
    assert {r.streetname: r.numberofhomes for r in stock.collect()} == {"Oak": 5, "Elm": 27}
    short = files.read_dimension(spark, str(types), schema.CATEGORY_FILE)
    assert {r.hometype: r.hometypeAB for r in short.collect()} == {
        "townhome": "TH", "patio home": "PH", "residential": None,
    }


def test_processed_file_reads_na_as_null(spark, tmp_path):
    path = tmp_path / "processed.csv"
    path.write_text(
        ",".join(schema.PROCESSED_FILE.names) + "\n"
        "14 Birch,2018-07-19,NA,NA,cabin,NA,4,17,2018,7,NA,NA,200,65,For Sale,16,3.25\n"
    )
    row = files.read_processed(spark, str(path), schema.PROCESSED_FILE).first()
    assert row.saledate is None and row.amount is None and row.saleyear is None
    assert row.inventory == 4 and row.inventorytime == pytest.approx(3.25)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", date(2020, 2, 29)), (2, None, None)], "id int, name string, day date"
    )
    path = str(tmp_path / "out")
    files.write_csv(df, path)
    assert sorted(files.read_processed(spark, path, df.schema).collect()) == sorted(df.collect())


def test_snapshot_round_trip_and_partition_pruning(spark, make_listings, skewed_rows):
    df = make_listings(skewed_rows).withColumn("listing_year", F.year("listing_date"))
    kept = snapshot.materialize(df, "test", "listing_year")
    assert sorted(kept.select(df.columns).collect(), key=str) == sorted(df.collect(), key=str)
    plan = kept.filter("listing_year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(listing_year" in plan


def test_shared_dir_is_the_configured_one(spark):
    assert snapshot.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_month_spine_holds_each_date_once(spark):
    one = spark.range(1).select(F.lit(date(2021, 11, 17)).alias("lo"), F.lit(date(2022, 2, 3)).alias("hi"))

    def months(as_of):
        return sorted(r.date for r in spine.month_spine(one, F.col("lo"), F.col("hi"), as_of).collect())

    firsts = [date(2021, 11, 1), date(2021, 12, 1), date(2022, 1, 1), date(2022, 2, 1)]
    assert months(date(2022, 2, 1)) == firsts
    assert months(date(2022, 2, 3)) == firsts + [date(2022, 2, 3)]


def test_event_anchors_ignore_nulls(spark, make_listings):
    df = make_listings(
        [
            (1, 1, "x", "a", date(2020, 1, 1), date(2020, 1, 5), 10, None),
            (2, 1, "x", "a", date(2020, 1, 5), None, None, None),
        ]
    )
    anchors = spine.event_anchors(df, ["listing_date", "sale_date"], AS_OF)
    assert sorted(r.date for r in anchors.collect()) == [date(2020, 1, 1), date(2020, 1, 5), AS_OF]


def test_grid_and_constants(spark):
    assert [r.x for r in spine.literal_grid(spark, [1, 91], "x").collect()] == [1, 91]
    stock = {r.category: r.stock for r in spine.stock_constants(spark, {"town": 32, "patio": 34}).collect()}
    assert stock == {"town": 32, "patio": 34}


def test_adapter_takes_first_shipment_not_before_the_order(spark):
    orders = spark.createDataFrame(
        [(1, 10, "F", 99.5, date(2000, 1, 10)), (2, 10, "P", 5.0, date(2000, 2, 1)), (3, 11, "O", 7.0, date(2000, 3, 1))],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date",
    )
    lines = spark.createDataFrame(
        [(1, date(2000, 1, 9)), (1, date(2000, 1, 20)), (1, date(2000, 1, 15)), (3, date(2000, 2, 1))],
        "l_orderkey long, l_shipdate date",
    )
    customer = spark.createDataFrame(
        [(10, 0, "seg"), (11, 1, "seg"), (12, 1, "other")], "c_custkey long, c_nationkey int, c_mktsegment string"
    )
    nation = spark.createDataFrame([(0, "north"), (1, "south")], "n_nationkey int, n_name string")
    rows = {r.listing_id: r for r in listings_from_orders(orders, lines, customer, nation).collect()}
    assert rows[1].sale_date == date(2000, 1, 15) and rows[1].amount == Decimal("99.50")
    assert rows[2].sale_date is None and rows[2].amount is None and rows[2].under_contract == 1
    assert rows[3].sale_date is None and rows[3].area == "south"
    stock = {r.area: r.stock for r in stock_by(customer, nation, "area").collect()}
    assert stock == {"north": 1, "south": 2}
