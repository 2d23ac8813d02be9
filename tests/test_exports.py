from datetime import date

from marketspark.operators.enrich import enrich_listings
from marketspark.plans import exports

AS_OF = date(2022, 5, 9)


def test_extracts(make_listings):
    """Open listings longest first; sold but flagged; none left without a contract."""
    rows = [
        (1, 460, "x", "residential", date(2022, 4, 3), None, None, 1),
        (2, 108, "x", "residential", date(2022, 4, 11), None, None, 1),
        (3, 228, "x", "townhome", date(2022, 5, 2), None, None, 1),
        (4, 556, "x", "residential", date(2022, 3, 18), date(2022, 5, 6), 360000, 1),
        (5, 580, "x", "residential", date(2022, 4, 5), date(2022, 5, 3), 298000, None),
    ]
    lists = exports.extracts(enrich_listings(make_listings(rows), AS_OF), "entity_id")
    assert [(r.entity_id, r.time_on_market) for r in lists["unsold"].collect()] == [(460, 36), (108, 28), (228, 7)]
    assert [r.entity_id for r in lists["unconfirmed_sales"].collect()] == [556]
    assert lists["on_market"].collect() == []
    assert sorted(r.amount for r in lists["top_sales"].collect()) == [298000, 360000]


def test_all_outputs_are_written(spark, make_listings, skewed_rows, tmp_path):
    listings = enrich_listings(make_listings(skewed_rows), AS_OF)
    stock = spark.createDataFrame([("a", 50), ("b", 60), ("common", 70)], "category string, stock long")
    paths = exports.write_all(listings, stock, "entity_id", str(tmp_path))
    assert len(paths) == 10
    read = {path.rsplit("/", 1)[-1]: spark.read.csv(path, header=True, nullValue="NA") for path in paths}
    assert read["processed"].count() == len(skewed_rows)
    assert {"inventory", "listing_count", "yearly_sales", "inventory_time"} <= set(read["processed"].columns)
    assert read["unsold"].count() == sum(r[5] is None for r in skewed_rows)
