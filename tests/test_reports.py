from collections import Counter, defaultdict
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import enrich
from marketspark.operators.distribution import box_outliers, box_stats, density
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.reshape import latest_date, stack_params, to_long, wide_difference
from marketspark.operators.topk import group_peaks, top_with_ties
from marketspark.operators.turnover import (
    area_turnover,
    category_turnover,
    counts_on_stock,
    label_streets,
    label_turnover,
    turnover_limits,
    unmatched_groups,
)
from marketspark.plans import dashboard, fundamentals, reports

AS_OF = date(2022, 5, 9)


@pytest.fixture(scope="module")
def market(make_listings, skewed_rows):
    return enrich.enrich_listings(make_listings(skewed_rows), AS_OF)


def test_enriched_columns(make_listings):
    df = make_listings(
        [
            (1, 1, "x", "a", date(2017, 1, 2), date(2017, 7, 12), 217000, None),
            (2, 2, "x", "a", date(2022, 4, 3), None, None, 1),
            (3, 3, "x", "a", date(2022, 5, 20), None, None, None),
        ]
    )
    rows = enrich.enrich_listings(df, AS_OF).orderBy("listing_id").collect()
    assert [r.time_on_market for r in rows] == [191, 36, -11]
    assert [r.status for r in rows] == ["Sold", "Under Contract", "For Sale"]
    assert (rows[0].listing_year, rows[0].sale_month, rows[0].day_of_year) == (2017, 7, 2)
    assert rows[1].sale_year is None


def test_recent_is_strict(make_listings):
    df = make_listings(
        [(i, 1, "x", "a", d, None, None, None) for i, d in enumerate([date(2022, 3, 10), date(2022, 3, 11)])]
    )
    assert [r.listing_date for r in enrich.recent(df, "listing_date", AS_OF, 60).collect()] == [date(2022, 3, 11)]


def test_warmup_has_a_strict_and_an_inclusive_form(market):
    first = market.agg(F.min("listing_date"))
    start = first.first()[0]
    strict = enrich.after_warmup(market, "listing_date", first).agg(F.min("listing_date")).first()[0]
    loose = enrich.after_warmup(market, "listing_date", first, inclusive=True)
    assert strict > date(start.year + 1, start.month, start.day) or strict is None
    assert loose.count() >= enrich.after_warmup(market, "listing_date", first).count()


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_exact_quantiles_match_numpy(market, skewed_rows, slices):
    probs = {"q1": 0.25, "med": 0.5, "p9": 0.9}
    got = exact_quantiles(market, ["category", "sale_year"], "amount", probs, slices=slices).collect()
    groups = defaultdict(list)
    for r in skewed_rows:
        groups[r[3], r[5] and r[5].year].append(r[6])
    assert len(got) == len(groups)
    for r in got:
        values = [v for v in groups[r.category, r.sale_year] if v is not None]
        if values:
            assert (r.q1, r.med, r.p9) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.9])))
        else:
            assert r.med is None


def test_exact_quantile_without_groups_and_of_one_heavy_value(spark):
    df = spark.createDataFrame([(5.0,)] * 90 + [(float(i),) for i in range(10)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}, slices=8).first().m == 5.0


def test_median_price_keeps_the_half_cent(make_listings):
    df = make_listings(
        [(i, 1, "x", "a", date(2020, 1, 1), date(2020, 1, 2), a, None) for i, a in enumerate(["10.01", "10.02"])]
    )
    assert reports.median_price(df, ["category"]).first().median_price == pytest.approx(10.015)


def test_null_sale_year_is_a_group(market, skewed_rows):
    counts = {r.sale_year: r.n for r in reports.count_by(market, ["sale_year"]).collect()}
    assert counts[None] == sum(r[5] is None for r in skewed_rows)


def test_market_value_of_nulls_is_zero(market):
    values = {r.sale_year: r.market_value for r in reports.market_value(market, ["sale_year"]).collect()}
    assert values[None] == 0.0


def test_axis_rules_differ_on_multiples_of_ten(spark):
    df = spark.createDataFrame([(50,), (51,)], "n long")
    got = df.select(reports.above_next(F.col("n"), 10).alias("a"), reports.up_to_next(F.col("n"), 10).alias("b"))
    assert [(r.a, r.b) for r in got.collect()] == [(60, 50), (60, 60)]


def test_last_sale_day_counts_every_tied_sale(make_listings):
    sales = [date(2019, 12, 1), date(2019, 12, 1), date(2019, 12, 1), date(2021, 1, 10)]
    df = enrich.enrich_listings(
        make_listings([(i, 1, "x", "a", date(2019, 1, 1), d, 5, None) for i, d in enumerate(sales)]), AS_OF
    )
    assert reports.last_sale_day(df).first().last_sale_day == 335.0


def test_dashboard_panels(market, skewed_rows, spark):
    stock = F.lit(1000)
    rows = dashboard.all_panels(market, stock).collect()
    panels = defaultdict(dict)
    for r in rows:
        panels[r.panel][r.year] = r.value
    assert set(panels) == {
        "listed", "sold", "time_on_market", "sale_price", "inventory", "inventory_time", "market_value", "turnover",
    }
    assert panels["listed"] == Counter(r[4].year for r in skewed_rows)
    sold = Counter(r[5].year for r in skewed_rows if r[5])
    assert panels["sold"] == sold
    assert panels["turnover"] == {y: pytest.approx(n / 1000) for y, n in sold.items()}
    assert panels["inventory_time"][2019] == 0.0


def test_residence_time_without_sales_is_null(make_listings):
    df = make_listings([(1, 1, "x", "a", date(2018, 1, 1), date(2018, 1, 5), 5, None)])
    rows = fundamentals.residence_time(df, F.lit(484), AS_OF).collect()
    assert rows and {r.residence_time for r in rows if r.homes_sold == 0} == {None}


def test_street_turnover(spark, make_listings):
    listings = make_listings(
        [(i, i, "x", c, date(2020, 1, 1), None, None, None) for i, c in enumerate(["town", "town", "plain", "plain", "town"])]
    ).withColumn(
        "address", F.when(F.col("listing_id") < 2, "101 Pier").when(F.col("listing_id") < 4, "102 Maya").otherwise("103 Lost")
    )
    categories = spark.createDataFrame([("town", "TH"), ("plain", None)], "category string, abbreviation string")
    stock = spark.createDataFrame([("Pier TH", 10), ("Maya", 40), ("Nola", 5)], "street string, stock long")
    labelled = label_streets(listings, categories)
    counts = labelled.groupBy("street").agg(F.count("*").alias("listed"))
    kept = {r.street: r.listed for r in counts_on_stock(counts, stock, "street", "listed").collect()}
    assert kept == {"Pier TH": 2, "Maya": 2, "Nola": 0}
    assert [r.street for r in unmatched_groups(counts, stock, "street").collect()] == ["Lost TH"]
    spread = listings.unionByName(listings.withColumn("listing_date", F.lit(date(2022, 1, 1))))
    turnover = area_turnover(counts, stock, spread)
    rows = {r.street: r for r in turnover.collect()}
    assert rows["Nola"].turnover == 0 and rows["Nola"].residence_time is None
    assert rows["Pier TH"].residence_time == pytest.approx(731 / 365.25 / 0.2)
    assert rows["Maya"].stock_bin == "over 20 homes per street"
    limits = turnover_limits(turnover, listings).first()
    overall, sd = 5 / 55, np.std([0.2, 0.05, 0.0], ddof=1)
    assert limits.lower == pytest.approx(overall - 1.959963984540054 * sd / np.sqrt(3))
    labels = {r.street: r.turnover_label for r in label_turnover(turnover, turnover_limits(turnover, listings)).collect()}
    assert limits.lower < 0
    assert labels["Nola"] == "low" and labels["Pier TH"] == "ave"


def test_category_turnover_of_an_unknown_category_is_zero(spark, market):
    stock = spark.createDataFrame([("a", 10), ("b", 0)], "category string, stock long")
    rows = category_turnover(market, stock, scale=100).collect()
    assert {r.turnover for r in rows if r.category in ("common", "b")} == {0.0}
    assert all(r.turnover == pytest.approx(r.listed * 10) for r in rows if r.category == "a")


@pytest.mark.parametrize("largest", [True, False])
def test_top_with_ties(spark, largest):
    df = spark.createDataFrame([(v,) for v in [5, 5, 5, 4, 1, 1, None]], "v int")
    got = sorted(r.v for r in top_with_ties(df, "v", 2, largest).collect())
    assert got == ([5, 5, 5] if largest else [1, 1])


def test_group_peaks_keep_ties_and_drop_null_groups(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", None)], "g string, v int")
    for calendar in (False, True):
        assert [tuple(r) for r in group_peaks(df, ["g"], "v", calendar).collect()] == [("a", 3), ("a", 3)]


def test_box_stats(spark):
    values = [1, 2, 3, 4, 5, 6, 7, 8, 100]
    df = spark.createDataFrame([(2020, v) for v in values], "year int, v int")
    r = box_stats(df, ["year"], "v").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (3.0, 5.0, 7.0, 1, 8, 1)
    assert [x.v for x in box_outliers(df, ["year"], "v").collect()] == [100]


def test_density_matches_a_direct_kernel_sum(spark):
    rng = np.random.default_rng(3)
    values = rng.normal(100, 15, 300)
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("single", 1.0)], "g string, v double")
    rows = density(df, ["g"], "v").orderBy("grid_no").collect()
    assert {r.g for r in rows} == {"g"} and len(rows) == 512
    q1, q3 = np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * 300**-0.2
    grid = np.array([r.grid for r in rows])
    direct = np.exp(-0.5 * ((grid[:, None] - values) / bw) ** 2).sum(1) / (300 * bw * np.sqrt(2 * np.pi))
    assert grid[0] == pytest.approx(values.min()) and grid[-1] == pytest.approx(values.max())
    assert np.allclose([r.density for r in rows], direct, atol=direct.max() * 1e-3)


def test_reshaping(spark, market):
    long = to_long(spark.createDataFrame([(2020, 1, 2)], "y int, a int, b int"), ["y"], ["a", "b"], "k", "v")
    assert sorted(tuple(r) for r in long.collect()) == [(2020, "a", 1), (2020, "b", 2)]
    latest = latest_date(market.select("listing_date", "sale_date")).first().date
    assert latest == market.agg(F.greatest(F.max("listing_date"), F.max("sale_date"))).first()[0]
    wide = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 25.0)], "g string, p int, v double")
    assert wide_difference(wide, ["g"], "p", "v", "d").first().d == 15.0
    stacked = stack_params(spark.range(5), "n", [1, 3], F.col("id") < F.col("n"))
    assert sorted((r.n, r.id) for r in stacked.collect()) == [(1, 0), (3, 0), (3, 1), (3, 2)]


def test_money_type_survives(market):
    total = reports.value_total(market).agg(F.max("total_amount")).first()[0]
    assert isinstance(total, Decimal)
