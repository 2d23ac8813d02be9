from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from marketspark.operators.events import (
    inventory_at_listing,
    listing_events,
    running_inventory,
    trailing_12_months,
    trailing_365_days,
)
from marketspark.operators.ordered import (
    carry_forward,
    frequent_groups,
    null_poisoned_sum,
    order_slices,
    previous_value,
    repeated_keys,
    running_count,
    running_sums,
    slice_count,
    trailing_rows,
)
from marketspark.operators import ordered
from marketspark.plans.flagship import listings_with_inventory
from marketspark.plans.queries_windows import year_counter

import golden


def golden_rows():
    rows = [line.split(",") for line in golden.ROWS.strip().splitlines()]
    return [
        (i, i, "x", r[3], date.fromisoformat(r[0]), date.fromisoformat(r[1]), int(r[2]), None)
        for i, r in enumerate(rows)
    ], rows


def brute_inventory(rows, listings_first):
    events = []
    for r in rows:
        events.append((r[4], 0, r[0], 1))
        if r[5]:
            events.append((r[5], 1, r[0], -1))
    events.sort(key=(lambda e: (e[0], e[1], e[2])) if listings_first else (lambda e: (e[0], e[2], e[1])))
    total, out = 0, {}
    for _, kind, listing, y in events:
        total += y
        out[listing, "sale" if kind else "listing"] = total
    return out


@pytest.mark.parametrize("slices", [1, 8, 64])
@pytest.mark.parametrize("rule", ["interleaved", "listings_first"])
def test_running_inventory_equals_plain_scan(make_listings, skewed_rows, rule, slices):
    got = running_inventory(make_listings(skewed_rows), rule, slices=slices).collect()
    expected = brute_inventory(skewed_rows, rule == "listings_first")
    assert {(r.listing_id, r.event): r.inventory for r in got} == expected


def test_final_inventory_is_listings_minus_sales(make_listings, skewed_rows):
    df = make_listings(skewed_rows)
    last = running_inventory(df).orderBy(F.desc("event_date"), F.desc("listing_id"), F.col("y")).first()
    assert last.inventory == sum(1 for r in skewed_rows if r[5] is None)


def test_golden_inventory_counts_and_months(make_listings):
    rows, expected = golden_rows()
    df = make_listings(rows).withColumn("listing_year", F.year("listing_date"))
    got = {r.listing_id: r for r in listings_with_inventory(df, "listings_first").collect()}
    counts = {r.listing_id: r.listing_count for r in year_counter(df).collect()}
    for i, row in enumerate(expected):
        assert got[i].inventory == int(row[4])
        assert counts[i] == int(row[5])
        assert got[i].yearly_sales == int(row[6])
        if row[7]:
            assert got[i].inventory_time == pytest.approx(float(row[7]))
        else:
            assert got[i].inventory_time is None


def test_tie_rules_differ_on_a_shared_day(make_listings):
    day = date(2020, 1, 1)
    df = make_listings(
        [(1, 1, "x", "a", day, day, 5, None), (2, 2, "x", "a", day, day, 5, None), (3, 3, "x", "a", day, None, None, None)]
    )
    interleaved = {r.listing_id: r.inventory for r in inventory_at_listing(df).collect()}
    bind = {r.listing_id: r.inventory for r in inventory_at_listing(df, "listings_first").collect()}
    assert interleaved == {1: 1, 2: 1, 3: 1}
    assert bind == {1: 1, 2: 2, 3: 3}
    with pytest.raises(ValueError):
        inventory_at_listing(df, "sales_first")


def test_empty_table(make_listings):
    assert running_inventory(make_listings([])).collect() == []
    assert listing_events(make_listings([])).count() == 0


def test_trailing_365_days_against_brute_force(make_listings, skewed_rows):
    df = make_listings(skewed_rows)
    got = trailing_365_days(df, df.select("listing_id", "listing_date"), "listing_date").collect()
    sold = [r[5] for r in skewed_rows if r[5]]
    assert len(got) == len(skewed_rows)
    for r in got:
        assert r.yearly_sales == sum(0 <= (r.listing_date - s).days < 365 for s in sold)


def test_trailing_12_months_against_brute_force(spark, make_listings, skewed_rows):
    df = make_listings(skewed_rows)
    dates = [date(2020, 2, 29), date(2021, 2, 28), date(2021, 3, 1), date(2018, 1, 1), date(2030, 1, 1)]
    anchors = spark.createDataFrame([(d,) for d in dates], "date date")
    got = {r.date: r.homes_sold for r in trailing_12_months(df, anchors, "date").collect()}
    sold = [r[5] for r in skewed_rows if r[5]]
    for d in dates:
        back = date(2019, 2, 28) if d == date(2020, 2, 29) else d.replace(year=d.year - 1)
        assert got[d] == sum(back < s <= d for s in sold)


def test_slices_preserve_order_and_split_a_hot_day(make_listings, skewed_rows):
    df = order_slices(make_listings(skewed_rows), "listing_id", 8)
    rows = sorted((r.listing_id, r.order_slice) for r in df.collect())
    slices = [s for _, s in rows]
    assert slices == sorted(slices)
    hot = Counter(r.order_slice for r in df.filter("listing_date = '2020-02-29'").collect())
    assert max(hot.values()) < 0.3 * sum(hot.values())


def test_slice_count_is_a_power_of_two(make_listings):
    df = make_listings([])
    assert [slice_count(df, n) for n in (1, 2, 3, 8, 9, 10**6)] == [1, 2, 4, 8, 16, 1 << 20]
    assert slice_count(df) == 8


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(-50, 50)), min_size=1, max_size=40))
def test_running_sums_property(spark, values):
    rows = [(i, g, date(2020, 1, 1) + timedelta(days=d), v) for i, (d, g, v) in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, g int, day date, v long")
    got = running_sums(df, {"total": F.col("v"), "n": F.lit(1).cast("long")}, days=["day"], tie="id", groups=["g"], slices=4)
    seen = {r.id: (r.total, r.n) for r in got.collect()}
    totals = defaultdict(lambda: (0, 0))
    for i, g, day, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        totals[g] = (totals[g][0] + v, totals[g][1] + 1)
        assert seen[i] == totals[g]


def test_last_running_value_is_the_group_total(make_listings, skewed_rows):
    df = make_listings(skewed_rows).filter("amount is not null")
    got = running_sums(df, {"total": F.col("amount")}, days=["sale_date"], tie="listing_id", groups=["category"])
    peaks = {r.category: r.m for r in got.groupBy("category").agg(F.max("total").alias("m")).collect()}
    sums = {r.category: r.m for r in df.groupBy("category").agg(F.sum("amount").alias("m")).collect()}
    assert peaks == sums


def test_null_poisoned_sum(spark):
    rows = [(i, date(2020, 1, 1 + i // 2), v) for i, v in enumerate([5, 6, None, 7, 8])]
    df = spark.createDataFrame(rows, "id long, day date, v long")
    got = null_poisoned_sum(df, "total", "v", also={"n": F.lit(1).cast("long")}, days=["day"], tie="id", slices=4)
    assert [(r.total, r.n) for r in got.orderBy("id").collect()] == [(5, 1), (11, 2), (None, 3), (None, 4), (None, 5)]


@pytest.mark.parametrize("chunk", [20, 64, 65536])
def test_trailing_rows_across_chunks(make_listings, skewed_rows, chunk):
    df = make_listings(skewed_rows).select("listing_id", "listing_date", F.col("listing_id").cast("double").alias("v"))
    got = trailing_rows(
        df, {"med": F.percentile("v", F.lit(0.5)), "mean": F.avg("v")},
        rows=19, day="listing_date", tie="listing_id", chunk=chunk,
    )
    seen = {r.listing_id: (r.med, r.mean) for r in got.collect()}
    ordered = [r[0] for r in sorted(skewed_rows, key=lambda r: (r[4], r[0]))]
    assert len(seen) == len(ordered)
    for i, listing in enumerate(ordered):
        if i < 18:
            assert seen[listing] == (None, None)
        else:
            last = ordered[i - 18 : i + 1]
            assert seen[listing] == pytest.approx((np.median(last), np.mean(last)))


@pytest.mark.parametrize("hot_rows", [0, 20, 10**6])
def test_previous_value_with_and_without_splitting(make_listings, skewed_rows, hot_rows):
    df = make_listings(skewed_rows)
    got = previous_value(
        df, "before", "sale_date", key="entity_id", day="listing_date", tie="listing_id", hot_rows=hot_rows
    ).collect()
    assert len(got) == len(skewed_rows)
    before, last = {}, {}
    for r in sorted(skewed_rows, key=lambda r: (r[1], r[4], r[0])):
        before[r[0]] = last.get(r[1])
        last[r[1]] = r[5]
    assert {r.listing_id: r.before for r in got} == before
    sizes = Counter(r[1] for r in skewed_rows)
    repeated = previous_value(
        df, "before", "sale_date", key="entity_id", day="listing_date", tie="listing_id",
        hot_rows=hot_rows, repeated_only=True,
    ).collect()
    if hot_rows:
        assert {r.listing_id: r.before for r in repeated} == {
            r[0]: before[r[0]] for r in skewed_rows if sizes[r[1]] > 1
        }


def test_hot_key_is_spread_over_partitions(make_listings, skewed_rows):
    df = make_listings(skewed_rows)
    counted = running_count(df, "n", days=["listing_date"], tie="listing_id", groups=["entity_id"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_id" in plan and "order_slice" in plan
    assert counted.filter("entity_id = 1").agg(F.max("n")).first()[0] == 200


def test_group_filters(make_listings, skewed_rows):
    df = make_listings(skewed_rows)
    sizes = Counter(r[1] for r in skewed_rows)
    assert repeated_keys(df, "entity_id").count() == sum(n for n in sizes.values() if n > 1)
    assert frequent_groups(df, "entity_id", 12).count() == sum(n for n in sizes.values() if n >= 12)


def test_carry_forward_stays_in_its_group(spark):
    df = spark.createDataFrame(
        [(2020, 1, 5.0), (2020, 2, None), (2021, 1, None), (2021, 2, 7.0)], "year int, month int, v double"
    )
    got = carry_forward(df, "v", groups=["year"], order="month").orderBy("year", "month").collect()
    assert [r.v for r in got] == [5.0, 5.0, None, 7.0]


def test_money_sums_stay_exact(spark):
    rows = [(i, date(2020, 1, 1), Decimal("0.10")) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, day date, v decimal(18,2)")
    got = running_sums(df, {"total": F.col("v")}, days=["day"], tie="id", slices=8)
    assert got.agg(F.max("total")).first()[0] == Decimal("10.00")


def test_dense_ranks_equal_one_window(spark):
    rng = random.Random(11)
    values = [rng.choice([None, 0.5, 0.25, -1.0, *[k / 7 for k in range(300)]]) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    places = {v: k for k, v in enumerate(sorted(set(values), key=lambda v: (v is not None, v or 0)), 1)}
    for slices in (1, 4, 16):
        got = {r.id: r.place for r in ordered.dense_ranks(df, "v", "place", slices).collect()}
        assert got == {i: places[v] for i, v in enumerate(values)}
