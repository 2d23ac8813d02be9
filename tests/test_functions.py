from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.functions import dates, labels, stats


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def day(*parts):
    return F.lit(date(*parts))


def test_normalize_year_drops_the_leap_day(spark):
    assert one(spark, dates.normalize_year(day(2020, 2, 29), F.lit(2022))) is None
    assert one(spark, dates.normalize_year(day(2020, 2, 29), F.lit(2024))) == date(2024, 2, 29)
    assert one(spark, dates.normalize_year(day(2019, 12, 31), F.lit(2022))) == date(2022, 12, 31)


def test_plus_years(spark):
    assert one(spark, dates.plus_years(day(2020, 2, 29), -1)) is None
    assert one(spark, dates.plus_years(day(2021, 2, 28), 3)) == date(2024, 2, 28)


def test_overlay_by_day_of_year(spark):
    assert one(spark, dates.normalize_doy(day(2019, 3, 1))) == date(2020, 2, 29)
    assert one(spark, dates.normalize_doy(day(2019, 3, 1), 0)) == date(2020, 3, 1)


def test_next_year_start_rolls_forward_from_new_year(spark):
    assert one(spark, dates.next_year_start(day(2022, 1, 1))) == date(2023, 1, 1)
    assert one(spark, dates.next_year_start(day(2022, 12, 31))) == date(2023, 1, 1)


def test_caption(spark):
    assert one(spark, dates.caption_date(day(2022, 5, 9))) == "May 09, 2022"


@pytest.mark.parametrize(
    "sold, flag, expected",
    [(date(2020, 1, 1), 1, "Sold"), (None, 1, "Under Contract"), (None, None, "For Sale")],
)
def test_status(spark, sold, flag, expected):
    status = labels.listing_status(F.lit(sold).cast("date"), F.lit(flag).cast("int"))
    assert one(spark, status) == expected


def test_rank(spark):
    assert one(spark, labels.rank_in(F.lit("b"), ["a", "b"])) == 2
    assert one(spark, labels.rank_in(F.lit("z"), ["a", "b"])) is None


def test_street_labels(spark):
    assert one(spark, labels.street_of(F.lit("101 Oak"))) == "Oak"
    assert one(spark, labels.street_of(F.lit("7 " + "Long Road " * 20))) == "Long Road " * 20
    assert one(spark, labels.street_label(F.lit("Pier"), F.lit("TH"))) == "Pier TH"
    assert one(spark, labels.street_label(F.lit("Pier"), F.lit(None).cast("string"))) == "Pier"
    assert one(spark, labels.street_label(F.lit("Pier"), F.lit("TH"), ["Pier"])) == "Pier"


@pytest.mark.parametrize(
    "stock, label",
    [(0, None), (10, "10 homes or less per street"), (11, "11-20 homes per street"),
     (20, "11-20 homes per street"), (100, "over 20 homes per street"), (101, "over 20 homes per street")],
)
def test_stock_bins_are_right_closed(spark, stock, label):
    assert one(spark, labels.bucket_stock(F.lit(stock))) == label


@pytest.mark.parametrize(
    "turnover, label",
    [(0.0, None), (0.2, "low"), (0.3, "ave"), (0.6, "higher"), (0.7, "high"), (1000.0, "high"), (1001.0, "high")],
)
def test_turnover_bins(spark, turnover, label):
    assert one(spark, labels.bucket_turnover(F.lit(turnover), F.lit(0.2), F.lit(0.3))) == label


def test_turnover_bins_with_a_negative_limit(spark):
    label = [labels.bucket_turnover(F.lit(t), F.lit(-0.1), F.lit(0.3)) for t in (-0.1, 0.0, 0.1)]
    assert [one(spark, c) for c in label] == [None, "low", "ave"]


def test_resale_label_rounds_half_to_even(spark):
    assert one(spark, labels.resale_label(F.lit("1 Pier"), F.lit(8.25))) == "1 Pier (8.2)"


# Published quantiles of Student's t at 97.5 %.
@pytest.mark.parametrize(
    "df, expected",
    [(1, 12.706204736), (2, 4.30265273), (10, 2.228138852), (30, 2.042272456), (31, 2.039513446), (120, 1.979930405)],
)
def test_t_quantile(spark, df, expected):
    assert one(spark, stats.t_quantile_975(F.lit(df))) == pytest.approx(expected, abs=3e-8)


def test_t_quantile_without_degrees_of_freedom(spark):
    assert one(spark, stats.t_quantile_975(F.lit(0))) is None


def test_p_values(spark):
    df = spark.createDataFrame(
        [(2.228138852, 10), (12.706204736, 1), (0.0, 5), (2.0, 0)], "t double, n int"
    )
    got = [r.p for r in df.select(stats.t_p_value("t", "n").alias("p")).collect()]
    assert got[:3] == pytest.approx([0.05, 0.05, 1.0], abs=1e-8)
    assert got[3] is None
    # An F statistic with one numerator degree of freedom is a squared t.
    f = spark.range(1).select(stats.f_p_value(F.lit(2.228138852**2), F.lit(1), F.lit(10)).alias("p")).first().p
    assert f == pytest.approx(0.05, abs=1e-8)
    assert np.isfinite(f)
