from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketspark.operators import forecast, regression, series_models
from marketspark.operators.absorbed import absorbed_ols
from marketspark.operators.enrich import enrich_listings
from marketspark.operators.smoothing import loess
from marketspark.plans import projections

import golden
from test_ordered import golden_rows

AS_OF = date(2018, 8, 5)


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(1)
    rows = []
    for group, n in (("a", 50), ("b", 12), ("two", 2), ("one", 1)):
        for i in range(n):
            x = float(rng.integers(0, 100)) + i / 1000
            rows.append((group, x, 3.0 * x + 7 + float(rng.normal(0, 5))))
    rows += [("flat", float(i), 4.0) for i in range(5)] + [("stack", 2.0, float(i)) for i in range(4)]
    rows += [("a", None, 1.0), ("a", 1.0, None)]
    return rows, spark.createDataFrame(rows, "g string, x double, y double")


def xy(rows, group):
    pairs = [(r[1], r[2]) for r in rows if r[0] == group and None not in r]
    return np.array(pairs).T


def test_ols_matches_numpy(line):
    rows, df = line
    models = {r.g: r for r in regression.ols(df, ["g"], "y", "x").collect()}
    for g in ("a", "b"):
        x, y = xy(rows, g)
        slope, icpt = np.polyfit(x, y, 1)
        assert (models[g].slope, models[g].intercept) == pytest.approx((slope, icpt))
        rss = ((y - slope * x - icpt) ** 2).sum()
        assert models[g].sigma == pytest.approx(np.sqrt(rss / (len(x) - 2)))
    assert models["one"].slope is None and models["one"].sigma is None
    assert models["two"].sigma is None and models["two"].df_residual == 0
    assert models["stack"].slope is None and models["stack"].intercept == 1.5
    assert models["flat"].slope == 0.0


def test_interval_of_the_mean(line):
    rows, df = line
    models = regression.ols(df, ["g"], "y", "x").withColumn("x0", F.lit(40.0))
    got = {r.g: r for r in regression.predict(models, "x0").collect()}
    x, y = xy(rows, "b")
    slope, icpt = np.polyfit(x, y, 1)
    s = np.sqrt(((y - slope * x - icpt) ** 2).sum() / (len(x) - 2))
    half = 2.228138851964939 * s * np.sqrt(1 / len(x) + (40 - x.mean()) ** 2 / ((x - x.mean()) ** 2).sum())
    assert (got["b"].fitted, got["b"].lower) == pytest.approx((slope * 40 + icpt, slope * 40 + icpt - half))
    assert got["two"].lower is None and got["two"].fitted is not None
    assert got["one"].fitted == pytest.approx(xy(rows, "one")[1][0]) and got["one"].upper is None


def test_quality_and_coefficients(line):
    rows, df = line
    models = regression.ols(df, ["g"], "y", "x")
    quality = {r.g: r for r in regression.with_f_p_value(regression.glance(models, ["g"])).collect()}
    x, y = xy(rows, "a")
    slope, icpt = np.polyfit(x, y, 1)
    n, rss = len(x), ((y - slope * x - icpt) ** 2).sum()
    r2 = 1 - rss / ((y - y.mean()) ** 2).sum()
    a = quality["a"]
    assert (a.r_squared, a.adj_r_squared) == pytest.approx((r2, 1 - (1 - r2) * (n - 1) / (n - 2)))
    log_lik = -n / 2 * (np.log(2 * np.pi * rss / n) + 1)
    assert (a.log_lik, a.aic, a.bic) == pytest.approx((log_lik, -2 * log_lik + 6, -2 * log_lik + 3 * np.log(n)))
    assert a.statistic == pytest.approx(r2 / (1 - r2) * (n - 2)) and a.p_value < 1e-10
    assert quality["flat"].r_squared is None
    terms = {(r.g, r.term): r for r in regression.with_t_p_value(regression.tidy(models, ["g"], "x")).collect()}
    assert terms["a", "x"].statistic ** 2 == pytest.approx(a.statistic)
    assert terms["a", "(Intercept)"].estimate == pytest.approx(icpt)
    assert terms["two", "x"].p_value is None


def test_augmented_rows(line):
    rows, df = line
    known = df.filter("x is not null and y is not null")
    models = regression.ols(known, ["g"], "y", "x")
    scored = regression.augment(known, models, ["g"], "y", "x")
    sums = {r.g: r for r in scored.groupBy("g").agg(F.sum("residual").alias("res"), F.sum("hat").alias("hat")).collect()}
    assert sums["a"].res == pytest.approx(0, abs=1e-8) and sums["a"].hat == pytest.approx(2)
    assert sums["one"].hat == pytest.approx(1)
    x, y = xy(rows, "b")
    design = np.c_[np.ones_like(x), x]
    hat = np.diag(design @ np.linalg.inv(design.T @ design) @ design.T)
    fitted = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    s = np.sqrt(((y - fitted) ** 2).sum() / (len(x) - 2))
    cooks = ((y - fitted) / (s * (1 - hat))) ** 2 * hat / 2
    got = {r.x: r for r in scored.filter("g = 'b'").collect()}
    for xi, h, c in zip(x, hat, cooks):
        assert (got[xi].hat, got[xi].cooks_distance) == pytest.approx((h, c))


def test_golden_year_line(make_listings):
    rows, _ = golden_rows()
    df = enrich_listings(make_listings(rows), AS_OF)
    model = projections.value_models(df).filter("sale_year = 2017").first()
    assert model.slope == pytest.approx(golden.SLOPE_2017, abs=1e-4)
    assert 1 - model.deviance / model.syy == pytest.approx(golden.R_SQUARED_2017, abs=1e-6)


def test_horizons_equal_separate_fits(make_listings):
    rows, _ = golden_rows()
    df = make_listings(rows)
    got = {
        (r.category, r.period): r
        for r in regression.horizon_projection(df, "listing_date", F.lit(1).cast("long"), [60, 200], AS_OF).collect()
    }
    for period in (60, 200):
        days = sorted(r[4] for r in rows if r[3] == "residential" and r[4] > AS_OF - timedelta(days=period))
        x = np.array([d.toordinal() for d in days], float)
        slope = np.polyfit(x - x.mean(), np.arange(1, len(x) + 1), 1)[0]
        assert got["residential", period].amount == pytest.approx(slope * 365)
    assert got["patio home", 200].amount == 0.0 and got["patio home", 200].r_squared is None


def test_trend_is_scored_at_both_ends(make_listings):
    rows, _ = golden_rows()
    history = regression.recent_history(make_listings(rows), "residential", 360, AS_OF)
    points = regression.trend_points(history, "listing_date", "cumulative_listing", [60, 360], AS_OF).collect()
    assert {(r.period, r.date) for r in points} == {
        (n, d) for n in (60, 360) for d in (AS_OF - timedelta(days=n), date(2019, 1, 1))
    }


def test_value_trend_follows_listing_order_with_null_poison(make_listings):
    rows = [
        (1, 1, "x", "a", date(2018, 7, 1), date(2018, 8, 1), 10, None),
        (2, 2, "x", "a", date(2018, 7, 2), date(2018, 7, 20), 20, None),
        (3, 3, "x", "a", date(2018, 7, 3), None, None, None),
        (4, 4, "x", "a", date(2018, 7, 4), date(2018, 7, 5), 40, None),
    ]
    history = regression.recent_history(make_listings(rows), "a", 360, AS_OF)
    got = {r.listing_id: r.cumulative_value for r in history.collect()}
    assert got == {1: 10, 2: 30, 3: None, 4: None}
    points = {r.date: r.fitted for r in regression.trend_points(history, "sale_date", "cumulative_value", [60], AS_OF).collect()}
    slope = (10 - 30) / 12
    assert points[date(2019, 1, 1)] == pytest.approx(10 + slope * (date(2019, 1, 1) - date(2018, 8, 1)).days)


def test_interpolation(spark):
    rows = [(date(2020, 1, 1), 10.0), (date(2020, 1, 1), 20.0), (date(2020, 1, 11), 35.0), (date(2020, 1, 12), None)]
    df = spark.createDataFrame(rows, "d date, v double")

    def at(*day):
        return regression.interpolate_at(df, "d", "v", F.lit(date(*day))).first().y

    assert at(2020, 1, 1) == 15.0 and at(2020, 1, 6) == 25.0
    assert at(2020, 1, 12) is None and at(2019, 12, 31) is None


def test_multi_ols_matches_lstsq(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (200, 3))
    y = x @ [2.0, -1.0, 0.5] + 4 + rng.normal(0, 0.1, 200)
    rows = [("g", 1.0, *map(float, xi), float(yi)) for xi, yi in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, one double, a double, b double, c double, y double")
    got = regression.multi_ols(df, ["g"], "y", ["one", "a", "b", "c"]).first()
    expected = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert got.coefficients == pytest.approx(list(expected)) and got.nobs == 200


def direct_loess(x, y, x0, span):
    d = np.abs(x - x0)
    h = np.sort(d)[int(np.floor(span * len(x) + 1e-5)) - 1]
    w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
    design = np.c_[np.ones_like(x), x - x0, (x - x0) ** 2]
    row = np.linalg.pinv(design.T @ (w[:, None] * design)) @ (design.T * w)
    return row[0]


def test_loess_matches_the_definition(spark):
    rng = np.random.default_rng(4)
    days = rng.integers(0, 120, 150)
    y = np.sin(days / 20.0) * 10 + rng.normal(0, 1, 150)
    base = date(2020, 1, 1)
    rows = [(base + timedelta(days=int(d)), float(v)) for d, v in zip(days, y)]
    df = spark.createDataFrame(rows + [(None, 1.0), (base, None)], "d date, v double")
    got = loess(df, "d", "v", grid=20).orderBy("x").collect()
    offset = base.toordinal() - date(1970, 1, 1).toordinal()
    x = days.astype(float) + offset
    smoother = np.array([direct_loess(x, y, xi, 0.75) for xi in x])
    residual = y - smoother @ y
    free = len(x) - 2 * np.trace(smoother) + (smoother**2).sum()
    sigma = np.sqrt((residual**2).sum() / free)
    assert len(got) == 20
    for r in got:
        row = direct_loess(x, y, r.x, 0.75)
        assert r.fitted == pytest.approx(row @ y, abs=1e-6)
        half = (r.upper - r.lower) / 2
        assert half / (sigma * np.sqrt((row**2).sum())) == pytest.approx(1.98, abs=0.02)
    plain = loess(df, "d", "v", grid=20, band=False).orderBy("x").collect()
    assert [r.fitted for r in plain] == pytest.approx([r.fitted for r in got])


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(6)
    rows = []
    for key, n in (("long", 72), ("short", 9)):
        for i in range(n):
            month = date(2015 + i // 12, i % 12 + 1, 1)
            rows.append((key, month, float(100 + 0.8 * i + 10 * np.sin(i % 12) + rng.normal(0, 0.5))))
    return rows, spark.createDataFrame(rows, "key string, month date, value double")


def long_series(rows):
    months = [r[1] for r in rows if r[0] == "long"]
    values = np.array([r[2] for r in rows if r[0] == "long"])
    return months, values


def predicted(df, key="long"):
    return {r.month: r.predicted for r in df.collect() if r.key == key}


def smoothing(df, key):
    return series_models.smoothing(series_models.gap_free(df, key), key)


def boosted(df, key):
    spine = series_models.gap_free(df, key)
    base = series_models.autoregression(spine, series_models.autoregression_models(spine, key), key)
    return series_models.boosted_residuals(base, key, rounds=5)


def test_seasonal_trend_matches_dummy_regression(series):
    rows, df = series
    months, y = long_series(rows)
    t = np.array([m.toordinal() for m in months], float)
    t -= t.mean()
    design = np.c_[t, np.array([[m.month == k for k in range(1, 13)] for m in months], float)]
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    got = predicted(forecast.seasonal_trend(df, "key"))
    assert len(got) == 72 + 24
    assert [got[m] for m in months] == pytest.approx(list(fit))
    assert predicted(forecast.seasonal_trend(df, "key"), "short")[date(2016, 1, 1)] is not None
    assert predicted(forecast.seasonal_trend(df, "key"), "short")[date(2015, 12, 1)] is None


def test_autoregression_iterates(series):
    rows, df = series
    months, y = long_series(rows)
    phi, drift = np.polyfit(y[:-1], y[1:], 1)
    got = predicted(forecast.autoregressive(df, "key"))
    value = y[-1]
    for k in range(24):
        value = drift + phi * value
        assert got[date(2021 + k // 12, k % 12 + 1, 1)] == pytest.approx(value)
    assert got[months[0]] is None and got[months[1]] == pytest.approx(drift + phi * y[0])


@pytest.mark.parametrize("fit", [forecast.fourier_trend, forecast.hinge_trend, smoothing])
def test_seasonal_models_follow_a_seasonal_series(series, fit):
    rows, df = series
    months, y = long_series(rows)
    got = predicted(fit(df, "key"))
    assert len(got) == 72 + 24
    errors = [abs(got[m] - v) for m, v in zip(months[24:], y[24:])]
    assert np.mean(errors) < 4
    truth = [100 + 0.8 * i + 10 * np.sin(i % 12) for i in range(72, 84)]
    ahead = [got[date(2021, k, 1)] for k in range(1, 13)]
    assert np.mean(np.abs(np.array(ahead) - truth)) < 6


def test_model_table_and_accuracy(series):
    _, df = series
    table = forecast.model_table(
        {"lm": forecast.seasonal_trend(df, "key"), "ar": forecast.autoregressive(df, "key"),
         "trees": boosted(df, "key")}
    )
    quality = {(r.model, r.key): r for r in forecast.accuracy(table, ["model", "key"]).collect()}
    assert len(quality) == 6
    assert quality["lm", "long"].rmse < quality["ar", "long"].rmse
    assert quality["lm", "long"].months == 72 and quality["ar", "long"].months == 71


def test_categorical_coefficients_match_lstsq(spark):
    rng = np.random.default_rng(8)
    rows = [(float(rng.integers(0, 1000)), rng.choice(["a", "b", "c"]), rng.choice(["u", "v"])) for _ in range(300)]
    y = [0.3 * x + {"a": 0, "b": 5, "c": -7}[c] + (2 if s == "v" else 0) + float(rng.normal(0, 1)) for x, c, s in rows]
    df = spark.createDataFrame([(v, x, str(c), str(s)) for (x, c, s), v in zip(rows, y)], "y double, x double, c string, s string")
    got = {r.term: r.estimate for r in forecast.categorical_ols(df, "y", ["x"], ["c", "s"]).collect()}
    design = np.array([[1, x, c == "c", c == "b", s == "v"] for x, c, s in rows], float)
    expected = np.linalg.lstsq(design, np.array(y), rcond=None)[0]
    assert [got[t] for t in ("(Intercept)", "x", "c=c", "c=b", "s=v")] == pytest.approx(list(expected), abs=1e-6)


def test_absorbed_factors_of_many_levels(spark):
    """Two factors of 300 and 80 levels in a sparse design against least squares on all dummies."""
    rng = np.random.default_rng(10)
    rows = [(int(rng.integers(0, 300)), int(rng.integers(0, 80)), float(rng.normal()), "u") for _ in range(2500)]
    rows = [(f"s{a:03d}", f"f{(b + a) % 80:02d}" if a % 3 else "f00", x, c) for a, b, x, c in rows]
    effect_s, effect_f = rng.normal(0, 5, 300), rng.normal(0, 3, 80)
    y = [10 + 1.5 * x + effect_s[int(a[1:])] + effect_f[int(b[1:])] + float(rng.normal()) for a, b, x, _ in rows]
    df = spark.createDataFrame([(float(v), *r) for v, r in zip(y, rows)] + [(None, "s000", "f01", 1.0, "u"), (1.0, None, "f01", 1.0, "u")], "y double, s string, f string, x double, one string")
    got = {r.term: r.estimate for r in absorbed_ols(df, "y", ["x"], ["f", "one"], "s").collect()}
    levels = [sorted({r[0] for r in rows}), sorted({r[1] for r in rows})]
    design = np.array([[1, r[2], *(r[0] == v for v in levels[0][1:]), *(r[1] == v for v in levels[1][1:])] for r in rows], float)
    expected = np.linalg.lstsq(design, np.array(y), rcond=None)[0]
    terms = ["(Intercept)", "x", *(f"s={v}" for v in levels[0][1:]), *(f"f={v}" for v in levels[1][1:])]
    assert [got[t] for t in terms] == pytest.approx(list(expected), abs=1e-6)
    assert got["one=u"] is None and len(got) == len(terms) + 1
    assert absorbed_ols(df.filter("s = 'none'"), "y", ["x"], ["f"], "s").collect() == []


def test_date_features(spark):
    df = spark.createDataFrame([(date(2020, 1, 5),), (date(2020, 1, 7),)], "d date")
    rows = forecast.date_features(df, "d").collect()
    assert [(r.d_month, r.d_dow, r.d_year) for r in rows] == [(1, 1, 2020), (1, 3, 2020)]
    assert sorted(r.date_num for r in rows) == pytest.approx([-np.sqrt(0.5), np.sqrt(0.5)])
