"""Series models against plain numpy."""

from datetime import date

import numpy as np
import pytest

from marketspark.operators import series_models


def month(i):
    return date(2012 + i // 12, i % 12 + 1, 1)


def make(spark, named, skip=()):
    rows = [(k, month(i), float(v)) for k, values in named.items() for i, v in enumerate(values) if (k, i) not in skip]
    return spark.createDataFrame(rows, "key string, month date, value double")


def by_key(df, key):
    return sorted((r for r in df.collect() if r.key == key), key=lambda r: r.month)


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(3)
    e = rng.normal(0, 1, 200)
    ar2, walk = np.zeros(200), np.cumsum(e) + 50
    for i in range(2, 200):
        ar2[i] = 0.6 * ar2[i - 1] - 0.5 * ar2[i - 2] + e[i]
    return {"ar2": ar2 + 20, "walk": walk, "curve": np.cumsum(np.cumsum(e[:150])) + 10, "line": 3.0 * np.arange(60) + 5, "flat": np.full(40, 7.0), "tiny": np.array([4.0, 6.0])}


def plain_kpss(z):
    n, e = len(z), z - z.mean()
    lags = int(3 * np.sqrt(n) / 13)
    long_run = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return (np.cumsum(e) ** 2).sum() / (n * long_run)


def plain_fit(x, most=5):
    for d in range(3):
        z = np.diff(x, d) if d else x
        if np.allclose(z, z[0], atol=1e-9) or plain_kpss(z) <= 0.463:
            break
    rows = np.array([z[t - 1 :: -1][:most] if t > most else z[:t][::-1] for t in range(most, len(z))]).reshape(-1, most)
    best = None
    for p in range(most + 1):
        design = np.c_[np.full((len(rows), int(d < 2)), 1.0), rows[:, :p]]
        beta = np.linalg.lstsq(design, z[most:], rcond=None)[0]
        n, k = len(rows), p + 1 + (d < 2)
        aicc = n * np.log(((z[most:] - design @ beta) ** 2).sum() / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if best is None or aicc < best[0]:
            best = (aicc, p, beta)
    return d, best


def test_orders_and_coefficients(spark, values):
    spine = series_models.gap_free(make(spark, values), "key")
    models = {r.key: r for r in series_models.autoregression_models(spine, "key").collect()}
    assert set(models) == set(values)
    for key in ("ar2", "walk", "curve"):
        d, (aicc, p, beta) = plain_fit(values[key])
        m = models[key]
        assert (m.differences, m.order) == (d, p)
        assert m.aicc == pytest.approx(aicc)
        assert [m.constant] * (d < 2) + list(m.phi[:p]) == pytest.approx(list(beta), abs=1e-7)
        assert list(m.phi[p:]) == [0.0] * (5 - p)
    assert models["ar2"].order == 2 and models["walk"].differences == 1 and models["curve"].differences == 2
    assert (models["flat"].differences, models["flat"].constant) == (0, 7.0)
    assert models["line"].differences == 1


def test_forecasts_undo_the_differences(spark, values):
    spine = series_models.gap_free(make(spark, values), "key")
    models = series_models.autoregression_models(spine, "key")
    found = {r.key: r for r in models.collect()}
    result = series_models.autoregression(spine, models, "key")
    for key in ("ar2", "walk", "curve", "line", "flat", "tiny"):
        m, x = found[key], list(values[key])
        got = by_key(result, key)
        assert [r.month for r in got] == [month(i) for i in range(len(x) + 24)]
        for i, r in enumerate(got):
            d, start = m.differences, m.differences + m.order
            if i < start:
                assert r.predicted is None
                continue
            z = np.diff(x[:i], d) if d else np.array(x[:i])
            step = m.constant + sum(m.phi[k] * z[-1 - k] for k in range(m.order))
            expected = step + (0, x[i - 1], 2 * x[i - 1] - x[i - 2] if i > 1 else 0)[d]
            assert r.predicted == pytest.approx(expected, rel=1e-6, abs=1e-6)
            if i >= len(values[key]):
                assert r.actual is None
                x.append(expected)


def test_missing_months_are_on_the_line_between(spark):
    spine = by_key(series_models.gap_free(make(spark, {"a": [1, 2, 99, 98, 8, 10]}, skip={("a", 2), ("a", 3)}), "key"), "a")
    assert [r.filled for r in spine] == [1, 2, 4, 6, 8, 10]
    assert [r.value for r in spine] == [1, 2, None, None, 8, 10]
    assert [r.i for r in spine] == list(range(6))


def plain_smoothing(y, filled, trend, season, a, b, g):
    level, slope, seasonal = series_models._start(np.array(filled, float), trend, season)
    seasonal, sse = list(seasonal), 0.0
    fitted = []
    for i, v in enumerate(y):
        fitted.append(level + slope + seasonal[i % 12])
        e = 0.0 if v is None else v - fitted[-1]
        level, slope = level + slope + a * e, slope + a * b * e
        seasonal[i % 12] += g * (1 - a) * e
        sse += e * e
    return fitted, sse, level, slope, seasonal


@pytest.mark.parametrize("skip", [set(), {("s", 13), ("s", 30), ("s", 31), ("n", 5)}])
def test_smoothing_follows_the_recursion(spark, skip):
    rng = np.random.default_rng(5)
    named = {
        "s": [100 + 0.8 * i + 12 * np.sin(i * np.pi / 6) + rng.normal(0, 1) for i in range(72)],
        "n": list(np.cumsum(rng.normal(0, 1, 40)) + 30), "few": [3.0, 5.0, 4.0],
    }
    spine_df = series_models.gap_free(make(spark, named, skip), "key")
    result = series_models.smoothing(spine_df, "key")
    for key in ("s", "n"):
        spine, got = by_key(spine_df, key), by_key(result, key)
        y, filled = [r.value for r in spine], [r.filled for r in spine]
        n, observed, best = len(y), sum(v is not None for v in y), None
        for trend, season, grid in series_models._candidates():
            size = 2 + 2 * trend + (13 if season else 0)
            if observed < size + 3 or n < 2 * season:
                continue
            runs = [(plain_smoothing(y, filled, trend, season, *w), w) for w in grid.tolist()]
            low = min(r[0][1] for r in runs)
            run, w = next(r for r in runs if r[0][1] <= low * (1 + 1e-9))
            aicc = observed * np.log(run[1] / observed) + 2 * size + 2 * size * (size + 1) / (observed - size - 1)
            if best is None or aicc < best[0]:
                best = (aicc, run, w, trend, season, size)
        _, (fitted, sse, level, slope, seasonal), (a, b, g), trend, season, size = best
        assert (got[0].trend, got[0].season, got[0].alpha, got[0].beta, got[0].gamma) == (trend, bool(season), a, b, g)
        assert [r.predicted for r in got[:n]] == pytest.approx(fitted)
        assert [r.actual for r in got] == y + [None] * 24
        variance = sse / (observed - size)
        for h, r in enumerate(got[n:], 1):
            ahead = level + h * slope + seasonal[(n + h - 1) % 12]
            spread = 1 + sum((a + a * b * j + g * (1 - a) * (j % 12 == 0)) ** 2 for j in range(1, h))
            assert r.month == month(n + h - 1)
            assert (r.predicted, r.upper - r.predicted) == pytest.approx((ahead, 1.959964 * np.sqrt(variance * spread)))
            assert r.predicted - r.lower == pytest.approx(r.upper - r.predicted)
    assert by_key(result, "s")[0].season
    assert {(r.predicted, r.upper) for r in by_key(result, "few")} == {(4.0, None)}


def plain_boost(t, season, target, rounds, rate, bins=16, least=2):
    """Depth two, by trying every split."""
    known = [v is not None for v in target]
    out = [0.0] * len(t)
    x = [(a, b - 1) for a, b in zip(t, season)]
    cuts = [(0, c) for c in range(bins - 1)] + [(1, c) for c in range(11)]

    def split(rows, r):
        scored = []
        for f, c in cuts:
            left = [r[i] for i in rows if known[i] and x[i][f] <= c]
            right = [r[i] for i in rows if known[i] and x[i][f] > c]
            scored.append(sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right) if min(len(left), len(right)) >= least else -np.inf)
        top = max(scored)
        if top == -np.inf:
            return [rows, []]
        f, c = cuts[next(k for k, s in enumerate(scored) if s >= top - 1e-9 * abs(top))]
        return [[i for i in rows if x[i][f] <= c], [i for i in rows if x[i][f] > c]]

    for _ in range(rounds):
        r = [0 if v is None else v - o for v, o in zip(target, out)]
        for half in split(list(range(len(t))), r):
            for leaf in split(half, r):
                seen = [r[i] for i in leaf if known[i]]
                for i in leaf:
                    out[i] += rate * (sum(seen) / len(seen) if seen else 0.0)
    return out


def test_boosted_trees_per_key(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        for i in range(30):
            actual = None if i >= 26 or i == 4 else 10.0 * k + 5 * (i % 12 > 5) + float(rng.normal())
            rows.append((f"k{k}", month(i), actual, None if i < 2 else 10.0 * k))
    base = spark.createDataFrame(rows, "key string, month date, actual double, predicted double")
    got = series_models.boosted_residuals(base, "key", rounds=4, rate=0.5)
    assert got.count() == 40 * 30
    for key in ("k0", "k7", "k39"):
        mine = sorted((r[1], r[2], r[3]) for r in rows if r[0] == key)
        target = [a - p if a is not None and p is not None else None for _, a, p in mine]
        days = [m.toordinal() for m, *_ in mine]
        low, high = (f(d for d, v in zip(days, target) if v is not None) for f in (min, max))
        bins = [min(max((d - low) * 16 // (high - low), 0), 15) for d in days]
        out = plain_boost(bins, [m.month for m, *_ in mine], target, 4, 0.5)
        found = by_key(got, key)
        assert [r.predicted for r in found[2:]] == pytest.approx([p + o for (_, _, p), o in zip(mine[2:], out[2:])])
        assert [r.predicted for r in found[:2]] == [None, None]
        error = [abs(r.actual - r.predicted) for r in found if r.actual is not None and r.predicted is not None]
        assert np.mean(error) < 1.5
