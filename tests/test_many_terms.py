"""Fits on several terms against numpy."""

import numpy as np
import pytest

from marketspark.operators.many_terms import augment_terms, fit_terms, glance_terms, tidy_terms
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, 150)
    y = 3 - 2 * x + 4 * x**2 + rng.normal(0, 0.2, 150)
    rows = [("a" if i < 90 else "b", 1.0, float(v), float(v * v), float(2 * v), float(w)) for i, (v, w) in enumerate(zip(x, y))]
    rows += [("a", 1.0, None, 1.0, 1.0, 5.0), ("a", 1.0, 0.5, 0.25, 1.0, None)]
    return x, y, spark.createDataFrame(rows, "g string, one double, x double, x2 double, twice double, y double")


def test_matches_lstsq(data):
    x, y, df = data
    terms = ["one", "x", "x2"]
    models = fit_terms(df, ["g"], "y", terms)
    for g, part in (("a", slice(0, 90)), ("b", slice(90, 150))):
        design = np.c_[np.ones(len(x[part])), x[part], x[part] ** 2]
        beta = np.linalg.lstsq(design, y[part], rcond=None)[0]
        residual = y[part] - design @ beta
        n, free = len(design), len(design) - 3
        sigma = np.sqrt(residual @ residual / free)
        inverse = np.linalg.inv(design.T @ design)
        m = models.filter(F.col("g") == g).first()
        assert list(m.beta) == pytest.approx(list(beta)) and (m.nobs, m.df_residual) == (n, free)
        quality = glance_terms(models, ["g"]).filter(F.col("g") == g).first()
        syy = ((y[part] - y[part].mean()) ** 2).sum()
        assert quality.r_squared == pytest.approx(1 - residual @ residual / syy)
        assert quality.statistic == pytest.approx((syy - residual @ residual) / 2 / sigma**2) and quality.df == 2
        rows = {r.term: r for r in tidy_terms(models, ["g"], ["i", "x", "x2"], [F.lit(1.0), F.lit(1.0), F.lit(10.0)]).filter(F.col("g") == g).collect()}
        assert [rows[t].std_error for t in ("i", "x")] == pytest.approx([sigma * np.sqrt(inverse[k, k]) for k in (0, 1)])
        assert rows["x2"].estimate == pytest.approx(10 * beta[2])
        hat = np.einsum("ij,jk,ik->i", design, inverse, design)
        got = sorted((r.x, r.hat, r.std_residual, r.cooks_distance) for r in augment_terms(df, models, ["g"], "y", terms).filter((F.col("g") == g) & F.col("residual").isNotNull()).collect())
        spread = residual / (sigma * np.sqrt(1 - hat))
        expected = sorted(zip(x[part], hat, spread, spread**2 * hat / (1 - hat) / 3))
        assert np.array(got) == pytest.approx(np.array(expected))


def test_collinear_terms_add_nothing(data):
    _, _, df = data
    plain = fit_terms(df, ["g"], "y", ["one", "x"]).orderBy("g").collect()
    doubled = fit_terms(df, ["g"], "y", ["one", "x", "twice"])
    for a, b in zip(plain, doubled.orderBy("g").collect()):
        assert list(b.beta) == pytest.approx([*a.beta, 0.0]) and b.sigma == pytest.approx(a.sigma) and b.rank == 2
    assert {r.estimate for r in tidy_terms(doubled, ["g"], ["i", "x", "twice"], [F.lit(1.0)] * 3).filter("term = 'twice'").collect()} == {None}
    assert fit_terms(df.filter("g = 'none'"), ["g"], "y", ["one", "x"]).collect() == []
