"""Models chosen per series: autoregression, smoothing, boosted trees, and all models side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.operators import forecast, series_models
from marketspark.plans.queries_models import (
    BENDS, LEVELS, SERIES_SQL, TIME_SQL, WAVES, forecast_rows, price_series, stepwise_sql,
)
from marketspark.plans.registry import ORACLES, query, rounded, sql_rounded

KEY = "category"
LAGS = 5

SPINE_SQL = """
mo as (select category, unnest(range(date_diff('month', min(month), max(month)) + 1)) as i, min(month) as mn from se group by 1),
sj as (select category, i, month, value
       from (select category, cast(i as int) as i, cast(mn + to_months(cast(i as int)) as date) as month from mo) left join se using (category, month)),
sk as (select *, last_value(case when value is not null then i end ignore nulls) over lw as i0,
              last_value(value ignore nulls) over lw as v0,
              first_value(case when value is not null then i end ignore nulls) over rw as i1,
              first_value(value ignore nulls) over rw as v1
       from sj window lw as (partition by category order by i rows between unbounded preceding and current row),
                      rw as (partition by category order by i rows between current row and unbounded following)),
sp as (select category, i, month, value, coalesce(value, v0 + (v1 - v0) * (i - i0) / cast(i1 - i0 as double)) as filled from sk)
"""

AR_TERMS = {"c0": "c0", **{f"c{k}": f"l{k}" for k in range(1, LAGS + 1)}}
AR_SQL = (
    f"""
dz as (
  select category, i, month, unnest([0, 1, 2]) as d, unnest([filled, filled - b1, filled - 2 * b1 + b2]) as z
  from (select *, lag(filled, 1) over w as b1, lag(filled, 2) over w as b2 from sp window w as (partition by category order by i))),
de as (select *, z - avg(z) over w as e, count(*) over w as n, sum(z * z) over w as square
       from dz where z is not null window w as (partition by category, d)),
ds as (select *, sum(e) over (partition by category, d order by i) as s from de),
kq as (select category, d, max(n) as n, sum(s * s) as q, max(square) as square from ds group by 1, 2),
kl as (select a.category, a.d, sum(case when a.i = b.i then 1 else 2 * (1 - (a.i - b.i) / (floor(3 * sqrt(a.n) / 13) + 1)) end
                                   * a.e * b.e) as long_run
       from de a join de b on a.category = b.category and a.d = b.d and a.i - b.i between 0 and floor(3 * sqrt(a.n) / 13)
       group by 1, 2),
kt as (select *, case when long_run > {series_models.NOISE} * square then q / (n * long_run) end as kpss,
              max(case when d = 0 then square end) over (partition by category) as level from kq join kl using (category, d)),
kd as (select category, coalesce(min(d) filter (where kpss is null or kpss <= {series_models.KPSS_5}
                                                 or square <= {series_models.NOISE} * level), max(d)) as d from kt group by 1),
az as (select category, i, month, d, z, {', '.join(f'lag(z, {k}) over w as l{k}' for k in range(1, LAGS + 1))}
       from de join kd using (category, d) window w as (partition by category order by i)),
an as (
  select category, cast(i as int) as month, z as value, case when d < 2 then 1 else 0 end as c0,
         {', '.join(f'l{k}' for k in range(1, LAGS + 1))} from az where l{LAGS} is not null
  union all
  select category, cast(-1 - k as int), null, {', '.join(f'case when k = {k} then 1 else 0 end' for k in range(LAGS + 1))}
  from (select distinct category from az), (select unnest(range({LAGS + 1})) as k)),
"""
    + stepwise_sql("an", AR_TERMS, "sa")
    + ",\nao as ("
    + " union all ".join(
        f"select category, {p} as p, sum(res * res) as rss, count(*) as n from sa{p + 1} where value is not null group by 1"
        for p in range(LAGS + 1)
    )
    + "),\nac as ("
    + " union all ".join(f"select category, {p} as p, -1 - month as k, predicted as c from sa{p + 1} where month < 0" for p in range(LAGS + 1))
    + f"""),
as0 as (select *, p + 1 + case when d < 2 then 1 else 0 end as k from ao join kd using (category)
        join (select category, avg(z * z) as square from az group by 1) using (category)),
as1 as (select *, n * ln(greatest(rss / n, {series_models.NOISE} * square, 1e-300)) + 2 * k + 2e0 * k * (k + 1) / (n - k - 1) as aicc
        from as0 where n - k - 1 > 0),
am as (select category, d, p, aicc, {', '.join(f'max(c) filter (where ac.k = {k}) as f{k}' for k in range(LAGS + 1))}
       from (select category, d, p, aicc from as1 qualify row_number() over (partition by category order by aicc, p) = 1) join ac using (category, p)
       group by 1, 2, 3, 4),
ab as (select sp.category, sp.i, sp.month, sp.value, sp.filled, az.z, {', '.join(f'az.l{k}' for k in range(1, LAGS + 1))},
              lag(filled, 1) over w as b1, lag(filled, 2) over w as b2
       from sp left join az on az.category = sp.category and az.i = sp.i window w as (partition by sp.category order by sp.i)),
fc as (
  select category, 0 as h, [z, {', '.join(f'l{k}' for k in range(1, LAGS))}] as hist, filled as lvl, coalesce(filled - b1, 0) as stp
  from ab qualify i = max(i) over (partition by category)
  union all
  select category, h + 1, list_prepend(zn, hist[1:{LAGS - 1}]),
         case d when 0 then zn when 1 then lvl + zn else lvl + stp + zn end, case d when 2 then stp + zn else zn end
  from (select fc.*, d, f0 + {' + '.join(f'f{k} * coalesce(hist[{k}], 0)' for k in range(1, LAGS + 1))} as zn
        from fc join am using (category) where h < 24)),
ar as (
  select category, month, value as actual,
         case d when 0 then 0 when 1 then b1 else 2 * b1 - b2 end + f0
           + {' + '.join(f'case when p >= {k} then f{k} * l{k} else 0 end' for k in range(1, LAGS + 1))} as predicted
  from (select *, case when z is not null then 1 end as has from ab) join am using (category) where has = 1
  union all select category, month, value, null from ab where z is null
  union all select category, cast(last + to_months(cast(h as int)) as date), null, lvl
  from fc join (select category, max(month) as last from sp group by 1) using (category) where h > 0)
"""
)


def _values(grid) -> str:
    return "[" + ", ".join(f"{v!r}" for v in grid) + "]"


def _form(number: int, trend: bool, season: int) -> str:
    betas = series_models.BETAS if trend else (0.0,)
    gammas = series_models.GAMMAS if season else (0.0,)
    size = 2 + 2 * trend + (season + 1 if season else 0)
    return f"""select {number} as form, {trend} as trend, {season > 0} as season, {size} as size, cast(a as double) as a, cast(b as double) as b, cast(g as double) as g
  from (select unnest({_values(series_models.ALPHAS)}) as a), (select unnest({_values(betas)}) as b), (select unnest({_values(gammas)}) as g)"""


ETS_SQL = f"""
ec as ({' union all '.join(_form(i, t, s) for i, (t, s, _) in enumerate(series_models._candidates()))}),
ew as (select *, row_number() over (partition by form order by a, b, g) as c from ec),
ei as (select category, count(*) as n, count(value) as observed, list(filled order by i) as fl, list(value order by i) as yl, max(month) as last
       from sp group by 1),
es as (
  select category, form, c, 0 as i, cast(null as double) as fitted,
         case when season then list_avg(fl[1:12]) else fl[1] end as lvl,
         case when not trend then 0e0 when season then (list_avg(fl[13:24]) - list_avg(fl[1:12])) / 12
              else (fl[least(n, 12)] - fl[1]) / greatest(least(n, 12) - 1, 1) end as slope,
         case when season then list_transform(fl[1:12], lambda v: v - list_avg(fl[1:12]))
              else list_transform(range(12), lambda v: 0e0) end as seas, 0e0 as sse
  from ei, ew where observed >= size + 3 and n >= case when season then 24 else 0 end
  union all
  select category, form, c, i + 1, f, lvl + slope + a * e, slope + a * b * e,
         list_transform(seas, lambda v, j: case when j = i % 12 + 1 then v + g * (1 - a) * e else v end), sse + e * e
  from (select *, case when y is null then 0e0 else y - f end as e
        from (select es.*, a, b, g, yl[i + 1] as y, lvl + slope + seas[i % 12 + 1] as f
              from es join ew using (form, c) join ei using (category) where i < n))),
ef as (select es.*, a, b, g, trend, season, size, n, observed, last, filled_square
       from es join ew using (form, c) join ei using (category)
       join (select category, avg(filled * filled) as filled_square from sp group by 1) using (category) where i = n),
eb as (select *, observed * ln(greatest(sse / observed, {series_models.NOISE} * filled_square, 1e-300)) + 2 * size
                 + 2e0 * size * (size + 1) / (observed - size - 1) as aicc
       from (select * from (select *, min(sse) over (partition by category, form) as low from ef) where sse <= low * (1 + 1e-9)
             qualify row_number() over (partition by category, form order by c) = 1)
       qualify row_number() over (partition by category order by aicc, form) = 1),
eh as (select eb.*, h, sqrt(sse / (observed - size) * (1 + coalesce((select sum(pow(a + a * b * j + case when j % 12 = 0 then g * (1 - a) else 0 end, 2))
                                                                    from (select unnest(range(1, 24)) as j) where j < h), 0))) as spread
       from eb, (select unnest(range(1, 25)) as h)),
et as (
  select sp.category, sp.month, sp.value as actual, es.fitted as predicted, cast(null as double) as lower, cast(null as double) as upper
  from sp join es on es.category = sp.category and es.i = sp.i + 1 join eb on eb.category = es.category and eb.form = es.form and eb.c = es.c
  union all
  select category, cast(last + to_months(cast(h as int)) as date), null, lvl + slope * h + seas[(n + h - 1) % 12 + 1],
         lvl + slope * h + seas[(n + h - 1) % 12 + 1] - {series_models.NORMAL_95} * spread,
         lvl + slope * h + seas[(n + h - 1) % 12 + 1] + {series_models.NORMAL_95} * spread from eh)
"""


def _boost_sql(rounds: int = 15, rate: float = 0.1, bins: int = 16) -> str:
    """Depth two; the same steps per round: scores of all cuts, the first of the best, both halves again, leaf means."""
    steps = [
        f"""g0 as materialized (select category, month, actual, predicted as base, actual - predicted as target, month(month) - 1 as sb,
  date_diff('day', date '1970-01-01', month) as x from ar)""",
        f"""gp0 as materialized (select category, month, target, sb, 0e0 as p,
  cast(least(greatest(coalesce(floor((x - lo) * {bins} / cast(nullif(hi - lo, 0) as double)), 0), 0), {bins - 1}) as int) as tb
  from (select *, min(case when target is not null then x end) over (partition by category) as lo,
               max(case when target is not null then x end) over (partition by category) as hi from g0))""",
        f"""gc as (select row_number() over (order by f, cut) as id, f, cut from (
  select 0 as f, unnest(range({bins - 1})) as cut union all select 1, unnest(range(11))))""",
    ]
    for r in range(rounds):
        steps.append(f"gr{r}_0 as materialized (select *, target - p as r, 0 as node from gp{r})")
        for level in (0, 1):
            at = f"gr{r}_{level}"
            steps.append(f"""gb{r}_{level} as materialized (
  select category, node, f, cut from (
    select *, max(score) over (partition by category, node) as top from (
      select category, node, id, f, cut, pow(coalesce(sum(r) filter (where b <= cut), 0), 2) / count(*) filter (where b <= cut)
               + pow(coalesce(sum(r) filter (where b > cut), 0), 2) / count(*) filter (where b > cut) as score
      from (select category, node, id, f, cut, r, case f when 0 then tb else sb end as b from {at}, gc where r is not null)
      group by all having count(*) filter (where b <= cut) >= 2 and count(*) filter (where b > cut) >= 2))
  where score >= top - 1e-9 * abs(top) qualify row_number() over (partition by category, node order by id) = 1)""")
            steps.append(f"""gr{r}_{level + 1} as materialized (
  select a.* exclude (node), 2 * node + case when (case f when 0 then tb else sb end) > cut then 1 else 0 end as node
  from {at} a left join gb{r}_{level} b using (category, node))""")
        steps.append(f"""gp{r + 1} as materialized (
  select a.category, a.month, a.target, a.sb, a.p + {rate} * coalesce(v, 0) as p, a.tb
  from gr{r}_2 a left join (select category, node, avg(r) as v from gr{r}_2 where r is not null group by 1, 2) using (category, node))""")
    steps.append(f"gb as (select category, month, actual, base + p as predicted from g0 join gp{rounds} using (category, month))")
    return ",\n".join(steps)


BOOST_SQL = _boost_sql()


def recursive(name: str) -> None:
    ORACLES[name] = ORACLES[name].replace("with params", "with recursive params", 1)


def spine(m):
    return m.once("price-spine", lambda: series_models.gap_free(price_series(m), KEY))


def models(m):
    return m.once("price-ar-models", lambda: series_models.autoregression_models(spine(m), KEY, LAGS))


def autoregression(m):
    return m.once("price-ar", lambda: series_models.autoregression(spine(m), models(m), KEY, most=LAGS))


def smoothing(m):
    return m.once("price-smoothing", lambda: series_models.smoothing(spine(m), KEY))


def boosted(m):
    return m.once("price-boosted", lambda: series_models.boosted_residuals(autoregression(m), KEY))


FORECAST_RESULT = f"""select category, month, {sql_rounded('actual')} as actual, {sql_rounded('predicted', 3)} as predicted from """
AR_CTES = ",".join(x.strip().rstrip(",") for x in (SERIES_SQL, SPINE_SQL, AR_SQL))
ETS_CTES = ",".join(x.strip().rstrip(",") for x in (SERIES_SQL, SPINE_SQL, ETS_SQL))


@query("ts_ar_forecast", FORECAST_RESULT + "ar", AR_CTES)
def ts_ar_forecast(m):
    return forecast_rows(autoregression(m), digits=3)


@query(
    "ts_ar_models",
    f"""select category, cast(d as int) as differences, cast(p as int) as lags, {sql_rounded('aicc', 4)} as aicc, {sql_rounded('f0', 3)} as constant,
        {', '.join(f"{sql_rounded(f'f{k}')} as phi{k}" for k in range(1, LAGS + 1))} from am""",
    AR_CTES,
)
def ts_ar_models(m):
    """Differences, order and coefficients of each series."""
    return models(m).select(
        KEY, "differences", F.col("order").alias("lags"), rounded("aicc", 4).alias("aicc"), rounded("constant", 3).alias("constant"),
        *[rounded(F.col("phi")[k - 1]).alias(f"phi{k}") for k in range(1, LAGS + 1)],
    )


@query(
    "ts_ets_forecast",
    f"""select category, month, {sql_rounded('actual')} as actual, {', '.join(f"{sql_rounded(c, 3)} as {c}" for c in ('predicted', 'lower', 'upper'))} from et""",
    ETS_CTES,
)
def ts_ets_forecast(m):
    return smoothing(m).select(
        KEY, "month", rounded("actual").alias("actual"), *[rounded(c, 3).alias(c) for c in ("predicted", "lower", "upper")]
    )


@query(
    "ts_ets_models",
    "select category, trend, season, a as alpha, b as beta, g as gamma from eb",
    ETS_CTES,
)
def ts_ets_models(m):
    """Form and weights chosen for each series."""
    return smoothing(m).select(KEY, "trend", "season", "alpha", "beta", "gamma").distinct()


@query("ts_gbt_forecast", FORECAST_RESULT + "gb", AR_CTES + ",\n" + BOOST_SQL)
def ts_gbt_forecast(m):
    return forecast_rows(boosted(m), digits=3)


ALL_CTES = ",\n".join(
    x.strip().rstrip(",")
    for x in (
        SERIES_SQL, SPINE_SQL, AR_SQL, ETS_SQL, BOOST_SQL, TIME_SQL,
        stepwise_sql("tk", {"one": "1", "tt": "t", **WAVES}, "sf"), stepwise_sql("tk", {"one": "1", "tt": "t", **BENDS, **LEVELS}, "sh"),
        """lm as (
  select category, month, value as actual, ym + slope * (x - xm) as predicted
  from fx left join (select category, season, avg(x) as xm, avg(value) as ym from fx where value is not null group by 1, 2) using (category, season)
  join (select category, coalesce(sum(sxy) / nullif(sum(sxx), 0), 0) as slope from (
        select category, season, regr_sxy(value, x) as sxy, regr_sxx(value, x) as sxx from fx where value is not null group by 1, 2) group by 1)
    using (category)),
every as (
  select 'seasonal_lm' as model, category, month, actual, predicted from lm
  union all select 'autoregressive', category, month, actual, predicted from ar
  union all select 'smoothing', category, month, actual, predicted from et
  union all select 'boosted_trees', category, month, actual, predicted from gb
  union all select 'fourier', category, month, value, predicted from sf
  union all select 'hinge', category, month, value, predicted from sh)""",
    )
)


def all_models(m):
    series = price_series(m)
    fits = {
        "seasonal_lm": forecast.seasonal_trend(series, KEY),
        "autoregressive": autoregression(m),
        "smoothing": smoothing(m),
        "boosted_trees": boosted(m),
        "fourier": forecast.fourier_trend(series, KEY),
        "hinge": forecast.hinge_trend(series, KEY),
    }
    return forecast.model_table({name: df.select(KEY, "month", "actual", "predicted") for name, df in fits.items()})


@query(
    "ts_model_table",
    f"""select model, category, month, {sql_rounded('predicted', 2)} as predicted from every
        where month > (select max(month) from se where se.category = every.category)""",
    ALL_CTES,
)
def ts_model_table(m):
    """Forecasts of every model after the last observed month of a series."""
    last = price_series(m).groupBy(KEY).agg(F.max("month").alias("last"))
    return all_models(m).join(last, KEY).filter(F.col("month") > F.col("last")).select(
        "model", KEY, "month", rounded("predicted", 2).alias("predicted")
    )


@query(
    "ts_model_accuracy",
    f"""select model, category, count(*) as months, {sql_rounded('avg(abs(actual - predicted))', 3)} as mae,
        {sql_rounded('sqrt(avg(pow(actual - predicted, 2)))', 3)} as rmse,
        {sql_rounded('avg(abs((actual - predicted) / nullif(actual, 0)))')} as mape
        from every where actual is not null and predicted is not null group by 1, 2""",
    ALL_CTES,
)
def ts_model_accuracy(m):
    measured = forecast.accuracy(all_models(m), ["model", KEY])
    return measured.select(
        "model", KEY, "months", rounded("mae", 3).alias("mae"), rounded("rmse", 3).alias("rmse"), rounded("mape").alias("mape")
    )


for _name in ("ts_ar_forecast", "ts_ar_models", "ts_ets_forecast", "ts_ets_models", "ts_gbt_forecast", "ts_model_table", "ts_model_accuracy"):
    recursive(_name)
