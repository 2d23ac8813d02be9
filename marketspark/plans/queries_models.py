"""Regressions, smoothers and forecasts."""

from pyspark.sql import functions as F

from marketspark.functions.stats import EXACT_DF, T_975, Z_975
from marketspark.operators import forecast, regression
from marketspark.operators.many_terms import augment_terms, fit_terms, fitted_terms, glance_terms, tidy_terms
from marketspark.operators.ordered import frequent_groups
from marketspark.operators.smoothing import loess
from marketspark.plans import fundamentals, projections, reports
from marketspark.plans.market import AS_OF
from marketspark.plans.queries_columns import STREETS_SQL, streets
from marketspark.plans.queries_joins import MONTHLY_SQL, SOLD_12MO_SQL
from marketspark.plans.queries_reports import LAST_DAY_SQL, VALUE_SQL
from marketspark.plans.queries_windows import EVENTS_SQL, HISTORY_SQL, INTERP_SQL, REBASED_VALUE_SQL, history
from marketspark.plans.registry import query, rounded, sql_rounded
from marketspark.sources.snapshot import materialize


def t_sql(df: str) -> str:
    """The quantile of Student's t as an SQL expression."""
    z, z3, z5, z7, z9 = (Z_975**k for k in (1, 3, 5, 7, 9))
    cases = " ".join(f"when {df} = {i} then {v!r}::double" for i, v in enumerate(T_975, 1))
    n = f"cast({df} as double)"
    series = (
        f"{z!r}::double + {(z3 + z) / 4!r}::double / {n}"
        f" + {(5 * z5 + 16 * z3 + 3 * z) / 96!r}::double / pow({n}, 2)"
        f" + {(3 * z7 + 19 * z5 + 17 * z3 - 15 * z) / 384!r}::double / pow({n}, 3)"
        f" + {(79 * z9 + 776 * z7 + 1482 * z5 - 1920 * z3 - 945 * z) / 92160!r}::double / pow({n}, 4)"
    )
    return f"(case {cases} when {df} > {EXACT_DF} then {series} end)"


def ols_sql(name: str, source: str, keys: str, y: str, x: str) -> str:
    """CTE ``name``: the moments and estimates of a line per group."""
    return f"""
{name}_m as (
  select {keys}, count(*) as n, regr_avgx(y, x) as xm, regr_avgy(y, x) as ym,
         regr_sxx(y, x) as sxx, regr_sxy(y, x) as sxy, regr_syy(y, x) as syy
  from (select {keys}, cast({y} as double) as y, cast({x} as double) as x from {source})
  where y is not null and x is not null group by {keys}),
{name} as (
  select *, sqrt(rss / nullif(dfr, 0)) as sigma from (
    select *, ym - coalesce(slope, 0) * xm as icpt, greatest(syy - coalesce(slope, 0) * sxy, 0) as rss,
           n - case when slope is null then 1 else 2 end as dfr
    from (select *, case when n >= 2 and sxx > 0 then sxy / sxx end as slope from {name}_m)))
"""


def fit_sql(x: str) -> str:
    return f"(ym + coalesce(slope, 0) * ({x} - xm))"


def half_sql(x: str) -> str:
    return (
        f"({t_sql('dfr')} * sigma * sqrt(1e0 / n + case when slope is null then 0 "
        f"else pow({x} - xm, 2) / sxx end))"
    )


VALUE_MODEL_SQL = VALUE_SQL + "," + ols_sql("vm", "vby", "sale_year", "market_value", "day_of_year")
COUNT_SQL = """
sc as (
  select sale_year, cast(dayofyear(sale_date) as int) as day_of_year, listing_id,
         row_number() over (partition by sale_year order by sale_date, listing_id) as sale_count
  from e where sale_date is not null)
"""
COUNT_MODEL_SQL = COUNT_SQL + "," + ols_sql("cm", "sc", "sale_year", "sale_count", "day_of_year")
VALUE_SCORES_SQL = f"""
{VALUE_MODEL_SQL}, {LAST_DAY_SQL},
vs as (
  select sale_year, x, {fit_sql('x')} as fitted, {fit_sql('x')} - {half_sql('x')} as lower,
         {fit_sql('x')} + {half_sql('x')} as upper
  from vm, (select 1e0 as x union all select last_sale_day from last_day))
"""
COUNT_SCORES_SQL = f"""
{COUNT_MODEL_SQL},
cs as (
  select sale_year, x, {fit_sql('x')} as fitted, {fit_sql('x')} - {half_sql('x')} as lower,
         {fit_sql('x')} + {half_sql('x')} as upper
  from cm, (values (1), (91), (182), (365)) t(x))
"""


@query(
    "reg_value_by_year",
    f"""select sale_year, {sql_rounded('x')} as day_of_year, {sql_rounded('fitted / 1e6')} as fitted,
        {sql_rounded('lower / 1e6')} as lower, {sql_rounded('upper / 1e6')} as upper from vs""",
    VALUE_SCORES_SQL,
)
def reg_value_by_year(m):
    return projections.value_scores(m.listings).select(
        "sale_year",
        rounded("day_of_year").alias("day_of_year"),
        *[rounded(projections.money(c)).alias(c) for c in ("fitted", "lower", "upper")],
    )


@query(
    "reg_salecount_by_year",
    f"""select sale_year, cast(x as int) as day_of_year, {sql_rounded('fitted')} as fitted,
        {sql_rounded('lower')} as lower, {sql_rounded('upper')} as upper from cs""",
    COUNT_SCORES_SQL,
)
def reg_salecount_by_year(m):
    scores = projections.sale_count_scores(m.listings, m.config.sale_count_days)
    return scores.select(
        "sale_year", "day_of_year", *[rounded(c).alias(c) for c in ("fitted", "lower", "upper")]
    )


LOG_LIK = "(-n / 2e0 * (ln(2 * pi() * rss / n) + 1))"


@query(
    "reg_glance",
    f"""select sale_year, {sql_rounded('1 - rss / syy')} as r_squared,
        {sql_rounded('1 - rss / syy * (n - 1) / dfr')} as adj_r_squared, {sql_rounded('sigma')} as sigma,
        {sql_rounded('(syy - rss) / (rss / dfr)', 0)} as statistic, 1 as df,
        {sql_rounded(LOG_LIK, 4)} as log_lik, {sql_rounded(f'-2 * {LOG_LIK} + 6', 4)} as aic,
        {sql_rounded(f'-2 * {LOG_LIK} + 3 * ln(n)', 4)} as bic, {sql_rounded('rss', 0)} as deviance,
        cast(dfr as bigint) as df_residual, cast(n as bigint) as nobs from cm""",
    COUNT_MODEL_SQL,
)
def reg_glance(m):
    quality = regression.glance(projections.sale_count_models(m.listings), ["sale_year"])
    digits = {"r_squared": 6, "adj_r_squared": 6, "sigma": 6, "statistic": 0, "log_lik": 4, "aic": 4, "bic": 4, "deviance": 0}
    return quality.withColumns({c: rounded(c, d) for c, d in digits.items()})


@query(
    "reg_glance_value",
    f"""select sale_year, {sql_rounded('1 - rss / syy')} as r_squared,
        {sql_rounded('1 - rss / syy * (n - 1) / dfr')} as adj_r_squared, {sql_rounded('sigma / 1e6', 5)} as sigma,
        {sql_rounded('(syy - rss) / (rss / dfr)', 0)} as statistic, case when slope is not null then 1 end as df,
        {sql_rounded(LOG_LIK, 4)} as log_lik, {sql_rounded(f'-2 * {LOG_LIK} + 6', 4)} as aic,
        {sql_rounded(f'-2 * {LOG_LIK} + 3 * ln(n)', 4)} as bic, {sql_rounded('rss / 1e12', 1)} as deviance,
        cast(dfr as bigint) as df_residual, cast(n as bigint) as nobs from vm""",
    VALUE_MODEL_SQL,
)
def reg_glance_value(m):
    """Quality of the running amount's line per sale year; sigma in millions."""
    quality = regression.glance(projections.value_models(m.listings), ["sale_year"])
    money = quality.withColumns({"sigma": F.col("sigma") / 1e6, "deviance": F.col("deviance") / 1e12})
    digits = {"r_squared": 6, "adj_r_squared": 6, "sigma": 5, "statistic": 0, "log_lik": 4, "aic": 4, "bic": 4, "deviance": 1}
    return money.withColumns({c: rounded(c, d) for c, d in digits.items()})


VALUE_ICPT_SE = "(sigma * sqrt(1e0 / n + case when slope is null then 0 else xm * xm / sxx end))"


@query(
    "reg_tidy_value",
    f"""select sale_year, '(Intercept)' as term, {sql_rounded('icpt', 2)} as estimate, {sql_rounded(VALUE_ICPT_SE, 2)} as std_error,
        {sql_rounded(f'icpt / {VALUE_ICPT_SE}', 4)} as statistic from vm
        union all select sale_year, 'day_of_year', {sql_rounded('slope', 2)}, {sql_rounded('sigma / sqrt(sxx)', 2)},
        {sql_rounded('slope / (sigma / sqrt(sxx))', 4)} from vm""",
    VALUE_MODEL_SQL,
)
def reg_tidy_value(m):
    """Coefficients of the running amount's line per sale year."""
    rows = regression.tidy(projections.value_models(m.listings), ["sale_year"], "day_of_year")
    return rows.select(
        "sale_year", "term", rounded("estimate", 2).alias("estimate"), rounded("std_error", 2).alias("std_error"),
        rounded("statistic", 4).alias("statistic"),
    )


def p_value_sql(t: str) -> str:
    """Two-sided p-value of ``t`` with ``dfr`` degrees of freedom, as the finite trigonometric sum."""
    angle = f"atan(abs({t}) / sqrt(dfr))"
    odd = (
        f"2 / pi() * ({angle} + sin({angle}) * coalesce((select sum(exp(lgamma(i + 1) - lgamma(i + 1.5e0))"
        f" * sqrt(pi()) / 2 * pow(cos({angle}), 2 * i + 1)) from steps where i <= (dfr - 3) / 2), 0))"
    )
    even = (
        f"sin({angle}) * (select sum(exp(lgamma(i + 0.5e0) - lgamma(i + 1)) / sqrt(pi())"
        f" * pow(cos({angle}), 2 * i)) from steps where i <= (dfr - 2) / 2)"
    )
    return f"case when dfr >= 1 then 1 - case when dfr % 2 = 1 then {odd} else {even} end end"


SPEED_MODEL_SQL = (
    ols_sql(
        "pm",
        "(select listing_year, category, time_on_market, day_of_year from e where sale_date is not null)",
        "listing_year, category",
        "time_on_market",
        "day_of_year",
    )
    + """,
steps as (select cast(unnest(range(0, (select cast(max(dfr) // 2 + 2 as bigint) from pm))) as double) as i),
pt as (
  select listing_year, category, dfr, slope / nullif(sigma / sqrt(sxx), 0) as ts,
         icpt / nullif(sigma * sqrt(1e0 / n + case when slope is null then 0 else xm * xm / sxx end), 0) as ti
  from pm)
"""
)


def speed_models(m):
    """Does the time on market depend on the season? One line per listing year and category."""
    return regression.ols(m.sold, ["listing_year", "category"], "time_on_market", "day_of_year")


@query(
    "reg_glance_p_value",
    f"""select listing_year, category, {sql_rounded('ts * ts')} as statistic,
        {sql_rounded(p_value_sql('ts'))} as p_value from pt""",
    SPEED_MODEL_SQL,
)
def reg_glance_p_value(m):
    quality = regression.with_f_p_value(regression.glance(speed_models(m), ["listing_year", "category"]))
    return quality.select(
        "listing_year", "category", rounded("statistic").alias("statistic"), rounded("p_value").alias("p_value")
    )


@query(
    "reg_tidy",
    f"""select sale_year, '(Intercept)' as term, {sql_rounded('icpt')} as estimate,
        {sql_rounded('sigma * sqrt(1e0 / n + xm * xm / sxx)')} as std_error,
        {sql_rounded('icpt / (sigma * sqrt(1e0 / n + xm * xm / sxx))', 4)} as statistic from cm
        union all
        select sale_year, 'day_of_year', {sql_rounded('slope')}, {sql_rounded('sigma / sqrt(sxx)')},
        {sql_rounded('slope / (sigma / sqrt(sxx))', 4)} from cm""",
    COUNT_MODEL_SQL,
)
def reg_tidy(m):
    rows = regression.tidy(projections.sale_count_models(m.listings), ["sale_year"], "day_of_year")
    return rows.select(
        "sale_year", "term", rounded("estimate").alias("estimate"), rounded("std_error").alias("std_error"),
        rounded("statistic", 4).alias("statistic"),
    )


@query(
    "reg_tidy_p_value",
    f"""select listing_year, category, '(Intercept)' as term, {sql_rounded('ti', 5)} as statistic,
        {sql_rounded(p_value_sql('ti'))} as p_value from pt
        union all select listing_year, category, 'day_of_year', {sql_rounded('ts', 5)},
        {sql_rounded(p_value_sql('ts'))} from pt""",
    SPEED_MODEL_SQL,
)
def reg_tidy_p_value(m):
    rows = regression.with_t_p_value(
        regression.tidy(speed_models(m), ["listing_year", "category"], "day_of_year")
    )
    return rows.select(
        "listing_year", "category", "term", rounded("statistic", 5).alias("statistic"),
        rounded("p_value").alias("p_value"),
    )


@query(
    "reg_year_projection",
    f"""select v.sale_year, {sql_rounded('round_even(v.lower / 1e6, 1)', 1)} as value_lower,
        {sql_rounded('round_even(v.upper / 1e6, 1)', 1)} as value_upper,
        cast(floor(c.lower) as bigint) as sales_lower, cast(ceil(c.upper) as bigint) as sales_upper
        from vs v join cs c on c.sale_year = v.sale_year, params
        where v.sale_year = year(as_of) and v.x = (select max(x) from vs) and c.x = 365""",
    VALUE_SCORES_SQL + "," + COUNT_SCORES_SQL,
)
def reg_year_projection(m):
    ranges = projections.year_end_range(m.listings, m.config.sale_count_days, AS_OF)
    return ranges.withColumns({c: rounded(c, 1) for c in ("value_lower", "value_upper")})


@query(
    "reg_actual_vs_predicted",
    f"""select 'value' as measure, sale_year, {sql_rounded('actual / 1e6')} as actual,
        {sql_rounded('fitted / 1e6')} as fitted, {sql_rounded('lower / 1e6')} as lower,
        {sql_rounded('upper / 1e6')} as upper, sale_year <> year(as_of) as predicted
        from (select sale_year, cast(max(market_value) as double) as actual from vby group by 1)
        join vs using (sale_year), params where x = (select max(x) from vs)
        union all
        select 'count', sale_year, {sql_rounded('actual')}, {sql_rounded('fitted')}, {sql_rounded('lower')},
        {sql_rounded('upper')}, sale_year <> year(as_of)
        from (select sale_year, max(sale_count) as actual from sc group by 1)
        join cs using (sale_year), params where x = 365""",
    VALUE_SCORES_SQL + "," + COUNT_SCORES_SQL,
)
def reg_actual_vs_predicted(m):
    value = projections.actual_and_predicted(
        projections.value_models(m.listings), projections.value_days(m.listings), AS_OF
    )
    counts = projections.actual_and_predicted(
        projections.sale_count_models(m.listings),
        F.array(F.lit(max(m.config.sale_count_days))),
        AS_OF,
    )
    numbers = ("actual", "fitted", "lower", "upper")
    in_millions = value.select(
        F.lit("value").alias("measure"), "sale_year", "predicted",
        *[rounded(projections.money(c)).alias(c) for c in numbers],
    )
    return in_millions.unionByName(
        counts.select(
            F.lit("count").alias("measure"), "sale_year", "predicted", *[rounded(c).alias(c) for c in numbers]
        )
    )


def horizon_sql(day: str, measure: str, where: str) -> str:
    return f"""
hz as (
  select category, period, date_diff('day', date '1970-01-01', {day}) as x,
         cast(sum({measure}) over (partition by period, category order by {day}, listing_id
              rows unbounded preceding) as double) as y
  from e, params, (values (60), (120), (180), (270), (360)) t(period)
  where {day} > as_of - period and {where}),
{ols_sql('hm', 'hz', 'category, period', 'y', 'x')}
"""


def horizon_result_sql(scale: str = "1") -> str:
    amount = f"coalesce(slope, 0) * 365 / {scale}"
    return f"""select category, period, {sql_rounded(amount)} as amount,
        {sql_rounded('case when syy > 0 then 1 - rss / syy end')} as r_squared from hm"""


def _horizons(m, rows, day, measure, scale=1.0):
    projected = regression.horizon_projection(rows, day, measure, m.config.horizons, AS_OF)
    return projected.select(
        "category", "period", rounded(F.col("amount") / scale).alias("amount"),
        rounded("r_squared").alias("r_squared"),
    )


@query("reg_horizon_value", horizon_result_sql("1e6"), horizon_sql("sale_date", "amount", "amount is not null"))
def reg_horizon_value(m):
    rows = m.sales.filter(F.col("amount").isNotNull())
    return _horizons(m, rows, "sale_date", F.col("amount"), 1e6)


@query("reg_horizon_listings", horizon_result_sql(), horizon_sql("listing_date", "1", "true"))
def reg_horizon_listings(m):
    return _horizons(m, m.listings, "listing_date", F.lit(1).cast("long"))


@query("reg_horizon_sales", horizon_result_sql(), horizon_sql("sale_date", "1", "true"))
def reg_horizon_sales(m):
    return _horizons(m, m.sales, "sale_date", F.lit(1).cast("long"))


def trend_sql(day: str, y: str) -> str:
    return f"""
{HISTORY_SQL},
tr as (select category, period, date_diff('day', date '1970-01-01', {day}) as x, {y} as y
       from hist, (values (60), (180), (360)) t(period)
       where {day} is not null and {day} > as_of - period),
{ols_sql('tm', 'tr', 'category, period', 'y', 'x')},
tp as (select tm.*, cast(as_of - period as date) as date from tm, params
       union all select tm.*, cast(date_trunc('year', as_of) + interval 1 year as date) from tm, params)
"""


DATE_X = "date_diff('day', date '1970-01-01', date)"


def trend_result_sql(scale: str) -> str:
    at_date = fit_sql(DATE_X)
    return f"select category, period, date, {sql_rounded(f'{at_date} / {scale}', 5)} as fitted from tp"


@query("reg_listing_trend", trend_result_sql("1"), trend_sql("listing_date", "cumulative_listing"))
def reg_listing_trend(m):
    points = regression.trend_points(
        history(m), "listing_date", "cumulative_listing", m.config.trend_horizons, AS_OF
    )
    return points.withColumn("fitted", rounded("fitted", 5))


@query("reg_value_trend", trend_result_sql("1e6"), trend_sql("sale_date", "cumulative_value"))
def reg_value_trend(m):
    points = regression.trend_points(
        history(m), "sale_date", "cumulative_value", m.config.trend_horizons, AS_OF
    )
    return points.withColumn("fitted", rounded(F.col("fitted") / 1e6, 5))


@query(
    "reg_trend_rebased",
    f"""select 'listings' as measure, category, period, date, {sql_rounded(f"{fit_sql(DATE_X)} - (select y from base)", 5)} as fitted from tp""",
    trend_sql("listing_date", "cumulative_listing") + "," + INTERP_SQL,
)
def reg_trend_rebased(m):
    """The lines of the running listings, less the running listings at the start of the year."""
    rows = history(m)
    points = regression.trend_points(rows, "listing_date", "cumulative_listing", m.config.trend_horizons, AS_OF)
    base = regression.interpolate_at(rows, "listing_date", "cumulative_listing", F.trunc(F.lit(AS_OF), "YEAR"))
    return points.select(F.lit("listings").alias("measure"), "category", "period", "date", rounded(F.col("fitted") - base.scalar(), 5).alias("fitted"))


@query(
    "reg_value_trend_rebased",
    f"""select 'value' as measure, category, period, date, {sql_rounded(f"({fit_sql(DATE_X)} - (select y from base)) / 1e6", 5)} as fitted from tp""",
    trend_sql("listing_date", "sold_value").replace("from hist, (values", "from hv, (values").replace(HISTORY_SQL, REBASED_VALUE_SQL),
)
def reg_value_trend_rebased(m):
    """The lines of the running amount in listing order, less its value at the start of the year."""
    rows = history(m)
    points = regression.trend_points(rows, "listing_date", "sold_value", m.config.trend_horizons, AS_OF)
    base = regression.interpolate_at(rows, "listing_date", "sold_value", F.trunc(F.lit(AS_OF), "YEAR"))
    return points.select(F.lit("value").alias("measure"), "category", "period", "date", rounded((F.col("fitted") - base.scalar()) / 1e6, 5).alias("fitted"))


CUBIC_SQL = """
c0 as (
  select listing_id, (sale_date - (select min(sale_date) from e))
           / cast((select max(sale_date) - min(sale_date) from e) as double) as x,
         sale_date, cast(sum(amount) over (order by sale_date, listing_id rows unbounded preceding) as double) / 1e6 as y
  from e where sale_date is not null),
k1 as (select avg(x) as a from c0),
c1 as (select c0.*, x - a as p1 from c0, k1),
k2 as (select sum(x * p1 * p1) / sum(p1 * p1) as a, sum(p1 * p1) / count(*) as b from c1),
c2 as (select c1.*, (x - a) * p1 - b as p2 from c1, k2),
k3 as (select sum(x * p2 * p2) / sum(p2 * p2) as a, sum(p2 * p2) / sum(p1 * p1) as b from c2),
c3 as (select c2.*, (x - a) * p2 - b * p1 as p3 from c2, k3),
kc as (select avg(y) as g0, sum(y * p1) / sum(p1 * p1) as g1, sum(y * p2) / sum(p2 * p2) as g2,
              sum(y * p3) / sum(p3 * p3) as g3 from c3),
cf as (select sale_date, y, g0 + g1 * p1 + g2 * p2 + g3 * p3 as fitted from c3, kc)
"""
CUBIC_TERMS = ["one", "x", "x2", "x3"]
# Sums of the orthogonal terms, the raw coefficients of each, and what a row's leverage is made of.
CUBIC_MODEL_SQL = (
    CUBIC_SQL
    + """,
kn as (select count(*) as n, count(*) - 4 as dfr, sum(p1 * p1) as q1, sum(p2 * p2) as q2, sum(p3 * p3) as q3 from c3),
kr as (select sum(pow(y - fitted, 2)) as rss, regr_syy(y, y) as syy from cf),
ks as (select *, sqrt(rss / dfr) as sigma from kn, kr),
kb as (
  select k1.a as a1, k2.a as a2, k2.b as b2, k3.a as a3, k3.b as b3 from k1, k2, k3),
kp as (
  select 0 as power, 1e0 as r0, -a1 as r1, a1 * a2 - b2 as r2, -a3 * (a1 * a2 - b2) + b3 * a1 as r3 from kb
  union all select 1, 0, 1, -(a1 + a2), (a1 * a2 - b2) + a3 * (a1 + a2) - b3 from kb
  union all select 2, 0, 0, 1, -(a1 + a2) - a3 from kb
  union all select 3, 0, 0, 0, 1 from kb),
kt as (
  select power, dfr, (r0 * g0 + r1 * g1 + r2 * g2 + r3 * g3) * 1e6 / pow(span / 1e3, power) as estimate,
         sigma * sqrt(r0 * r0 / n + r1 * r1 / q1 + r2 * r2 / q2 + r3 * r3 / q3) * 1e6 / pow(span / 1e3, power) as std_error
  from kp, kc, ks, (select cast(max(sale_date) - min(sale_date) as double) as span from e)),
kh as (
  select listing_id, sale_date, g0 + g1 * p1 + g2 * p2 + g3 * p3 as fitted, y - (g0 + g1 * p1 + g2 * p2 + g3 * p3) as residual,
         1e0 / n + p1 * p1 / q1 + p2 * p2 / q2 + p3 * p3 / q3 as hat, sigma from c3, kc, ks)
"""
)


def cubic_rows(m):
    """Running amount in millions and powers of the share of the whole time."""
    rows = m.once("value-total", lambda: reports.value_total(m.listings))
    return cubic_terms(m, rows).withColumn("y", projections.money("total_amount"))


def cubic_terms(m, rows):
    x = F.datediff("sale_date", m.first("sale_date", m.sold).scalar()) / F.nullif(cubic_span(m), F.lit(0))
    powers = rows.withColumns({"one": F.lit(1.0), "x": x})
    return powers.withColumns({"x2": F.col("x") * F.col("x"), "x3": F.col("x") * F.col("x") * F.col("x")})


def cubic_span(m):
    return m.sold.agg(F.datediff(F.max("sale_date"), F.min("sale_date")).alias("days")).scalar()


def cubic_model(m):
    return m.once("cubic-model", lambda: fit_terms(cubic_rows(m), [], "y", CUBIC_TERMS))


@query(
    "reg_cubic",
    f"select distinct sale_date, {sql_rounded('fitted', 2)} as fitted from cf",
    CUBIC_SQL,
)
def reg_cubic(m):
    """The curve on each sale date; only the dates are scored, not the sales."""
    dates = cubic_terms(m, m.sold.select("sale_date").distinct())
    scored = dates.crossJoin(F.broadcast(cubic_model(m)))  # one row
    return scored.select("sale_date", rounded(fitted_terms(CUBIC_TERMS), 2).alias("fitted"))


@query(
    "reg_cubic_quality",
    f"""select cast(count(*) as bigint) as nobs, {sql_rounded('sqrt(sum(pow(y - fitted, 2)) / (count(*) - 4))', 4)} as sigma,
        {sql_rounded('1 - sum(pow(y - fitted, 2)) / regr_syy(y, y)')} as r_squared from cf""",
    CUBIC_SQL,
)
def reg_cubic_quality(m):
    quality = glance_terms(cubic_model(m), [])
    return quality.select("nobs", rounded("sigma", 4).alias("sigma"), rounded("r_squared").alias("r_squared"))


@query(
    "reg_cubic_glance",
    f"""select {sql_rounded('1 - rss / syy', 8)} as r_squared, {sql_rounded('1 - rss / syy * (n - 1) / dfr', 8)} as adj_r_squared,
        {sql_rounded('sigma', 5)} as sigma, {sql_rounded('(syy - rss) / 3 / (rss / dfr)', 0)} as statistic, 3 as df,
        {sql_rounded(LOG_LIK, 2)} as log_lik, {sql_rounded(f'-2 * {LOG_LIK} + 10', 2)} as aic,
        {sql_rounded(f'-2 * {LOG_LIK} + 5 * ln(n)', 2)} as bic, {sql_rounded('rss', 2)} as deviance,
        cast(dfr as bigint) as df_residual, cast(n as bigint) as nobs from ks""",
    CUBIC_MODEL_SQL,
)
def reg_cubic_glance(m):
    digits = {"r_squared": 8, "adj_r_squared": 8, "sigma": 5, "statistic": 0, "log_lik": 2, "aic": 2, "bic": 2, "deviance": 2}
    return glance_terms(cubic_model(m), []).withColumns({c: rounded(c, d) for c, d in digits.items()})


@query(
    "reg_cubic_tidy",
    f"""select case power when 0 then '(Intercept)' when 1 then 'time' else 'time^' || power end as term,
        {sql_rounded('estimate', 0)} as estimate, {sql_rounded('std_error', 0)} as std_error,
        {sql_rounded('estimate / std_error', 3)} as statistic from kt""",
    CUBIC_MODEL_SQL,
)
def reg_cubic_tidy(m):
    """Coefficients per thousand days and its powers, in currency."""
    share = cubic_span(m).cast("double") / 1e3
    rows = tidy_terms(
        cubic_model(m), [], ["(Intercept)", "time", "time^2", "time^3"], [F.lit(1e6) / F.pow(share, F.lit(float(k))) for k in range(4)]
    )
    return rows.select("term", rounded("estimate", 0).alias("estimate"), rounded("std_error", 0).alias("std_error"), rounded("statistic", 3).alias("statistic"))


@query(
    "reg_cubic_augment",
    f"""select listing_id, sale_date, {sql_rounded('fitted', 4)} as fitted, {sql_rounded('residual', 4)} as residual, {sql_rounded('hat', 9)} as hat,
        {sql_rounded('residual / (sigma * sqrt(1 - hat))', 4)} as std_residual,
        {sql_rounded('pow(residual / (sigma * (1 - hat)), 2) * hat / 4', 6)} as cooks_distance from kh""",
    CUBIC_MODEL_SQL,
)
def reg_cubic_augment(m):
    rows = augment_terms(cubic_rows(m), cubic_model(m), [], "y", CUBIC_TERMS)
    digits = {"fitted": 4, "residual": 4, "hat": 9, "std_residual": 4, "cooks_distance": 6}
    return rows.select("listing_id", "sale_date", *[rounded(c, d).alias(c) for c, d in digits.items()])


HAT = "(1e0 / n + pow(day_of_year - xm, 2) / sxx)"
RES = f"(sale_count - {fit_sql('day_of_year')})"


@query(
    "reg_augment",
    f"""select listing_id, sale_year, {sql_rounded(fit_sql('day_of_year'), 5)} as fitted,
        {sql_rounded(RES, 5)} as residual, {sql_rounded(HAT, 8)} as hat,
        {sql_rounded(f'{RES} / (sigma * sqrt(1 - {HAT}))', 5)} as std_residual,
        {sql_rounded(f'pow({RES} / (sigma * (1 - {HAT})), 2) * {HAT} / 2', 7)} as cooks_distance
        from sc join cm using (sale_year)""",
    COUNT_MODEL_SQL,
)
def reg_augment(m):
    counted = reports.sale_counter(m.listings)
    models = materialize(
        regression.ols(counted, ["sale_year"], "sale_count", "day_of_year"), "sale-count-models"
    )
    rows = regression.augment(counted, models, ["sale_year"], "sale_count", "day_of_year")
    return rows.select(
        "listing_id", "sale_year", rounded("fitted", 5).alias("fitted"), rounded("residual", 5).alias("residual"),
        rounded("hat", 8).alias("hat"), rounded("std_residual", 5).alias("std_residual"),
        rounded("cooks_distance", 7).alias("cooks_distance"),
    )


@query(
    "feat_date_recipe",
    f"""select listing_id, cast(month(sale_date) as int) as sale_date_month,
        cast(dayofweek(sale_date) + 1 as int) as sale_date_dow, cast(year(sale_date) as int) as sale_date_year,
        {sql_rounded("(epoch(sale_date) / 86400e0 - avg(epoch(sale_date) / 86400e0) over ()) / stddev_samp(epoch(sale_date) / 86400e0) over ()")} as date_num
        from e where sale_date is not null""",
)
def feat_date_recipe(m):
    features = forecast.date_features(m.sold.select("listing_id", "sale_date"), "sale_date")
    return features.withColumn("date_num", rounded("date_num"))


@query(
    "smooth_lm",
    f"""select category, {sql_rounded('slope')} as slope, {sql_rounded('ym')} as mean_amount,
        {sql_rounded(fit_sql("date_diff('day', date '1970-01-01', as_of)"), 4)} as fitted_at_as_of
        from sm, params""",
    ols_sql(
        "sm",
        "(select category, amount, date_diff('day', date '1970-01-01', sale_date) as x from e)",
        "category",
        "amount",
        "x",
    ),
)
def smooth_lm(m):
    rows = m.sold.withColumn("x", F.unix_date("sale_date"))
    models = regression.ols(rows, ["category"], "amount", "x")
    at = F.unix_date(F.lit(AS_OF))
    return models.select(
        "category", rounded("slope").alias("slope"), rounded("y_mean").alias("mean_amount"),
        rounded(regression.fitted_at(at), 4).alias("fitted_at_as_of"),
    )


SMOOTH_LM_SQL = (
    ols_sql(
        "sm",
        "(select category, amount, date_diff('day', date '1970-01-01', sale_date) as x from e)",
        "category",
        "amount",
        "x",
    )
    + """,
sr as (select category, min(x) + (max(x) - min(x)) * g / 79e0 as x
       from (select category, date_diff('day', date '1970-01-01', sale_date) as x from e where sale_date is not null and amount is not null),
            (select unnest(range(80)) as g) group by category, g)
"""
)


@query(
    "smooth_lm_grid",
    f"""select category, {sql_rounded('x', 4)} as x, {sql_rounded(fit_sql('x'), 2)} as fitted,
        {sql_rounded(f"{fit_sql('x')} - {half_sql('x')}", 2)} as lower, {sql_rounded(f"{fit_sql('x')} + {half_sql('x')}", 2)} as upper
        from sm join sr using (category)""",
    SMOOTH_LM_SQL,
)
def smooth_lm_grid(m):
    """The line of the amount per category on 80 even points of its days, with the band of the mean."""
    rows = m.sold.filter(F.col("amount").isNotNull()).withColumn("x", F.unix_date("sale_date"))
    span = rows.groupBy("category").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    grid = span.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(79)))).select(
        "category", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / 79.0).alias("x")
    )
    scored = regression.predict(regression.ols(rows, ["category"], "amount", "x").join(grid, "category"), "x")
    return scored.select("category", rounded("x", 4).alias("x"), *[rounded(c, 2).alias(c) for c in ("fitted", "lower", "upper")])


def local_fit_sql(name: str, anchors: str) -> str:
    return f"""
{name}_d as (
  select x0, x, n, sy, abs(x - x0) as d, sum(n) over (partition by x0 order by abs(x - x0)) as reached
  from {anchors}, lp),
{name}_h as (select x0, min(d) as h from {name}_d
             where reached >= (select floor(sum(n) * 0.75e0 + 1e-5) from lp) group by 1),
{name}_w as (select d.x0, n, sy, (x - d.x0) / h as u, pow(1 - pow(d / h, 3), 3) as w
             from {name}_d d join {name}_h using (x0) where d < h),
{name}_s as (
  select x0, sum(n*w) as s0, sum(n*w*u) as s1, sum(n*w*u*u) as s2, sum(n*w*u*u*u) as s3, sum(n*w*u*u*u*u) as s4,
         sum(w*sy) as t0, sum(w*sy*u) as t1, sum(w*sy*u*u) as t2,
         sum(n*w*w) as v0, sum(n*w*w*u) as v1, sum(n*w*w*u*u) as v2, sum(n*w*w*u*u*u) as v3,
         sum(n*w*w*u*u*u*u) as v4 from {name}_w group by 1),
{name}_a as (select *, s2*s4 - s3*s3 as a0, s2*s3 - s1*s4 as a1, s1*s3 - s2*s2 as a2 from {name}_s),
{name}_t as (select *, s0*a0 + s1*a1 + s2*a2 as det from {name}_a),
{name} as (
  select x0, (a0*t0 + a1*t1 + a2*t2) / det as fitted, a0 / det as own,
         (a0*a0*v0 + 2*a0*a1*v1 + (a1*a1 + 2*a0*a2)*v2 + 2*a1*a2*v3 + a2*a2*v4) / (det*det) as norm2
  from {name}_t)
"""


def loess_sql(day: str, value: str, source: str) -> str:
    return f"""
lp as (select cast(date_diff('day', date '1970-01-01', {day}) as double) as x, count(*) as n,
              sum(cast({value} as double)) as sy, sum(cast({value} as double) * cast({value} as double)) as sy2
       from {source} where {day} is not null and {value} is not null group by 1),
lg as (select min(x) + (max(x) - min(x)) * g / 79 as x0
       from lp, (select unnest(range(80)) as g) group by g),
ld as (select x as x0 from lp),
{local_fit_sql('lf', 'lg')},
{local_fit_sql('le', 'ld')},
lr as (select sum(sy2 - 2 * fitted * sy + n * fitted * fitted) as rss,
              sum(n) - 2 * sum(n * own) + sum(n * norm2) as free
       from lp join le on lp.x = le.x0)
"""


LOESS_HALF = f"{t_sql('floor(free)')} * sqrt(rss / free) * sqrt(norm2)"


def loess_result(digits: int = 6, band: bool = True) -> str:
    edges = f", {sql_rounded(f'fitted - {LOESS_HALF}', digits)} as lower, {sql_rounded(f'fitted + {LOESS_HALF}', digits)} as upper"
    return f"select {sql_rounded('x0', 4)} as x, {sql_rounded('fitted', digits)} as fitted{edges if band else ''} from lf, lr"


def curve(df, day, value, digits=6, band=True):
    found = loess(df.select(day, value), day, value, band=band)
    return found.select(rounded("x", 4).alias("x"), *[rounded(c, digits).alias(c) for c in found.columns[1:]])


@query("smooth_loess", loess_result(), loess_sql("sale_date", "time_on_market", "e"))
def smooth_loess(m):
    return curve(m.sold, "sale_date", "time_on_market")


@query("smooth_loess_amount", loess_result(2), loess_sql("sale_date", "amount", "e"))
def smooth_loess_amount(m):
    return curve(m.sold, "sale_date", "amount", digits=2)


SPEED_SQL = """
sy0 as (select event_date as date, inventory / cast(nullif(homes_sold, 0) as double) * 12 as speed
        from inv join sold_anchor on event_date = date where event_date >= (select first + interval 1 year from first_anchor)),
"""
MONTH_SPEED_SQL = """
sm0 as (select date, inventory / cast(nullif(homes_sold, 0) as double) * 12 as speed
        from monthly join sold_month using (date) where date >= (select first + interval 1 year from first_anchor)),
"""


@query(
    "smooth_loess_speed",
    loess_result(4, band=False),
    ",".join((EVENTS_SQL, SOLD_12MO_SQL, SPEED_SQL + loess_sql("date", "speed", "sy0"))),
)
def smooth_loess_speed(m):
    """Months of inventory at each event."""
    return curve(fundamentals.market_speed_at_events(m.listings, AS_OF), "date", "market_speed", digits=4, band=False)


@query(
    "smooth_loess_speed_month",
    loess_result(4, band=False),
    ",".join((EVENTS_SQL, MONTHLY_SQL, SOLD_12MO_SQL, MONTH_SPEED_SQL + loess_sql("date", "speed", "sm0"))),
)
def smooth_loess_speed_month(m):
    """Months of inventory by month."""
    return curve(fundamentals.market_speed_by_month(m.listings, AS_OF), "date", "market_speed", digits=4, band=False)


@query("smooth_loess_trailing", loess_result(4), SOLD_12MO_SQL + "," + loess_sql("date", "homes_sold", "sold_anchor"))
def smooth_loess_trailing(m):
    """Sales of the twelve months before each anchor date."""
    return curve(fundamentals.sold_at_anchors(m.listings, AS_OF), "date", "homes_sold", digits=4)


def price_series(m):
    """Median sale amount per category and month, written once: every model reads it."""
    return m.once("price-series", lambda: forecast.monthly_median(m.sold, "category", "sale_date", "amount"))


SERIES_SQL = """
se as (select category, cast(date_trunc('month', sale_date) as date) as month,
              median(cast(amount as double)) as value from e where sale_date is not null group by 1, 2),
fu as (select category, month, value from se
       union all
       select category, cast(mx + to_months(cast(k as int)) as date), null
       from (select category, max(month) as mx from se group by 1), (select unnest(range(1, 25)) as k)),
fx as (select *, cast(date_diff('day', date '1970-01-01', month) as double) as x, month(month) as season from fu)
"""


def forecast_rows(df, digits=4):
    return df.select(
        "category", "month", rounded("actual").alias("actual"), rounded("predicted", digits).alias("predicted")
    )


@query(
    "ts_seasonal_lm",
    f"""select category, month, {sql_rounded('value')} as actual,
        {sql_rounded('ym + slope * (x - xm)', 4)} as predicted
        from fx left join (select category, season, avg(x) as xm, avg(value) as ym from fx where value is not null
                           group by 1, 2) using (category, season)
        join (select category, coalesce(sum(sxy) / nullif(sum(sxx), 0), 0) as slope from (
              select category, season, regr_sxy(value, x) as sxy, regr_sxx(value, x) as sxx from fx
              where value is not null group by 1, 2) group by 1) using (category)""",
    SERIES_SQL,
)
def ts_seasonal_lm(m):
    return forecast_rows(forecast.seasonal_trend(price_series(m), "category"))


@query(
    "ts_ar1_forecast",
    f"""select category, month, {sql_rounded('value')} as actual,
        {sql_rounded('''case when month > mx
          then pow(phi, date_diff('month', mx, month)) * lv
               + (vm - phi * bm) * (1 - pow(phi, date_diff('month', mx, month))) / (1 - phi)
          else vm - phi * bm + phi * b end''', 4)} as predicted
        from fx left join (select category, month, lag(value) over (partition by category order by month) as b
                           from se) using (category, month)
        join (select category, regr_slope(value, b) as phi, regr_avgx(value, b) as bm, regr_avgy(value, b) as vm,
                     max_by(value, month) as lv, max(month) as mx
              from (select *, lag(value) over (partition by category order by month) as b from se) group by 1)
          using (category)""",
    SERIES_SQL,
)
def ts_ar1_forecast(m):
    return forecast_rows(forecast.autoregressive(price_series(m), "category"))


def stepwise_sql(source: str, terms: dict[str, str], st: str = "st") -> str:
    """CTEs that regress ``value`` on the terms one by one, each freed of the ones before it.

    The last CTE, ``st``, has a prediction for every row of ``source``, observed or not; those before
    it, ``st`` with the number of terms, have the fits on the first terms alone.
    """
    names = list(terms)
    columns = ", ".join(f"cast({sql} as double) as {name}" for name, sql in terms.items())
    steps = [f"{st}0 as (select category, month, value, value as res, 0e0 as predicted, {columns} from {source})"]
    for k, q in enumerate(names):

        def share(of: str) -> str:
            sums = f"sum({of} * {q}) filter (where value is not null) over (partition by category)"
            norm = f"sum({q} * {q}) filter (where value is not null) over (partition by category)"
            return f"coalesce({sums} / case when {norm} > 1e-9 then {norm} end, 0) * {q}"

        rest = "".join(f", {name} - {share(name)} as {name}" for name in names[k + 1 :])
        steps.append(
            f"{st}{k + 1} as (select category, month, value, res - {share('res')} as res,"
            f" predicted + {share('res')} as predicted{rest} from {st}{k})"
        )
    return ",\n".join(steps) + f",\n{st} as (select * from {st}{len(names)})"


TIME_SQL = """
tx as (select fx.*, date_diff('day', first, month) / cast(nullif(date_diff('day', first, last), 0) as double) as t
       from fx join (select category, min(month) as first, max(month) as last from se group by 1) using (category)),
kn as (select category, quantile_cont(t, 0.25) as k0, quantile_cont(t, 0.5) as k1, quantile_cont(t, 0.75) as k2
       from tx where value is not null group by 1),
tk as (select tx.*, k0, k1, k2 from tx join kn using (category))
"""
WAVES = {
    f"{wave}{k}": f"{wave}(2 * pi() * season * {k} / 12)" for k in (1, 2, 3) for wave in ("sin", "cos")
}
BENDS = {f"bend{i}": f"greatest(t - k{i}, 0)" for i in range(3)}
LEVELS = {f"month{k}": f"case when season = {k} then 1 else 0 end" for k in range(2, 13)}
STEPWISE_RESULT = f"""select category, month, {sql_rounded('value')} as actual,
  {sql_rounded('predicted', 3)} as predicted from st"""


CATEGORICAL_TERMS = {
    "(Intercept)": "1",
    "sale_day": "sale_day",
    **{f"category={c}": f"case when cat = '{c}' then 1 else 0 end" for c in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
    **{f"area=NATION_{k}": f"case when area = 'NATION_{k}' then 1 else 0 end" for k in range(1, 25)},
}
# Besides the sales, one row per term with a 1 in it and no value: its prediction is the coefficient.
CATEGORICAL_SQL = (
    """
ca as (
  select 'all' as category, null as month, cast(amount as double) as value, category as cat, area,
         cast(date_diff('day', date '1970-01-01', sale_date) as double) as sale_day
  from e where sale_date is not null and area in
    (select area from e where sale_date is not null group by 1 having count(*) >= 12)
  union all
  select 'all', term, null, null, null, null from (select unnest(["""
    + ", ".join(f"'{t}'" for t in CATEGORICAL_TERMS)
    + """]) as term)),
"""
    + stepwise_sql(
        "ca",
        {
            f"c{i}": f"case when month is null then {sql} when month = '{term}' then 1 else 0 end"
            for i, (term, sql) in enumerate(CATEGORICAL_TERMS.items())
        },
    )
)


@query(
    "reg_categorical_area",
    f"select month as term, {sql_rounded('predicted', 2)} as estimate from st where month is not null",
    CATEGORICAL_SQL,
)
def reg_categorical_area(m):
    rows = frequent_groups(m.sold, "area", 12).select(
        F.col("amount").cast("double").alias("amount"), "category", "area",
        F.unix_date("sale_date").cast("double").alias("sale_day"),
    )
    coefficients = forecast.categorical_ols(rows, "amount", ["sale_day"], ["category", "area"])
    return coefficients.withColumn("estimate", rounded("estimate", 2))


# The street is swept out by its means; what the other terms leave of a street's mean is its effect.
STREET_TERMS = {"sale_day": "sale_day", **{f"category={c}": c for c in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}}
STREET_SQL = (
    STREETS_SQL
    + f""",
ra as (
  select street, cast(amount as double) as value, cast(date_diff('day', date '1970-01-01', sale_date) as double) as sale_day,
         {', '.join(f"case when category = '{c}' then 1e0 else 0e0 end as {c}" for c in list(STREET_TERMS.values())[1:])}
  from st where sale_date is not null and street in (select street from st group by 1 having count(*) >= 12)),
rm as (select street, avg(value) as value, {', '.join(f'avg({c}) as {c}' for c in STREET_TERMS.values())} from ra group by 1),
rd as (
  select 'all' as category, null as month, ra.value - rm.value as value, {', '.join(f'ra.{c} - rm.{c} as {c}' for c in STREET_TERMS.values())}
  from ra join rm using (street)
  union all
  select 'all', term, null, {', '.join(f"case when term = '{t}' then 1 else 0 end" for t in STREET_TERMS)}
  from (select unnest([{', '.join(f"'{t}'" for t in STREET_TERMS)}]) as term)),
"""
    + stepwise_sql("rd", {f"c{i}": c for i, c in enumerate(STREET_TERMS.values())}, "rs")
    + f""",
rc as (select month as term, predicted as estimate from rs where month is not null),
re as (select street, value - ({' + '.join(f"{c} * (select estimate from rc where term = '{t}')" for t, c in STREET_TERMS.items())}) as effect from rm)
"""
)


@query(
    "reg_categorical",
    f"""select term, {sql_rounded('estimate', 2)} as estimate from rc
        union all select '(Intercept)', {sql_rounded('effect', 2)} from re where street = (select min(street) from re)
        union all select 'street=' || street, {sql_rounded('effect - (select arg_min(effect, street) from re)', 2)} from re
        where street > (select min(street) from re)""",
    STREET_SQL,
)
def reg_categorical(m):
    """Amount on sale date, category and street, over streets with a dozen listings or more."""
    rows = frequent_groups(streets(m), "street", 12).filter(F.col("sale_date").isNotNull()).select(
        F.col("amount").cast("double").alias("amount"), "category", "street",
        F.unix_date("sale_date").cast("double").alias("sale_day"),
    )
    coefficients = forecast.categorical_ols(rows, "amount", ["sale_day"], ["category", "street"])
    return coefficients.withColumn("estimate", rounded("estimate", 2))


@query(
    "ts_fourier_trend",
    STEPWISE_RESULT,
    SERIES_SQL + "," + TIME_SQL + "," + stepwise_sql("tk", {"one": "1", "tt": "t", **WAVES}),
)
def ts_fourier_trend(m):
    return forecast_rows(forecast.fourier_trend(price_series(m), "category"), digits=3)


@query(
    "ts_hinge_regression",
    STEPWISE_RESULT,
    SERIES_SQL + "," + TIME_SQL + "," + stepwise_sql("tk", {"one": "1", "tt": "t", **BENDS, **LEVELS}),
)
def ts_hinge_regression(m):
    return forecast_rows(forecast.hinge_trend(price_series(m), "category"), digits=3)
