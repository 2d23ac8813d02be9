"""Least squares with factors of any number of levels.

One factor is absorbed: its effects follow from the others, so that only the equations of the other
terms are left. Those are kept as rows, one per pair of terms that meet in a row of the data and one
per term and absorbed level, and solved by conjugate gradients: a step is two joins of these rows
with the current direction and two grouped sums. Labels, counts and effects stay in tables; the
driver only sees the two numbers of each step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marketspark.sources.snapshot import materialize

EXACT = 1e-24  # squared residual, relative to the first one, at which the steps end
MOST_STEPS = 1000
NOTHING = 1e-10  # a term keeps less than this share of its square beside the absorbed factor


def absorbed_ols(df: DataFrame, y: str, numbers: Sequence[str], factors: Sequence[str], absorb: str) -> DataFrame:
    """(term, estimate): intercept, ``numbers`` and the levels of ``factors`` and ``absorb`` against each one's first.

    Rows with a null are left out. Levels are compared as text; the first is the least one. A level
    that does not vary within any level of ``absorb`` has no estimate, and differences between levels
    that no chain of rows connects are not determined.
    """
    spark = df.sparkSession
    columns = [F.col(y).cast("double").alias("y"), F.col(absorb).cast("string").alias("s")]
    columns += [F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(numbers)]
    columns += [F.col(c).cast("string").alias(f"f{k}") for k, c in enumerate(factors)]
    rows = df.select(columns).dropna()
    moments = rows.agg(F.avg("y").alias("y"), *[F.struct(F.avg(f"x{k}").alias("m"), F.stddev_pop(f"x{k}").alias("sd")).alias(f"x{k}") for k in range(len(numbers))]).first()
    if moments.y is None:
        return spark.createDataFrame([], "term string, estimate double")
    sds = [moments[f"x{k}"].sd or 1.0 for k in range(len(numbers))]
    z = [(F.col(f"x{k}") - moments[f"x{k}"].m) / sd for k, sd in enumerate(sds)]
    value = F.col("y") - moments.y
    cells = materialize(
        rows.groupBy("s", *[f"f{k}" for k in range(len(factors))]).agg(
            F.count("*").cast("double").alias("n"),
            F.sum(value).alias("v"),
            *[F.sum(c).alias(f"z{k}") for k, c in enumerate(z)],
            *[F.sum(c * value).alias(f"zv{k}") for k, c in enumerate(z)],
            *[F.sum(z[j] * z[k]).alias(f"z{j}_{k}") for j in range(len(z)) for k in range(j, len(z))],
        ),
        "absorbed-cells",
    )

    def term(k: int, level: Column) -> Column:
        return F.struct(F.lit(k).alias("of"), level.alias("level"))

    # Terms of a cell: its level of each factor, then the numbers, each with what it adds up to there.
    terms = [(term(k, F.col(f"f{k}")), F.col("n"), F.col("v")) for k in range(len(factors))]
    terms += [(term(-1 - k, F.lit("")), F.col(f"z{k}"), F.col(f"zv{k}")) for k in range(len(numbers))]

    def product(i: int, j: int) -> Column:
        i, j = sorted((i, j))
        if j < len(factors):
            return F.col("n")
        return F.col(f"z{j - len(factors)}") if i < len(factors) else F.col(f"z{i - len(factors)}_{j - len(factors)}")

    pairs = F.array(*[F.struct(terms[i][0].alias("i"), terms[j][0].alias("j"), product(i, j).alias("w")) for i in range(len(terms)) for j in range(len(terms))])
    plain = materialize(cells.select(F.inline(pairs)).groupBy("i", "j").agg(F.sum("w").alias("w")), "absorbed-products")
    sums = F.array(*[F.struct(t.alias("i"), w.alias("w"), v.alias("v")) for t, w, v in terms])
    by_level = cells.select("s", F.inline(sums)).groupBy("s", "i").agg(F.sum("w").alias("w"), F.sum("v").alias("v"))
    size = cells.groupBy("s").agg(F.sum("n").alias("n"), F.sum("v").alias("sv"))
    beside = materialize(by_level.join(size, "s"), "absorbed-levels")
    left = beside.groupBy("i").agg((F.sum("v") - F.sum(F.col("w") * F.col("sv") / F.col("n"))).alias("b"), F.sum(F.col("w") * F.col("w") / F.col("n")).alias("taken"))
    square = plain.filter("i = j").select("i", F.col("w").alias("own"))
    kept = left.join(square, "i").withColumn("m", F.col("own") - F.col("taken")).filter(F.col("m") > NOTHING * F.col("own"))
    state = materialize(kept.select("i", "m", F.lit(0.0).alias("x"), F.col("b").alias("r"), (F.col("b") / F.col("m")).alias("p")), "absorbed-state")
    solved = _solve(state, plain, beside)

    effects = (
        beside.join(solved, "i", "left").groupBy("s").agg(((F.first("sv") - F.sum(F.col("w") * F.coalesce("x", F.lit(0.0)))) / F.first("n")).alias("x"))
    )
    found = solved.filter("i.of >= 0").select(F.col("i.of").alias("of"), F.col("i.level").alias("level"), "x").union(effects.select(F.lit(len(factors)), "s", "x"))
    base = found.groupBy("of").agg(F.min("level").alias("level"), F.min_by("x", "level").alias("base"))
    names = F.array(*[F.lit(c) for c in (*factors, absorb)])
    contrasts = found.join(base.select("of", F.col("level").alias("first"), "base"), "of").filter("level <> first").select(
        F.concat(F.get(names, F.col("of")), F.lit("="), "level").alias("term"), (F.col("x") - F.col("base")).alias("estimate")
    )
    absent = square.join(solved, "i", "left_anti").filter("i.of >= 0").select(F.concat(F.get(names, F.col("i.of")), F.lit("="), "i.level").alias("term"), F.lit(None).cast("double").alias("estimate"))
    slopes = F.create_map(*[c for k, name in enumerate(numbers) for c in (F.lit(-1 - k), F.struct(F.lit(name).alias("term"), F.lit(sds[k]).alias("sd"), F.lit(float(moments[f"x{k}"].m)).alias("m")))]) if numbers else None
    result = contrasts.union(absent)
    shift = F.lit(0.0)
    if numbers:
        own = solved.filter("i.of < 0").withColumn("unit", F.element_at(slopes, F.col("i.of")))
        scaled = own.select(F.col("unit.term").alias("term"), (F.col("x") / F.col("unit.sd")).alias("estimate"), F.col("unit.m").alias("m"))
        result = result.union(scaled.select("term", "estimate"))
        shift = scaled.agg(F.coalesce(F.sum(F.col("estimate") * F.col("m")), F.lit(0.0)).alias("shift")).scalar()
    intercept = base.agg((F.lit(float(moments.y)) + F.sum("base")).alias("at_mean"))
    return result.union(intercept.select(F.lit("(Intercept)"), F.col("at_mean") - shift))


def _solve(state: DataFrame, plain: DataFrame, beside: DataFrame) -> DataFrame:
    """Conjugate gradients with the diagonal as scale: (i, x) of the equations beside the absorbed factor.

    The equations have a solution even where they are not independent, and steps from zero reach one.
    """
    rz = first = state.agg(F.sum(F.col("r") * F.col("r") / F.col("m"))).first()[0] or 0.0
    for _ in range(MOST_STEPS):
        if rz <= EXACT * first:
            return state.select("i", "x")
        direction = state.select(F.col("i").alias("j"), "p")
        through = plain.join(direction, "j").groupBy("i").agg(F.sum(F.col("w") * F.col("p")).alias("q"))
        means = beside.join(direction, beside.i == direction.j).groupBy("s").agg((F.sum(F.col("w") * F.col("p")) / F.first("n")).alias("t"))
        removed = beside.join(means, "s").groupBy("i").agg(F.sum(F.col("w") * F.col("t")).alias("taken"))
        moved = materialize(
            state.join(through, "i").join(removed, "i").select("i", "m", "x", "r", "p", (F.col("q") - F.col("taken")).alias("q")), "absorbed-step"
        )
        step = rz / moved.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        ahead = moved.select("i", "m", (F.col("x") + step * F.col("p")).alias("x"), (F.col("r") - step * F.col("q")).alias("r"), "p")
        after = ahead.agg(F.sum(F.col("r") * F.col("r") / F.col("m"))).first()[0]
        state = materialize(ahead.withColumn("p", F.col("r") / F.col("m") + (after / rz) * F.col("p")), "absorbed-state")
        rz = after
    raise RuntimeError("the equations were not solved")
