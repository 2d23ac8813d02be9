"""Mix sources to target weights by repeating whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from marketspark.llm.common import fresh, text_of, words
from marketspark.sources.snapshot import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, size)`` rows.

    Rows are summed per source before the shuffle; what the ranking then sees is one row per source.
    Sources are weighed in code-point order, null last, by ``weights`` in turn. Excess over ``most``
    times a source is shared again by weight: the sources fill like vessels up to one level, so the
    level is found on the sources in order of their cap per weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    # From the first source that the level fits on, later levels only fall.
    fits = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole)
    target = F.least(F.col("cap"), F.coalesce(fits * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    )


def copies(doc_id, rate):
    """floor(rate), and one more with the probability of the fraction, drawn from the md5 of the id."""
    draw = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mixing_plan(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, source_size, target, n_copies)``, one row per row of ``docs``.

    Null and empty texts have size 0; null sources form one source; repeated rows draw alike, being
    equal in id. The text is read once and never shuffled.
    """
    sizes = materialize(docs.select("doc_id", "source", F.size(words(text_of())).cast("long").alias("size")), "mix-sizes")
    by = materialize(targets(sizes), "mix-targets").withColumnRenamed("source", "of_source")
    return sizes.join(by, sizes["source"].eqNullSafe(by["of_source"])).select(
        "doc_id", "source", "size", "source_size", "target", copies(F.col("doc_id"), F.col("rate")).alias("n_copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and ``copy_no`` from 0, in place of a column of that name."""
    sizes = docs.select("source", F.size(words(text_of())).cast("long").alias("size"))
    of, rate, number = (fresh(docs, name) for name in ("of_source", "of_rate", "copy"))
    by = materialize(targets(sizes), "mix-targets").select(F.col("source").alias(of), F.col("rate").alias(rate))
    taken = docs.join(by, docs["source"].eqNullSafe(by[of])).withColumn(rate, copies(docs["doc_id"], F.col(rate))).where(F.col(rate) > 0)
    copied = taken.withColumn(number, F.explode(F.sequence(F.lit(0).cast("long"), F.col(rate) - 1)))
    return copied.select(*[docs[c] for c in docs.columns if c.lower() != "copy_no"], F.col(number).alias("copy_no"))


def query(docs: DataFrame) -> DataFrame:
    return mixing_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
p as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, [3.0,1.0,2.0][((row_number() over (order by source nulls last) - 1) % 3) + 1]::double as weight,
             source_size * 2.0::double as cap from p),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
      from w window b as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, source_size, least(cap, coalesce(max(case when level <= cap / weight then level end) over () * weight, cap)) as target from l),
r as (select *, case when source_size > 0 then least(2.0::double, target / source_size) else 0 end as rate from t)
select d.doc_id, d.size, r.source_size, r.target,
       cast(d.size * (floor(rate) + case when ('0x' || substr(md5(coalesce(cast(doc_id as varchar),'')),1,12))::bigint::double / 281474976710656.0::double < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from d join r on d.source is not distinct from r.source
"""
