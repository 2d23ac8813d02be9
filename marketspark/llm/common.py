"""Pieces the document operators share.

Null text counts as empty text everywhere in this package. Only the columns an operator names are
read; stages that return the columns of their input give their own working columns fresh names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketspark.sources.snapshot import materialize

SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(column: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(column, SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    The optimizer may copy a projected expression into each place that names it, also into lambdas
    that run per element; a lambda's variable is never copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; root is the least node it can reach.

    Large-star and small-star steps in turn: each is one grouped shuffle, edges never grow in number,
    and the rounds grow with the logarithm of the longest chain. Each round is written to the shared
    folder, so a lost executor does not re-run the rounds before it. A node with very many
    neighbours only takes part in a ``min``, which combines before the shuffle.
    """
    edges = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-edges",
    )
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        new = materialize(small, f"{name}-edges")
        changed = new.exceptAll(edges).limit(1).count() + edges.exceptAll(new).limit(1).count()
        edges = new
        if not changed:
            break
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return materialize(roots.union(own.join(roots, "node", "left_anti")), name)
