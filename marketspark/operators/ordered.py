"""Order-dependent operators that never put a whole group into one task.

A plain window over a year, a category or the whole table sorts all of its rows in one task. Here
the order is cut into slices first. A slice boundary is an approximate quantile of the tie-breaking
id, so whatever the day or group, one (group, day, slice) holds about 1/slices of the table at most;
how good the quantiles are only affects balance, never the result. Sums per slice are combined
map-side, carried forward over the small table of slices, and added to the window inside the slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SKETCHES = 64


def slice_count(df: DataFrame, slices: int | None = None) -> int:
    """Requested slices, or the session's shuffle width, as a power of two."""
    wanted = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(0, wanted - 1).bit_length()


def order_slices(
    df: DataFrame,
    column: str,
    slices: int | None = None,
    name: str = "order_slice",
    sample: Column | None = None,
) -> DataFrame:
    """Number rows by which quantile slice of ``column`` they fall in, preserving its order.

    A binary search over the quantiles, one projection per step, stays inside generated code. The
    quantiles are those of ``sample`` if given: any expression of ``df`` in the same unit. They are
    taken in two steps: rows are sketched in SKETCHES groups by hash, and what one task merges in the
    end is a table of SKETCHES times the slices, whatever the number of input splits.
    """
    count = slice_count(df, slices)
    if count == 1:
        return df.withColumn(name, F.lit(0))
    steps = [F.lit(i / count) for i in range(1, count)]
    sketches = (
        df.select(
            F.pmod(F.xxhash64(column), F.lit(SKETCHES)).alias("sketch"),
            (F.col(column) if sample is None else sample).alias("value"),
        )
        .groupBy("sketch")
        .agg(F.percentile_approx("value", F.array(*steps), 10 * count).alias("parts"))
        .select(F.explode("parts").alias("value"))
    )
    bounds = sketches.agg(F.percentile_approx("value", F.array(*steps), 10 * count).alias("slice_bounds"))
    df = df.crossJoin(F.broadcast(bounds)).withColumn(name, F.lit(0))  # one row of `count` numbers
    step = count // 2
    while step:
        bound = F.get("slice_bounds", F.col(name) + (step - 1))
        df = df.withColumn(name, F.col(name) + F.when(bound < F.col(column), step).otherwise(0))
        step //= 2
    return df.drop("slice_bounds")


def running_sums(
    df: DataFrame,
    sums: dict[str, Column],
    *,
    days: Sequence[str],
    tie: str,
    within: Sequence[str] = (),
    groups: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Inclusive running sums in the order ``days``, ``tie``, ``within`` inside each group.

    ``days`` are columns of few distinct values (calendar days, an event kind); ``tie`` is a numeric
    id. Groups and days must not be null: a null date has no place in the order.
    """
    groups, days = list(groups), list(days)
    cell = groups + days + ["order_slice"]
    addends = {f"{name}__add": expr for name, expr in sums.items()}
    sliced = order_slices(df.withColumns(addends), tie, slices)

    per_slice = sliced.groupBy(*cell).agg(*[F.sum(a).alias(a) for a in addends])
    per_day = per_slice.groupBy(*groups, *days).agg(*[F.sum(a).alias(a) for a in addends])
    before = (Window.unboundedPreceding, -1)
    # One row per calendar day (and event kind) of a group.
    day_window = Window.partitionBy(*groups).orderBy(*days).rowsBetween(*before)
    slice_window = Window.partitionBy(*groups, *days).orderBy("order_slice").rowsBetween(*before)
    day_base = per_day.select(
        *groups, *days, *[F.sum(a).over(day_window).alias(f"{a}_days") for a in addends]
    )
    base = per_slice.join(day_base, groups + days).select(
        *cell,
        *[
            (
                F.coalesce(F.col(f"{a}_days"), F.lit(0))
                + F.coalesce(F.sum(a).over(slice_window), F.lit(0))
            ).alias(f"{a}_base")
            for a in addends
        ],
    )
    row_window = (
        Window.partitionBy(*cell)
        .orderBy(tie, *within)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = [
        (F.col(f"{name}__add_base") + F.coalesce(F.sum(f"{name}__add").over(row_window), F.lit(0)))
        .alias(name)
        for name in sums
    ]
    kept = [c for c in df.columns if c not in sums]
    # Without the explicit repartition a window may keep a coarser partitioning of its input, such
    # as by group alone, and so bring a large group back into one task.
    return sliced.repartition(*cell).join(base, cell).select(*kept, *running)


def running_count(df: DataFrame, name: str, **order) -> DataFrame:
    """Running row number inside each group; see :func:`running_sums` for the order."""
    return running_sums(df, {name: F.lit(1).cast("long")}, **order)


def null_poisoned_sum(
    df: DataFrame, name: str, value: str, also: dict[str, Column] | None = None, **order
) -> DataFrame:
    """Running sum that stays null from the first null value on; ``also`` are ordinary sums."""
    nulls = F.when(F.col(value).isNull(), 1).otherwise(0).cast("long")
    sums = {name: F.coalesce(F.col(value), F.lit(0)), "nulls_so_far": nulls, **(also or {})}
    return (
        running_sums(df, sums, **order)
        .withColumn(name, F.when(F.col("nulls_so_far") == 0, F.col(name)))
        .drop("nulls_so_far")
    )


def trailing_rows(
    df: DataFrame,
    aggregates: dict[str, Column],
    *,
    rows: int,
    day: str,
    tie: str,
    chunk: int = 65536,
    slices: int | None = None,
) -> DataFrame:
    """Aggregates over the last ``rows`` rows of the whole table in (``day``, ``tie``) order.

    The first ``rows - 1`` rows have no full window and stay null. The table is cut into chunks by
    global row number and each chunk also receives the last rows of the one before it, so every
    window is computed inside a chunk of known size. A chunk is never shorter than the window.
    """
    chunk = max(chunk, rows - 1)
    numbered = running_count(df, "row_no", days=[day], tie=tie, slices=slices)
    own = F.floor((F.col("row_no") - 1) / chunk)
    overlaps = ((F.col("row_no") - 1) % chunk) >= chunk - (rows - 1)
    copies = F.when(overlaps, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("own_chunk", own).withColumn("chunk", F.explode(copies))
    window = Window.partitionBy("chunk").orderBy("row_no").rowsBetween(-(rows - 1), 0)
    return (
        spread.withColumns(
            {
                name: F.when(F.col("row_no") >= rows, expr.over(window))
                for name, expr in aggregates.items()
            }
        )
        .filter(F.col("chunk") == F.col("own_chunk"))
        .drop("chunk", "own_chunk", "row_no")
    )


def previous_value(
    df: DataFrame,
    name: str,
    value: str,
    *,
    key: str,
    day: str,
    tie: str,
    hot_rows: int = 1_000_000,
    slices: int | None = None,
    repeated_only: bool = False,
) -> DataFrame:
    """``lag(value)`` per key in (``day``, ``tie``) order, with over-full keys cut into pieces.

    Keys of more than ``hot_rows`` rows (at most rows / ``hot_rows`` of them) are split by day and
    id slice. Only the last value of each piece crosses to the next one. ``repeated_only`` drops
    the rows of keys that occur once; it needs no join, as the window sees the neighbours of a row.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    hot = sizes.filter(F.col("n") > hot_rows).select(key, F.lit(True).alias("is_hot"))
    # At most rows / hot_rows keys.
    sliced = order_slices(df, tie, slices).join(F.broadcast(hot), key, "left")
    no_day = F.to_date(F.lit("1970-01-01"))
    pieces = sliced.withColumns(
        {
            "piece_day": F.when(F.col("is_hot"), F.col(day)).otherwise(no_day),
            "piece_slice": F.when(F.col("is_hot"), F.col("order_slice")).otherwise(0),
        }
    ).drop("order_slice")
    piece = [key, "piece_day", "piece_slice"]
    lasts = (
        pieces.filter("is_hot")
        .groupBy(*piece)
        .agg(F.max_by(F.struct(value), F.struct(day, tie)).alias("last"))
    )
    in_order = Window.partitionBy(key).orderBy("piece_day", "piece_slice")
    carried = lasts.select(*piece, F.lag("last").over(in_order)[value].alias("carried"))
    window = Window.partitionBy(*piece).orderBy(day, tie)
    first = F.row_number().over(window) == 1
    lagged = (
        pieces.repartition(*piece)  # not by key alone: see running_sums
        .join(carried.hint("shuffle_hash"), piece, "left")
        .withColumn(name, F.when(first, F.col("carried")).otherwise(F.lag(value).over(window)))
    )
    if repeated_only:
        # A whole key is one piece unless it is over-full: it repeats if a row has a neighbour.
        follower = F.lead(F.lit(True)).over(window).isNotNull()
        over_full = F.coalesce(F.col("is_hot"), F.lit(False))
        lagged = lagged.withColumn("repeats", over_full | ~first | follower).filter("repeats")
    return lagged.drop("carried", "is_hot", "piece_day", "piece_slice", "repeats")


def dense_ranks(df: DataFrame, column: str, name: str, slices: int | None = None) -> DataFrame:
    """``dense_rank`` of a numeric column over the whole table; null counts as the least value.

    Distinct values are ranked inside slices of the value range, and each slice starts after the
    values of those before it, which are a prefix sum over one row per slice.
    """
    sliced = order_slices(df.select(F.col(column).alias("ranked")).distinct(), "ranked", slices)
    before = Window.orderBy("order_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    starts = sliced.groupBy("order_slice").agg(F.count("*").alias("n")).select(
        "order_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("order_slice").orderBy(F.col("ranked").asc_nulls_first()))
    places = sliced.join(starts, "order_slice").select("ranked", (F.col("start") + inside).cast("int").alias(name))
    return df.join(places, F.col(column).eqNullSafe(F.col("ranked"))).drop("ranked")


def carry_forward(df: DataFrame, value: str, *, groups: Sequence[str], order: str) -> DataFrame:
    """Last non-null value so far inside a group; for aggregated tables with small groups."""
    window = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(window))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Every row whose key occurs more than once; counts combine map-side, rows are not grouped."""
    return frequent_groups(df, key, 2)


def frequent_groups(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """Rows of groups with at least so many rows."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
    return df.join(sizes, key, "left_semi")
