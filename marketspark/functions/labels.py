"""Labels, bins and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Bin limits and labels of homes per street. The last bin is open upwards, because
# stock grows with the data.
STOCK_BINS = (
    (0, 10, "10 homes or less per street"),
    (10, 20, "11-20 homes per street"),
    (20, None, "over 20 homes per street"),
)


def rank_in(value: Column, order: Sequence[str]) -> Column:
    """Position of ``value`` in a declared order, null if it is not listed."""
    return F.nullif(
        F.array_position(F.array(*[F.lit(v) for v in order]), value).cast("int"), F.lit(0)
    )


def listing_status(sale_date: Column, under_contract: Column) -> Column:
    return (
        F.when(sale_date.isNotNull(), F.lit("Sold"))
        .when(under_contract == 1, F.lit("Under Contract"))
        .otherwise(F.lit("For Sale"))
    )


def street_of(address: Column) -> Column:
    """The address without its house number and the blank after it."""
    return F.regexp_replace(address, "^[0-9]+ ", "")


def street_label(street: Column, abbreviation: Column, unsuffixed: Sequence[str] = ()) -> Column:
    """Street plus category abbreviation, except without one or for the named exceptions."""
    keep = abbreviation.isNull()
    if unsuffixed:
        keep = keep | street.isin(list(unsuffixed))
    return F.when(keep, street).otherwise(F.concat_ws(" ", street, abbreviation))


def bucket_stock(stock: Column) -> Column:
    """Right-closed bins; null for no stock."""
    label = F.lit(None).cast("string")
    for low, high, text in reversed(STOCK_BINS):
        inside = stock > low if high is None else (stock > low) & (stock <= high)
        label = F.when(inside, F.lit(text)).otherwise(label)
    return label


def bucket_turnover(turnover: Column, low: Column, high: Column) -> Column:
    """low / ave / higher / high by two limits, bins right-closed.

    The edges are taken in order, so a negative lower limit swaps places with 0. Otherwise a turnover
    of exactly 0 lies on the outer edge and has no label.
    """
    zero = F.lit(0.0)
    outer, inner = F.least(zero, low), F.greatest(zero, low)
    return (
        F.when((turnover > outer) & (turnover <= inner), F.lit("low"))
        .when((turnover > inner) & (turnover <= high), F.lit("ave"))
        .when((turnover > high) & (turnover <= high * 2), F.lit("higher"))
        .when(turnover > high * 2, F.lit("high"))
    )


def resale_label(address: Column, months: Column) -> Column:
    """``address (months)`` with one decimal, halves rounded to even."""
    return F.concat(address, F.lit(" ("), F.bround(months, 1).cast("string"), F.lit(")"))
