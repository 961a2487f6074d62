"""Exact money: decimals with two places, and restatement by a price index in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from girderlake.functions.text import first_of

#: Road construction price index by year, in tenths (2015 = 1000).
PRICE_INDEX = {
    2005: 784, 2006: 801, 2007: 843, 2008: 890, 2009: 896, 2010: 905, 2011: 932, 2012: 958, 2013: 971, 2014: 983, 2015: 1000,
    2016: 1019, 2017: 1056, 2018: 1108, 2019: 1162, 2020: 1194, 2021: 1283, 2022: 1487, 2023: 1625, 2024: 1689, 2025: 1726,
}
FIRST, LAST = min(PRICE_INDEX), max(PRICE_INDEX)


def index_of(year: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in PRICE_INDEX.items() for v in pair])
    return F.try_element_at(table, year.cast("int"))


def restated(amount: Column, source_year: Column, as_of_year: Column) -> tuple[Column, Column]:
    """M2: the amount at another year's prices, half up to the cent, and whether a year lies outside the index.

    Both years are first moved into the index's range; null if the source is then not earlier (trap T11).
    """
    a, b = (F.least(F.greatest(y, F.lit(FIRST)), F.lit(LAST)) for y in (source_year, as_of_year))
    cents = (amount * 100).cast("decimal(24,0)")
    source, target = index_of(a).cast("long"), index_of(b).cast("long")
    whole = F.call_function("div", cents * target.cast("decimal(6,0)") + F.call_function("div", source, F.lit(2)), source)
    earlier = a < b
    return F.when(earlier, (whole.cast("decimal(24,0)") / 100).cast("decimal(16,2)")), F.when(earlier, (a != source_year) | (b != as_of_year))


def both_or_null(amount: Column, tag: Column) -> Column:
    """A pair that is null unless both are set."""
    return F.when(amount.isNotNull() & tag.isNotNull(), F.struct(amount.alias("amount"), tag.alias("currency")))


def effective_estimate(managed: Column, sourced: Column) -> tuple[Column, Column]:
    """The manager's estimate before the source document's, and which it is."""
    return F.coalesce(managed, sourced), first_of((managed.isNotNull(), "MANAGERIAL"), (sourced.isNotNull(), "SOURCE_DOCUMENT"))
