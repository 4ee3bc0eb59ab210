"""Guarded ratios and growth rates; every percentage in the library is made here.

Spark raises on division by zero and SQL engines differ on powers of negative
bases, so the guards live in one place: null whenever a ratio has no meaning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, null for a zero or null denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def pct(num: Column, den: Column, places: int = 1) -> Column:
    """num as a percentage of den, rounded half away from zero."""
    return F.round(raw_pct(num, den), places)


def raw_pct(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double") * F.lit(100.0), den.cast("double"))


def cagr(start: Column, end: Column, years: Column | int, places: int = 1) -> Column:
    """Compound annual growth in percent.

    Null unless start > 0, end >= 0 and years > 0, so neither 0/0 nor an even
    root of a negative number is ever evaluated.
    """
    n = F.lit(years) if isinstance(years, int) else years
    growth = F.pow(ratio(end, start), F.try_divide(F.lit(1.0), n.cast("double")))
    ok = (start > 0) & (end >= 0) & (n > 0)
    return F.when(ok, F.round((growth - 1) * 100, places))


def tenths(num: Column, den: Column) -> Column:
    """``pct`` with one decimal, as a whole number of tenths.

    Sums of tenths are exact in any order, so a mean of rounded percentages
    does not depend on how rows were spread over tasks.
    """
    return F.round(pct(num, den, 1) * 10).cast("long")


def mean_of_tenths(total: Column, count: Column) -> Column:
    """Mean of ``tenths`` values, as a percentage with one decimal."""
    return F.round(F.try_divide(total.cast("double"), count.cast("double"))) / 10


def mean_2(total: Column, count: Column) -> Column:
    """total / count with two decimals, from whole numbers.

    The hundredths are rounded, so a tie is decided on an exact half.
    """
    return F.round(F.try_divide((total * 100).cast("double"), count.cast("double"))) / 100


def at_year(year: Column, wanted: int, value: Column) -> Column:
    """Aggregate: the value in one year, null if the entity has no such row."""
    return F.max(F.when(year == wanted, value))
