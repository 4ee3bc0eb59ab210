"""Column helpers for names, labels and money as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def source_column(label: Column) -> Column:
    """Standardise a printed funding-source label to a column name; letters of any alphabet stay."""
    words = F.regexp_replace(stripped(F.lower(label)), r"(?U)[^\w\s]", "")
    name = F.regexp_replace(words, r"(?U)\s+", "_")
    return F.coalesce(dims.lookup(dims.SOURCE_RENAMES, name), name)


def article_first(name: Column) -> Column:
    """'Ohio State University, The' -> 'The Ohio State University'."""
    tail = r"(?iU),\s*The\s*$"  # fixed pattern
    moved = F.concat(F.lit("The "), stripped(F.regexp_replace(name, tail, "")))
    return F.when(name.rlike(tail), moved).otherwise(name)


def slug(name: Column) -> Column:
    """Text before the first comma, blanks as underscores."""
    return F.replace(stripped(F.split_part(name, F.lit(","), F.lit(1))), F.lit(" "), F.lit("_"))


def short_dollars(amount: Column) -> Column:
    """$1.23B, $4.5M or $999.

    ``format_number`` rounds the stored binary value, as C and Python do;
    ``format_string`` would round its printed form, and 4.35 up.
    """
    x = amount.cast("double")

    def part(value: Column, places: int) -> Column:
        return F.replace(F.format_number(value, places), F.lit(","), F.lit(""))

    return (
        F.when(x >= 1e9, F.concat(F.lit("$"), part(x / 1e9, 2), F.lit("B")))
        .when(x >= 1e6, F.concat(F.lit("$"), part(x / 1e6, 1), F.lit("M")))
        .otherwise(F.concat(F.lit("$"), F.format_number(x, 0)))
    )


def full_dollars(amount: Column) -> Column:
    """$1,234,567 with the fraction cut off; an em dash for null and NaN."""
    x = amount.cast("double")
    whole = F.format_number(F.when(~F.isnan(x), x).cast("long"), 0)
    return F.coalesce(F.concat(F.lit("$"), whole), F.lit("—"))


def discipline(field_name: Column, parent_name: Column) -> Column:
    """Sub-field label without its parent's stem, first letter capital only."""
    stem = F.concat(F.split_part(parent_name, F.lit(","), F.lit(1)), F.lit(", "))
    bare = F.replace(field_name, stem, F.lit(""))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substr(bare, F.lit(2))))


def without_all(label: Column) -> Column:
    """'Engineering, all' -> 'Engineering'."""
    return F.replace(label, F.lit(", all"), F.lit(""))


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: does it hold at most one distinct non-null value?

    One pass of min and max, which combine on the map side whatever the number
    of distinct values.
    """
    aggs = reduce(
        lambda acc, c: acc + [F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}")], columns, []
    )
    checks = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.coalesce(F.col(f"lo_{c}") == F.col(f"hi_{c}"), F.lit(True)).alias("is_constant"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*checks)))
