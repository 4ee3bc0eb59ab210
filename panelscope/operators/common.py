"""Small pieces several operator modules share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ids = DataFrame | Iterable[str] | None


def max_year(inst: DataFrame) -> Column:
    """Newest year of the panel as a scalar subquery (run once per query)."""
    return inst.agg(F.max("year")).scalar()


def latest(inst: DataFrame) -> DataFrame:
    """Rows of the panel's newest year."""
    return inst.where(F.col("year") == max_year(inst))


def in_window(df: DataFrame, y0: int, y1: int) -> DataFrame:
    return df.where(F.col("year").between(y0, y1))


def endpoints(df: DataFrame, y0: int, y1: int) -> DataFrame:
    """Rows of the two end years only; prunes the year partitions between."""
    return df.where(F.col("year").isin(y0, y1))


def only(df: DataFrame, ids: Ids, column: str = "inst_id") -> DataFrame:
    """Keep the chosen entities; all of them for None."""
    if ids is None:
        return df
    if isinstance(ids, DataFrame):
        chosen = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
        return df.join(chosen, column, "left_semi")
    return df.where(F.col(column).isin(list(ids)))
