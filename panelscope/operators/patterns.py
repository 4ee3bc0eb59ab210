"""Comparison questions users ask, as parameterised operators.

Each answers one worked question pattern; where the pattern compares with a
chosen entity, ``target`` is its id and its own values are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import pct
from ..plans.ordering import ranked
from .agency import top_shares
from .common import in_window
from .growth import cagr_window, guarded_growth
from .lookup import latest_names


def _first_n(df: DataFrame, value: str, n: int, out: str, key: str = "inst_id") -> DataFrame:
    """Top n rows with their rank: ranking n rows gives the same rank as ranking all."""
    first = df.orderBy(F.desc_nulls_last(value), key).limit(n)
    return first.withColumn(out, F.rank().over(Window.orderBy(F.desc_nulls_last(value))).cast("long"))


def top_total(inst: DataFrame, year: int, n: int = 10) -> DataFrame:
    rows = inst.where(F.col("year") == year).select("inst_id", "name", "total_rd")
    return _first_n(rows, "total_rd", n, "national_rank")


def faster_in_state(inst: DataFrame, target: str, state: str, y0: int, y1: int) -> DataFrame:
    """Entities of a state that outgrew the target."""
    growth = cagr_window(inst.where(F.col("state") == state), y0, y1).where(
        (F.col("start_value") > 0) & (F.col("end_value") > 0)
    )
    own = growth.where(F.col("inst_id") == target).select(F.max("cagr")).scalar()
    return (
        growth.withColumn("target_cagr", own)
        .where((F.col("cagr") > F.col("target_cagr")) & (F.col("inst_id") != target))
        .join(latest_names(inst), "inst_id")
        .select("inst_id", "name", F.col("start_value").alias("rd_start"),
                F.col("end_value").alias("rd_end"), "cagr", "target_cagr")
    )


def faster_than_each(inst: DataFrame, y0: int, y1: int) -> DataFrame:
    """For every entity, how many of its state outgrew it: the same comparison
    for all targets at once, without listing pairs."""
    home = inst.where(F.col("year") == y1).select("inst_id", "state")
    growth = cagr_window(inst, y0, y1).where(
        (F.col("start_value") > 0) & (F.col("end_value") > 0)
    ).join(home, "inst_id")
    placed = ranked(growth.select("inst_id", "state", "cagr"), "cagr", ["state"], "r")
    return placed.select("inst_id", "state", "cagr", (F.col("r") - 1).alias("n_faster"))


def top_field(
    inst: DataFrame, fields: DataFrame, year: int, field_code: str, n: int | None = 10
) -> DataFrame:
    """Leaders in one field with its share of their portfolio; all for n=None."""
    rows = _field_of(inst, fields, year, field_code).select(
        "inst_id", "name", F.col("total").alias("field_rd"),
        pct(F.col("total"), F.col("total_rd")).alias("pct_of_portfolio"),
    )
    if n is None:
        return ranked(rows, "field_rd", [], "field_rank")
    return _first_n(rows, "field_rd", n, "field_rank")


def _field_of(inst: DataFrame, fields: DataFrame, year: int, field_code: str) -> DataFrame:
    rows = fields.where((F.col("year") == year) & (F.col("field_code") == field_code)).select("inst_id", "total")
    return rows.join(inst.where(F.col("year") == year).select("inst_id", "name", "state", "total_rd"), "inst_id")


def field_in_states(inst: DataFrame, fields: DataFrame, year: int, field_code: str) -> DataFrame:
    """One field ranked inside every state."""
    rows = _field_of(inst, fields, year, field_code).select(
        "inst_id", "state", F.col("total").alias("field_rd"),
        pct(F.col("total"), F.col("total_rd")).alias("pct_of_portfolio"),
    )
    placed = ranked(rows, "field_rd", ["state"], "state_rank")
    return placed.join(latest_names(inst), "inst_id")


def compare_entities(inst: DataFrame, ids: Sequence[str], y0: int, y1: int) -> DataFrame:
    """Totals of a few chosen entities side by side."""
    rows = in_window(inst, y0, y1).where(F.col("inst_id").isin(list(ids)))
    return rows.select("inst_id", "name", "year", "total_rd", "federal")


def _agency_of(inst: DataFrame, agencies: DataFrame, year: int, agency_code: str) -> DataFrame:
    rows = agencies.where((F.col("year") == year) & (F.col("agency_code") == agency_code)).select("inst_id", "amount")
    return rows.join(
        inst.where(F.col("year") == year).select("inst_id", "name", "state", "total_rd", "federal"), "inst_id"
    ).withColumn("pct_of_federal", pct(F.col("amount"), F.col("federal")))


def top_agency(inst: DataFrame, agencies: DataFrame, year: int, agency_code: str, n: int = 10) -> DataFrame:
    rows = _agency_of(inst, agencies, year, agency_code).select("inst_id", "name", "amount", "pct_of_federal")
    return _first_n(rows, "amount", n, "agency_rank")


def agency_share_rank(inst: DataFrame, agencies: DataFrame, year: int) -> DataFrame:
    """Who depends most on each agency: share of federal money, ranked per agency."""
    rows = agencies.where(F.col("year") == year).select("inst_id", "agency_code", "amount").join(
        inst.where(F.col("year") == year).select("inst_id", "federal"), "inst_id"
    )
    shares = rows.select(
        "inst_id", "agency_code", "amount", pct(F.col("amount"), F.col("federal")).alias("pct_of_federal")
    ).where(F.col("pct_of_federal").isNotNull())
    return ranked(shares, "pct_of_federal", ["agency_code"], "share_rank")


def concentration_band(
    inst: DataFrame, agencies: DataFrame, year: int, target: str, margin: float = 5.0
) -> DataFrame:
    """The target and all entities within the margin of its top-agency share.

    The rank is among the band's rows, and no row limit can cut the target.
    """
    shares = top_shares(agencies, year)
    own = shares.where(F.col("inst_id") == target).select(F.max("top_agency_pct")).scalar()
    near = shares.withColumn("own_pct", own).where(
        (F.col("inst_id") == target) | F.col("top_agency_pct").between(F.col("own_pct") - margin, F.col("own_pct") + margin)
    )
    return _with_names(inst, ranked(
        near.select("inst_id", "top_agency_pct", "total_federal", "num_agencies"),
        "top_agency_pct", [], "concentration_rank",
    ))


def concentration_ranks(inst: DataFrame, agencies: DataFrame, year: int) -> DataFrame:
    """Every entity's concentration and its national place."""
    return _with_names(inst, ranked(
        top_shares(agencies, year).select("inst_id", "top_agency_pct", "total_federal", "num_agencies"),
        "top_agency_pct", [], "concentration_rank",
    ))


def _with_names(inst: DataFrame, rows: DataFrame) -> DataFrame:
    """Append the current name, null where the entity has left the panel."""
    return rows.join(latest_names(inst), "inst_id", "left")


def state_totals(inst: DataFrame, year: int, n: int | None = None) -> DataFrame:
    """Money, number of entities and mean per state; the n largest if asked."""
    sums = inst.where(F.col("year") == year).groupBy("state").agg(
        F.sum("total_rd").cast("long").alias("total_state_rd"),
        F.count_distinct("inst_id").alias("num_institutions"),
    ).withColumn("avg_per_institution", F.round(
        F.try_divide(F.col("total_state_rd").cast("double"), F.col("num_institutions").cast("double")), 0
    ))
    return sums if n is None else sums.orderBy(F.desc("total_state_rd"), "state").limit(n)


def more_agency_less_total(
    inst: DataFrame, agencies: DataFrame, year: int, agency_code: str, target: str, state: str
) -> DataFrame:
    """Entities of a state with more of an agency's money but a lower total than the target."""
    rows = _agency_of(inst, agencies, year, agency_code)
    mine = rows.where(F.col("inst_id") == target)
    return (
        rows.where(F.col("state") == state)
        .withColumn("target_total_rd", mine.select(F.max("total_rd")).scalar())
        .withColumn("target_amount", mine.select(F.max("amount")).scalar())
        .where((F.col("amount") > F.col("target_amount")) & (F.col("total_rd") < F.col("target_total_rd")))
        .select("inst_id", "name", "total_rd", "amount", "pct_of_federal", "target_total_rd", "target_amount")
    )


def fastest(inst: DataFrame, y0: int, y1: int, n: int = 10) -> DataFrame:
    """Fastest growing entities with at least the floor amount at the start."""
    return _first_n(guarded_growth(inst, y0, y1), "cagr", n, "growth_rank")

