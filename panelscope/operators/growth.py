"""Growth rates, source mix and federal share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims, schema
from ..functions.ratios import at_year, cagr, pct, ratio, raw_pct
from ..plans.ordering import medians
from .common import Ids, endpoints, in_window, only


def cagr_window(inst: DataFrame, y0: int, y1: int, value: str = "total_rd", ids: Ids = None) -> DataFrame:
    """Growth between the two years asked for; null if either is missing."""
    return only(endpoints(inst, y0, y1), ids).groupBy("inst_id").agg(
        at_year(F.col("year"), y0, F.col(value)).alias("start_value"),
        at_year(F.col("year"), y1, F.col(value)).alias("end_value"),
    ).withColumn("cagr", cagr(F.col("start_value"), F.col("end_value"), y1 - y0))


def cagr_available(inst: DataFrame, y0: int, y1: int, value: str = "total_rd", ids: Ids = None) -> DataFrame:
    """Growth between an entity's first and last year inside the window.

    Only entities with at least two years and a positive start are returned.
    """
    ends = only(in_window(inst, y0, y1), ids).groupBy("inst_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by(value, "year").alias("start_value"), F.max_by(value, "year").alias("end_value"),
    )
    span = F.col("last_year") - F.col("first_year")
    return ends.where((span > 0) & (F.col("start_value") > 0)).withColumn(
        "cagr", cagr(F.col("start_value"), F.col("end_value"), span)
    )


def guarded_growth(inst: DataFrame, y0: int, y1: int, floor: int = dims.GROWTH_FLOOR) -> DataFrame:
    """Window growth with both amounts, for starts of at least ``floor`` only."""
    growth = cagr_window(inst, y0, y1).where(F.col("start_value") >= floor)
    return growth.where(F.col("end_value").isNotNull())


def growth_allowed(field_code: Column, y0: int) -> Column:
    """False where a growth rate would start before the sub-field was surveyed."""
    young = field_code.isin(dims.FIELDS_SINCE_2016)
    return ~(young & F.lit(y0 < dims.FIELDS_SINCE_YEAR))


def year_on_year(inst: DataFrame, y0: int, y1: int, value: str = "total_rd", ids: Ids = None) -> DataFrame:
    """Change against the calendar year before, null if that year is missing.

    Each row is offered to its own and the following year, so one aggregation
    on (entity, year) replaces a self-join or a window per entity.
    """
    rows = only(in_window(inst, y0, y1), ids)
    roles = F.array(
        F.struct(F.col("year").alias("at"), F.lit(True).alias("now")),
        F.struct((F.col("year") + 1).alias("at"), F.lit(False).alias("now")),
    )
    both = rows.select("inst_id", F.col(value).alias("v"), F.inline(roles))
    return (
        both.groupBy("inst_id", F.col("at").alias("year"))
        .agg(F.max(F.when(F.col("now"), F.col("v"))).alias("value"),
             F.max(F.when(~F.col("now"), F.col("v"))).alias("previous"),
             F.max("now").alias("present"))
        .where("present")
        .select("inst_id", "year", "value", "previous",
                (F.col("value") - F.col("previous")).alias("change"),
                pct(F.col("value") - F.col("previous"), F.col("previous")).alias("yoy_pct"))
    )


def funding_mix(inst: DataFrame, year: int, ids: Ids = None) -> DataFrame:
    """The six sources of one year, one row each, with their share."""
    rows = only(inst.where(F.col("year") == year), ids)
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("amount")) for s in schema.SOURCES])
    return rows.select("inst_id", "total_rd", F.inline(pairs)).select(
        "inst_id", "source", "amount", pct(F.col("amount"), F.col("total_rd")).alias("share_pct")
    )


def mix_shift(inst: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """How each source's share of the total moved between two years."""
    mixes = only(endpoints(inst, y0, y1), ids)
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("amount")) for s in schema.SOURCES])
    long = mixes.select("inst_id", "year", "total_rd", F.inline(pairs)).withColumn(
        "share", pct(F.col("amount"), F.col("total_rd"))
    )
    return long.groupBy("inst_id", "source").agg(
        at_year(F.col("year"), y0, F.col("share")).alias("start_pct"),
        at_year(F.col("year"), y1, F.col("share")).alias("end_pct"),
    ).withColumn("shift_pp", F.round(F.col("end_pct") - F.col("start_pct"), 1))


def federal_share_trend(inst: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    return only(in_window(inst, y0, y1), ids).select(
        "inst_id", "year", pct(F.col("federal"), F.col("total_rd")).alias("federal_pct")
    )


def national_median_share(inst: DataFrame, y0: int, y1: int) -> DataFrame:
    """Exact median federal share per year over entities with money."""
    shares = in_window(inst, y0, y1).where(F.col("total_rd") > 0).select(
        "year", raw_pct(F.col("federal"), F.col("total_rd")).alias("share")
    )
    return medians(shares, "share", ["year"], "m").select("year", F.round("m", 1).alias("median_pct"))


def agency_change(agencies: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """Money per agency in two years; a missing year counts as 0."""
    rows = only(endpoints(agencies, y0, y1), ids).groupBy("inst_id", "agency_code", "agency_name").agg(
        F.coalesce(at_year(F.col("year"), y0, F.col("amount")), F.lit(0)).alias("funding_start"),
        F.coalesce(at_year(F.col("year"), y1, F.col("amount")), F.lit(0)).alias("funding_end"),
    )
    change = F.col("funding_end") - F.col("funding_start")
    return rows.select(
        "*", change.alias("change"),
        F.when(F.col("funding_start") > 0,
               F.round((ratio(F.col("funding_end"), F.col("funding_start")) - 1) * 100, 1))
        .alias("pct_change"),
    )


def agency_growth(agencies: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """First against last available year per agency, whole percent."""
    ends = only(in_window(agencies, y0, y1), ids).groupBy("inst_id", "agency_code", "agency_name").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("amount", "year").alias("first_amount"), F.max_by("amount", "year").alias("last_amount"),
    )
    positive = (F.col("first_amount") > 0) & (F.col("last_year") > F.col("first_year"))
    return ends.where(positive).withColumn(
        "change_pct", F.round((ratio(F.col("last_amount"), F.col("first_amount")) - 1) * 100, 0)
    )


def growth_label(own: Column, peers: Column, margin: float = 5.0) -> Column:
    """faster / slower / aligned against the peer mean."""
    return (
        F.when(own > peers + margin, "faster").when(own < peers - margin, "slower").otherwise("aligned")
    )
