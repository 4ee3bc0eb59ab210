"""Federal-agency mix, concentration and distinctiveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ratios import pct, ratio, tenths
from .common import Ids, in_window, only
from .portfolio import distinctiveness


def agency_mix(inst: DataFrame, agencies: DataFrame, year: int, ids: Ids = None) -> DataFrame:
    """Amount per agency of one year with its share of all federal money."""
    rows = only(agencies.where(F.col("year") == year), ids)
    federal = inst.where(F.col("year") == year).select("inst_id", "federal")
    return rows.join(federal, "inst_id").select(
        "inst_id", "agency_code", "agency_name", "amount",
        pct(F.col("amount"), F.col("federal")).alias("pct_of_federal"),
    )


def agency_trend(agencies: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    return only(in_window(agencies, y0, y1), ids).select(
        "inst_id", "year", "agency_code", "agency_name", "amount"
    )


def concentration(mix: DataFrame, n_agencies: int = 7) -> DataFrame:
    """HHI, diversification score and top agency per entity.

    Shares are rounded to one decimal before squaring, and squared as whole
    tenths so that the sum does not depend on row order. Null scores for an
    entity without federal money.
    """
    share = F.round(F.col("pct_of_federal") * 10).cast("long")
    sums = mix.groupBy("inst_id").agg(
        F.sum(share * share).alias("squares"),
        F.min_by(F.struct("agency_name", "pct_of_federal"),
                 F.struct((-F.col("amount")).alias("v"), "agency_code")).alias("top"),
    )
    hhi = F.col("squares") / F.lit(1_000_000.0)
    spread = 1.0 - 1.0 / n_agencies
    return sums.select(
        "inst_id", (F.round(F.col("squares") / F.lit(100.0)) / 10_000).alias("hhi"),
        F.round((1.0 - hhi) / spread * 100, 1).alias("diversification_score"),
        F.col("top.agency_name").alias("top_agency"), F.col("top.pct_of_federal").alias("top_agency_pct"),
    )


def top_shares(agencies: DataFrame, year: int) -> DataFrame:
    """Largest agency's share of an entity's agency money, where there is any."""
    sums = agencies.where(F.col("year") == year).groupBy("inst_id").agg(
        F.max("amount").alias("top_amount"), F.sum("amount").cast("long").alias("total_federal"),
        F.count_distinct(F.when(F.col("amount").isNotNull(), F.col("agency_code"))).alias("num_agencies"),
    ).where(F.col("total_federal") > 0)
    return sums.withColumn("top_agency_pct", pct(F.col("top_amount"), F.col("total_federal")))


def concentration_percentile(agencies: DataFrame, year: int) -> DataFrame:
    """Percent of entities whose top-agency share is strictly lower.

    Shares have one decimal, so there are at most 1,001 different ones: the
    running count over that histogram replaces a sort of all entities.
    """
    shares = top_shares(agencies, year).select("inst_id", "top_agency_pct")
    earlier = Window.orderBy("top_agency_pct").rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    steps = (
        shares.groupBy("top_agency_pct").agg(F.count(F.lit(1)).alias("n"))
        .select("top_agency_pct",
                F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lower"),
                F.sum("n").over(everyone).alias("total_institutions"))
    )
    return shares.join(F.broadcast(steps), "top_agency_pct").select(
        "inst_id", "top_agency_pct",
        F.round(ratio(F.col("lower"), F.col("total_institutions")) * 100).cast("int")
        .alias("national_percentile"),
        "total_institutions",
    )


def agency_shares(agencies: DataFrame, year: int) -> DataFrame:
    """Tenths of a percent each agency has in the sum of agencies."""
    rows = agencies.where(F.col("year") == year)
    whole = rows.groupBy("inst_id").agg(F.sum("amount").alias("whole"))
    return rows.join(whole, "inst_id").select(
        "inst_id", "agency_code", tenths(F.col("amount"), F.col("whole")).alias("share")
    )


def agency_distinctiveness(
    agencies: DataFrame, edges: DataFrame, year: int, missing_as_zero: bool = False
) -> DataFrame:
    return distinctiveness(agency_shares(agencies, year), edges, "agency_code", missing_as_zero)
