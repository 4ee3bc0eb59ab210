"""Research-field portfolios: shares, drill-down, momentum, distinctiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ratios import at_year, cagr, mean_of_tenths, pct, tenths
from .common import Ids, endpoints, only
from .growth import growth_allowed


def _parents(fields: DataFrame) -> DataFrame:
    return fields.where(F.col("is_parent") == 1)


def _totals(inst: DataFrame, year: int) -> DataFrame:
    return inst.where(F.col("year") == year).select("inst_id", "total_rd")


def field_portfolio(inst: DataFrame, fields: DataFrame, year: int, ids: Ids = None) -> DataFrame:
    """Parent fields of one year with their share of the total."""
    rows = only(_parents(fields).where(F.col("year") == year), ids)
    return rows.join(_totals(inst, year), "inst_id").select(
        "inst_id", "field_code", "field_name", "federal", "nonfederal", "total",
        pct(F.col("total"), F.col("total_rd")).alias("portfolio_share"),
        pct(F.col("federal"), F.col("total")).alias("federal_pct"),
    )


def field_drilldown(fields: DataFrame, year: int, ids: Ids = None) -> DataFrame:
    """Sub-fields with their share of the parent and a readable label.

    The parent row is found by a window over (entity, parent field), a group of
    at most one taxonomy branch, so both levels share one shuffle.
    """
    rows = only(fields.where(F.col("year") == year), ids)
    branch = Window.partitionBy("inst_id", "parent_field")
    is_parent = F.col("is_parent") == 1
    both = rows.select(
        "*",
        F.max(F.when(is_parent, F.col("total"))).over(branch).alias("parent_total"),
        F.max(F.when(is_parent, F.col("field_name"))).over(branch).alias("parent_name"),
    )
    return both.where(F.col("is_parent") == 0).select(
        "inst_id", "parent_field", "field_code", "field_name",
        text.discipline(F.col("field_name"), F.col("parent_name")).alias("discipline"),
        "federal", "nonfederal", "total",
        pct(F.col("federal"), F.col("total")).alias("federal_pct"),
        pct(F.col("total"), F.col("parent_total")).alias("share_of_parent"),
    )


def parents_with_subfields(fields: DataFrame, year: int) -> DataFrame:
    """Parent rows of entities that report sub-fields under them."""
    rows = fields.where(F.col("year") == year)
    below = rows.where(F.col("is_parent") == 0).select("inst_id", F.col("parent_field").alias("field_code"))
    return _parents(rows).join(below, ["inst_id", "field_code"], "left_semi").select(
        "inst_id", "field_code", "field_name", "total"
    )


def field_momentum(inst: DataFrame, fields: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """Share of portfolio in the end year and growth over the window."""
    parents = only(_parents(fields), ids)
    now = parents.where(F.col("year") == y1).select("inst_id", "field_code", "field_name", "total")
    start = parents.where(F.col("year") == y0).select("inst_id", "field_code", F.col("total").alias("rd_start"))
    rate = F.when(F.col("total") > 0, cagr(F.col("rd_start"), F.col("total"), y1 - y0))
    growth = now.join(start, ["inst_id", "field_code"], "left")
    return growth.join(_totals(inst, y1), "inst_id").select(
        "inst_id", "field_code", "field_name", "total",
        pct(F.col("total"), F.col("total_rd")).alias("portfolio_share"), rate.alias("cagr"),
    )


def momentum_quadrants(momentum: DataFrame, smallest_bubble: int = 100_000) -> DataFrame:
    """Split each entity's growing fields at its median share and median growth.

    Medians are per entity, over at most as many rows as there are parent fields.
    """
    known = momentum.where(F.col("cagr").isNotNull())
    mid = known.groupBy("inst_id").agg(
        F.median("portfolio_share").alias("mid_share"), F.median("cagr").alias("mid_cagr")
    )
    big, fast = F.col("portfolio_share") >= F.col("mid_share"), F.col("cagr") >= F.col("mid_cagr")
    name = (
        F.when(big & fast, "Core Strengths").when(~big & fast, "Emerging")
        .when(big & ~fast, "Established Base").otherwise("Smaller Base")
    )
    return known.join(mid, "inst_id").select(
        "inst_id", "field_code", "portfolio_share", "cagr", "mid_share", "mid_cagr",
        name.alias("quadrant"), F.greatest("total", F.lit(smallest_bubble)).alias("bubble"),
    )


def field_highlights(momentum: DataFrame, portfolio: DataFrame) -> DataFrame:
    """Fastest and largest growing field and the most federal one per entity."""
    known = momentum.where(F.col("cagr").isNotNull())

    def best(value: str) -> Column:
        # smallest code wins a tie
        return F.min_by("field_code", F.struct((-F.col(value)).alias("v"), "field_code"))

    grown = known.groupBy("inst_id").agg(
        best("cagr").alias("fastest_field"), F.max("cagr").alias("fastest_cagr"),
        best("total").alias("largest_field"),
        F.min_by("portfolio_share", F.struct((-F.col("total")).alias("v"), "field_code"))
        .alias("largest_share"),
    )
    funded = portfolio.where(F.col("federal_pct").isNotNull()).groupBy("inst_id").agg(
        best("federal_pct").alias("most_federal_field"), F.max("federal_pct").alias("most_federal_pct")
    )
    return grown.join(funded, "inst_id", "full")


def subfield_growth(fields: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """Growth of sub-fields that had money at both ends of the window."""
    rows = only(endpoints(fields.where(F.col("is_parent") == 0), y0, y1), ids)
    ends = rows.groupBy("inst_id", "field_code", "field_name", "parent_field").agg(
        at_year(F.col("year"), y0, F.col("total")).alias("rd_start"),
        at_year(F.col("year"), y1, F.col("total")).alias("rd_end"),
    ).where((F.col("rd_start") > 0) & (F.col("rd_end") > 0) & growth_allowed(F.col("field_code"), y0))
    return ends.select(
        "*", (F.col("rd_end") - F.col("rd_start")).alias("absolute_change"),
        cagr(F.col("rd_start"), F.col("rd_end"), y1 - y0).alias("cagr"),
    )


def distinctiveness(
    shares: DataFrame, edges: DataFrame, code: str, missing_as_zero: bool = False
) -> DataFrame:
    """Own share minus mean peer share per code, from ``(inst_id, code, share)``.

    ``share`` is in whole tenths of a percent. A peer without the code does not
    enter the mean unless ``missing_as_zero``; codes only one side has are kept
    with 0 for the other.
    """
    own = shares.select(F.col("inst_id").alias("target_id"), code, F.col("share").alias("own"))
    reached = (
        edges.select("target_id", F.col("peer_id").alias("inst_id")).join(shares, "inst_id")
        .groupBy("target_id", code)
        .agg(F.sum("share").alias("peer_sum"), F.count("share").alias("n"))
    )
    if missing_as_zero:
        size = edges.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))
        reached = reached.drop("n").join(size, "target_id")
    mean = reached.select("target_id", code, mean_of_tenths(F.col("peer_sum"), F.col("n")).alias("mean"))
    targets = shares.select(F.col("inst_id").alias("target_id")).distinct()
    both = own.join(mean, ["target_id", code], "full").join(targets, "target_id", "left_semi")
    return both.select(
        "target_id", code,
        (F.coalesce("own", F.lit(0)) / 10).alias("your_pct"),
        F.coalesce("mean", F.lit(0.0)).alias("peer_avg_pct"),
        F.round(F.coalesce("own", F.lit(0)) / 10 - F.coalesce("mean", F.lit(0.0)), 1).alias("difference"),
    )


def field_shares(fields: DataFrame, year: int) -> DataFrame:
    """Tenths of a percent each parent field has in the sum of parent fields."""
    rows = _parents(fields).where(F.col("year") == year)
    whole = rows.groupBy("inst_id").agg(F.sum("total").alias("whole"))
    return rows.join(whole, "inst_id").select(
        "inst_id", "field_code", tenths(F.col("total"), F.col("whole")).alias("share")
    )


def field_distinctiveness(
    fields: DataFrame, edges: DataFrame, year: int, missing_as_zero: bool = False
) -> DataFrame:
    return distinctiveness(field_shares(fields, year), edges, "field_code", missing_as_zero)


def callouts(portfolio: DataFrame, mix: DataFrame) -> DataFrame:
    """Largest field and largest agency per entity with their shares."""
    top_field = portfolio.groupBy("inst_id").agg(
        F.min_by(F.struct("field_name", "portfolio_share"),
                 F.struct((-F.col("total")).alias("v"), "field_code")).alias("f")
    )
    top_agency = mix.groupBy("inst_id").agg(
        F.min_by(F.struct("agency_name", "pct_of_federal"),
                 F.struct((-F.col("amount")).alias("v"), "agency_code")).alias("a")
    )
    return top_field.join(top_agency, "inst_id", "full").select(
        "inst_id", text.without_all(F.col("f.field_name")).alias("top_field"),
        F.col("f.portfolio_share").alias("top_field_pct"),
        F.col("a.agency_name").alias("top_agency"), F.col("a.pct_of_federal").alias("top_agency_pct"),
    )


def labelled(fields: DataFrame, labels: DataFrame) -> DataFrame:
    """Short display label per field code, the full name where there is none."""
    return fields.join(labels, "field_code", "left").withColumn(
        "label", F.coalesce("label", "field_name")
    )
