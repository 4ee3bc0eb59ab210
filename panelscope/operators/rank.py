"""National and state positions, rank movement and competitive bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.ratios import cagr, pct
from ..plans.ordering import positions, ranked, top_k
from ..session import write_scratch
from .common import Ids, in_window, latest, only


def rank_trend(inst: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """National rank per entity and year; ranked among all, then restricted."""
    rows = in_window(inst, y0, y1).select("inst_id", "year", "total_rd")
    return only(ranked(rows, "total_rd", ["year"], "national_rank"), ids)


def rank_movement(inst: DataFrame, y0: int, y1: int, ids: Ids = None) -> DataFrame:
    """First against last national rank and money inside the window."""
    trend = rank_trend(inst, y0, y1, ids)
    # whole numbers only, so Spark can aggregate by hash instead of sorting
    ends = trend.groupBy("inst_id").agg(
        F.max_by("national_rank", "year").alias("current_rank"),
        F.min_by("national_rank", "year").alias("start_rank"),
        F.max_by("total_rd", "year").alias("current_rd"),
        F.min_by("total_rd", "year").alias("start_rd"),
    )
    return ends.select(
        "*", (F.col("start_rank") - F.col("current_rank")).alias("rank_change"),
        (F.col("current_rd") - F.col("start_rd")).alias("rd_change"),
    )


def anchor_segments(n: int, anchors: Sequence[int]) -> list[tuple[int, int, int]]:
    """(from_rank, to_rank, shown rank): which ranks a target sees beside its own.

    First, last and the two nearest landmarks on either side, if more than two
    places away. Between two landmarks all targets see the same, so the list is as
    long as the landmarks say, whatever ``n``.
    """
    marks = sorted(set(anchors))
    cuts = sorted({1, *[m + d for m in (1, n, *marks) for d in range(-2, 4)]})
    starts = [c for c in cuts if 1 <= c <= n]
    out = []
    for low, high in zip(starts, [*[c - 1 for c in starts[1:]], n]):
        above = [m for m in marks if low - m > 2][-2:]
        below = [m for m in marks if m - low > 2][:2]
        out += [(low, high, m) for m in sorted({1, n, *above, *below}) if (low, high) != (m, m)]
    return out


def anchor_view(
    inst: DataFrame, year: int, ids: Ids = None, anchors: Sequence[int] = tuple(dims.ANCHOR_RANKS)
) -> DataFrame:
    """Each target among first, last and its nearest landmark ranks.

    A landmark row holds for all targets ranked ``from_rank`` to ``to_rank``: one
    row per segment and entity at the landmark, so all entities tied there are
    listed and ties never turn into pairs. Every target's own row (``is_target``)
    has its rank in both; entities tied with it are the own rows of that rank.
    Landmarks that nobody holds, because a tie skips them, are left out.
    """
    rows = inst.where(F.col("year") == year).select("inst_id", "total_rd")
    table = write_scratch(ranked(rows, "total_rd", [], "national_rank"), "anchor-ranks")
    n = table.count()
    shown = inst.sparkSession.createDataFrame(
        anchor_segments(n, anchors) if n else [], "from_rank long, to_rank long, national_rank long")
    others = table.join(F.broadcast(shown), "national_rank").withColumn("is_target", F.lit(False))
    own = only(table, ids).select("*", F.col("national_rank").alias("from_rank"),
                                  F.col("national_rank").alias("to_rank"), F.lit(True).alias("is_target"))
    return others.unionByName(own).select(
        "from_rank", "to_rank", F.lit(n).cast("long").alias("total_institutions"), "national_rank",
        "inst_id", "total_rd", "is_target")


def state_ranking(inst: DataFrame, y0: int, y1: int) -> DataFrame:
    """Rank within the state, growth, federal share and market share.

    The state is that of the end year, in which an entity must have money.
    """
    now = inst.where((F.col("year") == y1) & (F.col("total_rd") > 0)).select(
        "inst_id", "state", "name", "total_rd", F.col("federal").alias("fed_latest")
    )
    start = inst.where(F.col("year") == y0).select("inst_id", F.col("total_rd").alias("rd_start"))
    # no hint: adaptive execution broadcasts the state totals when it has
    # measured them, and splits a large state's share of the join if not
    totals = now.groupBy("state").agg(F.sum("total_rd").cast("long").alias("state_rd"))
    placed = ranked(now, "total_rd", ["state"], "state_rank")
    return placed.join(start, "inst_id", "left").join(totals, "state").select(
        "state", "inst_id", "name", "total_rd", "state_rank",
        cagr(F.col("rd_start"), F.col("total_rd"), y1 - y0).alias("cagr"),
        pct(F.col("fed_latest"), F.col("total_rd")).alias("federal_pct"),
        pct(F.col("total_rd"), F.col("state_rd")).alias("market_share"),
    )


def rank_band(
    table: DataFrame, rank: str, by: Sequence[str], above: int, below: int
) -> DataFrame:
    """For every rank that occurs, the rows from ``above`` before to ``below`` after.

    Keyed by ``target_rank``, not by entity: all entities tied at a rank see the
    same band, so a tie of n rows adds n rows per neighbouring rank, not n * n.
    """
    by = list(by)
    seen = table.select(*by, F.col(rank).alias("target_rank")).distinct()
    # a row at rank r lies in the band of every rank from r - below to r + above
    offered = table.withColumn(
        "target_rank",
        F.explode(F.sequence(F.greatest(F.col(rank) - below, F.lit(1)), F.col(rank) + above)),
    )
    return offered.join(seen, [*by, "target_rank"], "left_semi")


def state_band(ranking: DataFrame, above: int = 3, below: int = 3) -> DataFrame:
    """The entities around each state rank, three up and three down."""
    return rank_band(ranking, "state_rank", ["state"], above, below).select(
        "state", "target_rank", "state_rank", "inst_id", "name", "total_rd", "cagr", "federal_pct"
    )


def state_leaders(ranking: DataFrame, k: int = 10) -> DataFrame:
    """First k entities of each state."""
    order = [F.col("state_rank"), F.col("inst_id")]
    return top_k(ranking, ["state"], order, k, "place").select(
        "state", "place", "state_rank", "inst_id", "name", "total_rd", "cagr"
    )


def state_positions(inst: DataFrame) -> DataFrame:
    """Gap-free position within the state in the newest year, and its size."""
    now = latest(inst).select("inst_id", "state", F.coalesce("total_rd", F.lit(0)).alias("total_rd"))
    size = now.groupBy("state").agg(F.count(F.lit(1)).alias("state_total"))
    return positions(now, "total_rd", "inst_id", ["state"], "state_position").join(size, "state").select(
        "inst_id", "state", "total_rd", "state_position", "state_total"
    )


def metric_band(
    df: DataFrame, metric: str, above: int = 8, below: int = 7, by: Sequence[str] = ()
) -> DataFrame:
    """Competitive neighbourhood of every rank on any positive metric.

    ``is_selected`` marks the rows at the rank the band was drawn for.
    """
    by = list(by)
    known = df.where(F.col(metric) > 0)
    table = write_scratch(ranked(known, metric, by, "metric_rank"), "metric-ranks")
    band = rank_band(table, "metric_rank", by, above, below)
    if by:
        size = known.groupBy(*by).agg(F.count(F.lit(1)).alias("total_institutions"))
        band = band.join(size, by)
    else:
        band = band.withColumn("total_institutions", known.agg(F.count(F.lit(1))).scalar())
    return band.withColumn(
        "is_selected", F.when(F.col("metric_rank") == F.col("target_rank"), 1).otherwise(0)
    )
