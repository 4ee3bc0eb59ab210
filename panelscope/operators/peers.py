"""Peer sets as edge tables, and what is computed on them.

Every peer set is a table ``(target_id, peer_id, …)``; the operators below the
edge builders do not care where the edges come from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.ratios import mean_2, mean_of_tenths
from ..plans.ordering import dense_positions, neighbours, top_k
from ..session import write_scratch
from .common import in_window
from .growth import cagr_available, cagr_window
from .lookup import eligible_entities, latest_names

# --- edge builders ------------------------------------------------------------


def state_edges(wide_edges: DataFrame, features: DataFrame, k: int = 10) -> DataFrame:
    """From the national neighbours (100 by default) the first k in the same state."""
    home = features.select("inst_id", "state")
    near = (
        wide_edges.join(home.select(F.col("inst_id").alias("target_id"), F.col("state").alias("own")), "target_id")
        .join(home.select(F.col("inst_id").alias("peer_id"), "state"), "peer_id")
        .where(F.col("own") == F.col("state"))
    )
    # at most as many rows per target as the wide edge table has
    return top_k(near.withColumnRenamed("rank", "national_order"), ["target_id"],
                 [F.col("national_order")], k).select("target_id", "peer_id", "rank", "distance")


def parity_edges(inst: DataFrame, year: int, tolerance: float = 0.2, k: int = 8) -> DataFrame:
    """The k entities closest in total among those within the tolerance.

    Closeness has one dimension, so the k nearest of a total are among the k
    distinct totals on either side of it in sorted order, and among equal
    totals only the k + 1 smallest ids can be chosen. Ties go to smaller ids.
    """
    start = inst.where(F.col("year") == year).select("inst_id", "total_rd").where(
        F.col("total_rd").isNotNull()
    )
    totals = (
        top_k(start, ["total_rd"], [F.col("inst_id")], k + 1, "i")
        .groupBy("total_rd").agg(F.sort_array(F.collect_list("inst_id")).alias("ids"))
    )
    around = neighbours(dense_positions(totals, "total_rd"), "position", k, F.struct("total_rd", "ids"))
    base = F.col("total_rd")
    low, high = base * (1 - tolerance), base * (1 + tolerance)
    within = F.filter("around", lambda n: n["total_rd"].between(low, high))
    offers = F.flatten(F.transform(within, lambda n: F.transform(
        n["ids"], lambda i: F.struct(F.abs(n["total_rd"] - base).alias("gap"), i.alias("peer_id"))
    )))
    best = around.select("total_rd", F.slice(F.sort_array(offers), 1, k + 1).alias("near"))
    others = F.filter("near", lambda e: e["peer_id"] != F.col("inst_id"))
    return start.join(best, "total_rd").select(
        F.col("inst_id").alias("target_id"), F.posexplode(F.slice(others, 1, k)).alias("i", "e")
    ).select("target_id", F.col("e.peer_id").alias("peer_id"), (F.col("i") + 1).alias("rank"),
             F.col("e.gap").cast("double").alias("distance"))


def custom_edges(preferences: DataFrame, inst: DataFrame) -> DataFrame:
    """Users' own peer lists as edges ``(user_id, target_id, peer_id)``.

    Names count only if they are on the picker's list; a target is no peer of
    itself.
    """
    by_name = eligible_entities(inst).select("name", "inst_id")
    current = latest_names(inst)
    named = (
        preferences.join(current.withColumnRenamed("inst_id", "target_id"),
                         F.col("institution") == F.col("name"))
        .select("user_id", "target_id", F.explode("custom_peers").alias("peer_name"))
    )
    return (
        named.join(by_name, F.col("peer_name") == F.col("name"))
        .where(F.col("inst_id") != F.col("target_id"))
        .select("user_id", "target_id", F.col("inst_id").alias("peer_id")).distinct()
    )


def effective_edges(preferences: DataFrame, inst: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Own list where it names anyone, the benchmark peers otherwise."""
    preferences = write_scratch(preferences, "preferences")  # read twice
    own = write_scratch(custom_edges(preferences, inst), "own-peers")
    asked = preferences.join(latest_names(inst), F.col("institution") == F.col("name")).select(
        "user_id", F.col("inst_id").alias("target_id")
    ).distinct()
    without = asked.join(own.select("user_id", "target_id").distinct(), ["user_id", "target_id"], "left_anti")
    fallback = without.join(benchmark.select("target_id", "peer_id"), "target_id")
    return own.withColumn("peer_mode", F.lit("custom")).unionByName(
        fallback.select("user_id", "target_id", "peer_id", F.lit("benchmark").alias("peer_mode"))
    )


# --- gaps, trends and growth --------------------------------------------------


def peer_gap(
    features: DataFrame, edges: DataFrame, metrics: Sequence[str] = tuple(schema.METRICS)
) -> DataFrame:
    """Own value, peer mean and signed gap per metric.

    Peers without a feature row do not count; a target without any is absent.
    """
    sums = (
        edges.join(features.select(F.col("inst_id").alias("peer_id"), *metrics), "peer_id")
        .groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"sum_{m}") for m in metrics])
    )
    own = features.select(F.col("inst_id").alias("target_id"), *metrics)
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("mine"), F.col(f"sum_{m}").alias("whole"))
        for m in metrics
    ])
    return own.join(sums, "target_id").select("target_id", "n", F.inline(pairs)).select(
        "target_id", "metric", F.col("mine").cast("double").alias("my_val"),
        mean_2(F.col("whole"), F.col("n")).alias("peer_avg"),
        mean_2(F.col("mine") * F.col("n") - F.col("whole"), F.col("n")).alias("gap"),
    )


def peer_trend(inst: DataFrame, edges: DataFrame, y0: int, y1: int) -> DataFrame:
    """Yearly totals of each target and its peers under their current names."""
    group = edges.select("target_id", "peer_id").unionByName(
        edges.select("target_id", F.col("target_id").alias("peer_id")).distinct()
    )
    names = latest_names(inst).withColumnRenamed("name", "current_name")
    rows = in_window(inst, y0, y1).join(names, "inst_id", "left").select(
        F.col("inst_id").alias("peer_id"), "year", "total_rd",
        F.coalesce("current_name", "name").alias("name"),
    )
    return group.join(rows, "peer_id").select(
        "target_id", F.col("peer_id").alias("inst_id"), "name", "year", "total_rd",
        (F.col("peer_id") == F.col("target_id")).alias("is_target"),
    )


def _compare(edges: DataFrame, own: DataFrame, rates: DataFrame) -> DataFrame:
    """Count, sum (whole tenths) and number of faster peers per target."""
    pairs = (
        edges.select("target_id", "peer_id")
        .join(rates.select(F.col("inst_id").alias("peer_id"), F.col("cagr").alias("peer_cagr")), "peer_id", "left")
        .join(own, "target_id", "left")
    )
    tenths = F.round(F.col("peer_cagr") * 10).cast("long")
    return pairs.groupBy("target_id").agg(
        F.max("own_cagr").alias("own_cagr"),  # the same for every peer of a target
        F.count(F.lit(1)).alias("n_peers"), F.count("peer_cagr").alias("n_rates"),
        F.sum(tenths).alias("tenths"), F.count_if(F.col("peer_cagr") > F.col("own_cagr")).alias("faster"),
    )


def peer_growth(inst: DataFrame, edges: DataFrame, y0: int, y1: int, ranked: bool = True) -> DataFrame:
    """Growth over available years against the peers' mean, and the place in the group.

    ``ranked=False`` leaves the place null, for hand-picked peer sets.
    """
    rates = cagr_available(inst, y0, y1).select("inst_id", "cagr")
    own = rates.select(F.col("inst_id").alias("target_id"), F.col("cagr").alias("known_cagr"))
    targets = edges.select("target_id").distinct().join(own, "target_id", "left").select(
        "target_id", F.coalesce("known_cagr", F.lit(0.0)).alias("own_cagr"),
        F.col("known_cagr").isNotNull().cast("long").alias("own_known"),
    )
    sums = _compare(edges, targets.select("target_id", "own_cagr"), rates)
    place = (F.col("faster") + 1).cast("int") if ranked else F.lit(None).cast("int")
    return sums.join(targets.select("target_id", "own_known"), "target_id").select(
        "target_id", F.col("own_cagr").alias("target_cagr"),
        F.coalesce(mean_of_tenths(F.col("tenths"), F.col("n_rates")), F.lit(0.0)).alias("peer_avg_cagr"),
        place.alias("growth_rank"), (F.col("n_rates") + F.col("own_known")).alias("total_in_group"),
    )


def parity_growth(inst: DataFrame, edges: DataFrame, y0: int, y1: int) -> DataFrame:
    """Growth over the exact window against size-parity peers."""
    rates = cagr_window(inst, y0, y1).select("inst_id", "cagr")
    own = rates.select(F.col("inst_id").alias("target_id"), F.col("cagr").alias("own_cagr"))
    return _compare(edges, own, rates).select(
        "target_id", F.col("own_cagr").alias("target_growth"),
        mean_of_tenths(F.col("tenths"), F.col("n_rates")).alias("peer_avg"),
        (F.col("faster") + 1).cast("int").alias("growth_rank"),
        (F.col("n_peers") + 1).alias("total_peers"),
    )


def parity_trend(inst: DataFrame, edges: DataFrame, y0: int, y1: int) -> DataFrame:
    """Yearly totals of each target and its size-parity peers."""
    return peer_trend(inst, edges, y0, y1).drop("name")


def peer_band(trend: DataFrame) -> DataFrame:
    """Mean, lowest and highest peer total per target and year."""
    return trend.where(~F.col("is_target")).groupBy("target_id", "year").agg(
        mean_2(F.sum("total_rd"), F.count("total_rd")).alias("peer_mean"), F.min("total_rd").alias("peer_min"),
        F.max("total_rd").alias("peer_max"),
    )


# --- landing message ----------------------------------------------------------


def landing_signal(movement: DataFrame, growth: DataFrame, callouts: DataFrame) -> DataFrame:
    """The one message worth showing first, as a code with its numbers.

    In order: an extreme growth place among peers, a growth gap of two points,
    a national move of ten ranks, the largest field. Null if none applies.
    """
    all_known = (
        movement.select("inst_id", "rank_change", "current_rank")
        .join(growth.withColumnRenamed("target_id", "inst_id"), "inst_id", "left")
        .join(callouts.select("inst_id", "top_field", "top_field_pct"), "inst_id", "left")
    )
    gap = F.round(F.col("target_cagr") - F.col("peer_avg_cagr"), 1)
    has_place = (F.coalesce("growth_rank", F.lit(0)) > 0) & (F.coalesce("total_in_group", F.lit(0)) > 0)

    def signal(code: str, value: Column, of: Column) -> Column:
        return F.struct(F.lit(code).alias("signal"), value.cast("double").alias("value"),
                        of.cast("double").alias("reference"))

    place, size = F.col("growth_rank"), F.col("total_in_group")
    growth_signal = F.when(has_place, (
        F.when(place <= 3, signal("growth_leader", place, size))
        .when(place > size - 3, signal("growth_laggard", place, size))
        .when(gap >= 2, signal("growth_faster", gap, F.col("peer_avg_cagr")))
        .when(gap <= -2, signal("growth_slower", F.abs(gap), F.col("peer_avg_cagr")))
    ))
    move = F.col("rank_change")
    rank_signal = (
        F.when(move >= 10, signal("rank_rose", move, F.col("current_rank")))
        .when(move <= -10, signal("rank_fell", F.abs(move), F.col("current_rank")))
    )
    field_signal = F.when(
        (F.length("top_field") > 0) & (F.col("top_field_pct") != 0),
        signal("largest_field", F.col("top_field_pct"), F.lit(None)),
    )
    chosen = F.coalesce(growth_signal, rank_signal, field_signal)
    return all_known.select("inst_id", chosen.alias("s"), "top_field").select(
        "inst_id", F.col("s.signal").alias("signal"), F.col("s.value").alias("value"),
        F.col("s.reference").alias("reference"),
        F.when(F.col("s.signal") == "largest_field", F.col("top_field")).alias("field"),
    )
