"""Exact ranks, quantiles and sorted neighbours that do not need one task per group.

A panel has few years and few states, so ``rank() over (partition by year)``
would sort all entities of a year in one task. Three forms avoid that, each the
only one for its operators, at every size:

* Ranks of values: equal values are counted first, and the distinct values of a
  group are cut at approximate quantiles. Counts within a bucket plus the sums of
  the buckets before it are exact, whatever the cuts. Nothing is written.
* Medians: counted histograms of a group are narrowed to the bucket that holds the
  middle, until it is told by the bucket's ends. Nothing is sorted.
* Positions, lags and fill-forward need a unique order of rows: they are sorted by
  Spark's range partitioning and written with the number of their sorted partition
  (a run) and their place in the total order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch

BUCKETS, ACCURACY = 64, 1000  # of the distinct values of a group that are ranked
RANGES, ROUNDS = 4096, 6  # of the histograms that medians are found by

def sorted_runs(df: DataFrame, keys: Sequence[Column], purpose: str = "sorted") -> DataFrame:
    """Store ``df`` in the order of ``keys``, which must be unique per row.

    Adds ``_run``, the number of the sorted partition a row is in, and ``_row``,
    which rises by one from row to row of a run, and from run to run. Being stored,
    both stay the same however often they are read.
    """
    return write_scratch(df.orderBy(*keys).select(
        *df.columns, F.spark_partition_id().cast("long").alias("_run"),
        F.monotonically_increasing_id().alias("_row")), purpose)


def _order(value: str, descending: bool) -> Column:
    return F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)


def _running_counts(df: DataFrame, value: str, by: Sequence[str], descending: bool) -> DataFrame:
    """One row per (group, distinct value): n rows, n before it, distinct before it.

    Null values come first upwards and last downwards.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = counts.groupBy(*by).agg(F.percentile_approx(value, shares, ACCURACY).alias("_cuts"))
    placed = null_safe_join(counts, cuts, by, "inner").select(
        *by, value, "_n", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter(
            F.coalesce("_cuts", F.array()), lambda c: c < F.col(value)))).alias("_bucket"))
    sums = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_sum"), F.count(F.lit(1)).alias("_distinct"))
    # a group has at most BUCKETS + 1 rows here
    earlier = Window.partitionBy(*by).orderBy(
        F.desc("_bucket") if descending else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off_n"),
        F.coalesce(F.sum("_distinct").over(earlier), F.lit(0)).alias("_off_d"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(
        _order(value, descending)).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        *by, value, "_bucket", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_loc_n"),
        F.coalesce(F.count("_n").over(inside), F.lit(0)).alias("_loc_d"))
    return null_safe_join(local, offsets, [*by, "_bucket"], "inner").select(
        *by, value, (F.col("_off_n") + F.col("_loc_n")).alias("_before"),
        (F.col("_off_d") + F.col("_loc_d")).alias("_distinct_before"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left keys.

    Without keys there is one group, of which ``right`` has a row or two.
    """
    if not keys:
        return left.join(F.broadcast(right), how=how)
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def ranked(
    df: DataFrame, value: str, by: Sequence[str] = (), out: str = "rank",
    descending: bool = True,
) -> DataFrame:
    """Append SQL ``rank()`` of ``value`` within ``by`` (nulls ranked as smallest)."""
    table = _running_counts(df, value, by, descending).select(
        *by, value, (F.col("_before") + 1).alias(out)
    )
    # A value shared by many rows is one row of ``table``; adaptive execution
    # splits that key's share of ``df`` if it outgrows its neighbours.
    return null_safe_join(df, table, [*by, value], "inner")


def positions(
    df: DataFrame, value: str, key: str, by: Sequence[str] = (), out: str = "position",
) -> DataFrame:
    """Append a gap-free position by ``value`` descending, ties by the unique ``key``."""
    by = list(by)
    stored = sorted_runs(df, [*[F.col(c) for c in by], F.desc_nulls_last(value), F.col(key)], "positions")
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    # rows of a group are neighbours in a run, so a place is an offset from the first
    offsets = stored.groupBy(*by, "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first")
    ).select(*by, "_run", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    return null_safe_join(stored, offsets, [*by, "_run"], "inner").withColumn(
        out, F.col("_off") + F.col("_row")
    ).select(*df.columns, out)


def previous_values(
    df: DataFrame, value: str, by: Sequence[str], order: Sequence[str], out: str = "previous",
) -> DataFrame:
    """Append ``lag(value)`` within ``by``; ``order`` must be unique in a group.

    The first row of a group's run takes the last value of the group's run
    before it.
    """
    by, order = list(by), list(order)
    stored = sorted_runs(df, [F.col(c) for c in (*by, *order)], "previous")
    inside = Window.partitionBy(*by, "_run").orderBy("_row")
    local = stored.withColumns({"_lag": F.lag(value).over(inside), "_i": F.row_number().over(inside)})
    # a group has at most one row per run here
    ends = stored.groupBy(*by, "_run").agg(F.max_by(F.struct(value), "_row").alias("_end"))
    carried = ends.select(
        *by, "_run", F.lag("_end").over(Window.partitionBy(*by).orderBy("_run")).alias("_carried")
    )
    joined = null_safe_join(local, carried, [*by, "_run"], "inner")
    return joined.withColumn(
        out, F.when(F.col("_i") == 1, F.col("_carried")[value]).otherwise(F.col("_lag"))
    ).select(*df.columns, out)


def following_values(
    df: DataFrame, value: str, by: Sequence[str], order: Sequence[Column], out: str = "following",
) -> DataFrame:
    """Append the last non-null ``value`` so far in ``order`` within ``by``.

    ``order`` must be unique in a group. A run starts with the last value of the
    group's runs before it.
    """
    by = list(by)
    stored = sorted_runs(df, [*[F.col(c) for c in by], *order], "following")
    inside = Window.partitionBy(*by, "_run").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    local = stored.withColumn("_seen", F.last(value, ignorenulls=True).over(inside))
    # a group has at most one row per run here
    ends = stored.groupBy(*by, "_run").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_row"))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_run", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    return null_safe_join(local, carried, [*by, "_run"], "inner").withColumn(
        out, F.coalesce("_seen", "_carried")).select(*df.columns, out)


def medians(df: DataFrame, value: str, by: Sequence[str], out: str = "median") -> DataFrame:
    """Exact interpolated median of the non-null values per group.

    A round counts the values between two bounds of each group in equal ranges and goes
    on with the range that holds the middle, until the middle is the range's least or
    greatest value. Values so close that a range cannot be parted are told apart by
    ``_running_counts``.
    """
    by = list(by)
    known = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    bounds = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)))
    open_ = write_scratch(bounds.select(
        *by, F.explode(middle).alias("_at"), F.lit(0).cast("long").alias("_before"), "_low", "_high"), "median-bounds")
    told = []
    for turn in range(ROUNDS):
        state = write_scratch(_narrowed(known, open_, by), "medians")
        told.append(state.where("_found is not null").select(*by, "_found"))
        open_ = state.where("_found is null").drop("_found", "_count")
        if open_.isEmpty():
            break
    else:
        within = null_safe_join(known, open_, by, "inner").where("_v between _low and _high")
        counts = within.groupBy(*by, "_at", "_before", "_v").agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*by, "_at").orderBy("_v"))
        last = counts.withColumn("_upto", F.col("_before") + upto).where(
            (F.col("_upto") - F.col("_n") <= F.col("_at")) & (F.col("_at") < F.col("_upto")))
        told.append(last.select(*by, F.col("_v").alias("_found")))
    return reduce(DataFrame.union, told).groupBy(*by).agg(
        ((F.min("_found") + F.max("_found")) / 2).alias(out))


def _narrowed(known: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """``open_`` (group, _at, _before, _low, _high) with the range that holds ``_at``, and ``_found`` if that tells it."""
    within = null_safe_join(known, open_, by, "inner")
    # halves, so that no difference overflows; the share rises with the value
    low, high, v = (F.col(c).cast("double") / 2 for c in ("_low", "_high", "_v"))
    share = F.try_divide(v - low, high - low) * RANGES
    cell = F.coalesce(F.least(F.floor(F.when(F.isnan(share), None).otherwise(share)), F.lit(RANGES - 1)), F.lit(RANGES - 1))
    counted = within.where("_v between _low and _high").groupBy(*by, "_at", "_before", cell.alias("_cell")).agg(
        F.count(F.lit(1)).alias("_count"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    # a group has at most RANGES rows here
    earlier = Window.partitionBy(*by, "_at").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_count").over(earlier), F.lit(0)))
    end = F.col("_before") + F.col("_count")
    held = placed.where((F.col("_before") <= F.col("_at")) & (F.col("_at") < end))
    found = F.when((F.col("_at") == F.col("_before")) | (F.col("_low") == F.col("_high")), F.col("_low")).when(
        F.col("_at") == end - 1, F.col("_high"))
    return held.select(*by, "_at", "_before", "_low", "_high", "_count", found.alias("_found"))


def dense_positions(distinct: DataFrame, value: str, out: str = "position") -> DataFrame:
    """Number the rows of a table of distinct values 0, 1, 2, … upwards."""
    table = _running_counts(distinct, value, [], descending=False).select(
        value, F.col("_distinct_before").cast("long").alias(out)
    )
    return null_safe_join(distinct, table, [value], "inner")


def neighbours(
    distinct: DataFrame, position: str, reach: int, item: Column, out: str = "around",
    block: int = 8192,
) -> DataFrame:
    """Collect ``item`` of the rows up to ``reach`` positions before and after.

    Rows are grouped in blocks of consecutive positions; the first and last
    ``reach`` rows of a block are also sent to the block next to it.
    """
    reach = min(reach, block)
    at = F.col(position) % block
    home = F.floor(F.col(position) / block)
    blocks = F.array_compact(F.array(
        home,
        F.when((at < reach) & (home > 0), home - 1),
        F.when(at >= block - reach, home + 1),
    ))
    w = Window.partitionBy("_block").orderBy(position).rowsBetween(-reach, reach)
    spread = distinct.select("*", home.alias("_home"), F.explode(blocks).alias("_block"))
    return (
        spread.withColumn(out, F.collect_list(item).over(w))
        .where(F.col("_block") == F.col("_home")).drop("_block", "_home")
    )


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank"
) -> DataFrame:
    """First k rows per group; Spark keeps k per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
