"""Connected components of link tables, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): ``root`` is the least node of the node's component.

    Alternates the two star steps of Kiveris et al. (2014): each node hooks its
    larger, then its smaller neighbours to the least one it knows. Links never
    grow in number, every round is a grouped minimum and a join on the node, and
    the number of rounds is logarithmic. Nodes without links are not returned.
    Null ends and self links are ignored; an empty table gives an empty table.
    """
    known = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    edges = write_scratch(
        known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # now every link points to a smaller node
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        step = (small.select(F.col("b").alias("a"), F.col("m").alias("b"))
                .union(down.select("a", F.col("m").alias("b")))
                .where(F.col("a") != F.col("b")).distinct())
        edges = write_scratch(step, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Has every node one link down, to a node that has none?"""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e")).select("e.*")
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.where("down > 1 or (down = 1 and up = 1)").isEmpty()
