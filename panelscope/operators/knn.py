"""Exact k nearest neighbours for every entity at once.

Distances between all pairs grow with the square of the panel, so vectors are
placed in the leaves of a shallow tree whose cuts come from a small sample.
A first pass inside each leaf gives every vector a radius that surely holds k
neighbours; a second pass visits only the leaves whose bounding box comes
within that radius. Nothing outside can be nearer, so the result is exact.

Entities with equal vectors are one vector. Ties in distance go to the smaller
id, so of each set of equal vectors only the k + 1 smallest ids can ever be a
neighbour; the rest take part as targets only.

Spark places, shuffles and merges; numpy computes the distances of one block
of vectors to another, both of bounded size.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..plans.ordering import top_k
from ..session import write_scratch
from .common import latest

LEAF_SIZE = 1024
VISITORS = 65_536
PAIRS = 1 << 19  # of visitors and neighbours that one task holds of a block
SLICE_ROWS = 512
MIN_DEPTH, MAX_DEPTH = 3, 16
SAMPLE_ROWS = 100_000


def feature_rows(inst: DataFrame, metrics: Sequence[str] = tuple(schema.METRICS)) -> DataFrame:
    """Newest row per entity; all-null rows dropped, other nulls read as 0."""
    cols = list(metrics)
    return (
        latest(inst).select("inst_id", "name", "state", *cols)
        .na.drop(how="all", subset=cols).na.fill(0, subset=cols)
    )


def scales(features: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each metric's log1p."""
    logs = features.select(*[F.log1p(F.col(m)).alias(m) for m in metrics])
    return logs.agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics], *[F.stddev_pop(m).alias(f"sd_{m}") for m in metrics])


def scaled(metrics: Sequence[str], stats) -> Column:
    """log1p of each metric by the given scales, as an array. A metric without variance is only centred."""
    out = []
    for m in metrics:
        sd = stats[f"sd_{m}"]
        out.append((F.log1p(F.col(m)) - stats[f"mean_{m}"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0)))
    return F.array(*out)


def standardised(features: DataFrame, metrics: Sequence[str]) -> Column:
    """log1p of each metric, zero mean and unit population variance, as an array."""
    stats = scales(features, metrics)
    return scaled(metrics, stats.select(F.struct(*stats.columns)).scalar())


def _vectors(features: DataFrame, metrics: Sequence[str], k: int) -> DataFrame:
    """Distinct vectors with their k + 1 smallest ids; ``rep`` is the first."""
    cols = list(metrics)
    first = top_k(features.select("inst_id", *cols), cols, [F.col("inst_id")], k + 1, "i")
    grouped = first.groupBy(*cols).agg(F.sort_array(F.collect_list("inst_id")).alias("ids"))
    return grouped.select(
        *cols, F.element_at("ids", 1).alias("rep"), "ids", standardised(features, cols).alias("z")
    )


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, dims))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for axis in range(a.shape[1]):
        step = a[:, axis, None] - b[None, :, axis]
        total += step * step
    return np.sqrt(total)


class Tree:
    """Axis cuts of a complete binary tree, its leaf boxes and their blocks.

    Sent to tasks with the functions that use it; of bounded size, as the depth is.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(2**depth - 1, dtype=int)
        self.cut = np.zeros(2**depth - 1)
        parts = [sample]
        for node in range(2**depth - 1):
            part = parts[node]
            if len(part):
                self.axis[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.cut[node] = np.median(part[:, self.axis[node]])
            right = part[:, self.axis[node]] > self.cut[node]
            parts += [part[~right], part[right]]

    def leaf(self, z: np.ndarray) -> np.ndarray:
        node = np.zeros(len(z), dtype=int)
        rows = np.arange(len(z))
        for _ in range(self.depth):
            node = 2 * node + 1 + (z[rows, self.axis[node]] > self.cut[node])
        return node - (2**self.depth - 1)

    def set_leaves(self, leaves: pd.DataFrame, dims: int, block_rows: int) -> None:
        """Boxes and sizes as measured on the whole data, rolled up the tree."""
        first, count = 2**self.depth - 1, 2 ** (self.depth + 1) - 1
        self.low, self.high = np.full((count, dims), np.inf), np.full((count, dims), -np.inf)
        rows = np.zeros(2**self.depth, dtype=int)
        if len(leaves):
            at = leaves["leaf"].to_numpy()
            self.low[first + at] = leaves[[f"lo{i}" for i in range(dims)]].to_numpy()
            self.high[first + at] = leaves[[f"hi{i}" for i in range(dims)]].to_numpy()
            rows[at] = leaves["n"].to_numpy()
        for node in range(first - 1, -1, -1):
            kids = [2 * node + 1, 2 * node + 2]
            self.low[node] = self.low[kids].min(axis=0)
            self.high[node] = self.high[kids].max(axis=0)
        # a leaf that stayed large is cut into several blocks by hash
        self.blocks = -(-rows // block_rows)
        self.first_block = np.cumsum(self.blocks) - self.blocks

    def visits(self, z: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) pairs of all blocks a row's radius may reach into."""
        reach = radius * (1 + 1e-9) + 1e-9
        row, node = np.arange(len(z)), np.zeros(len(z), dtype=int)
        for level in range(self.depth + 1):
            gap = np.maximum(np.maximum(self.low[node] - z[row], z[row] - self.high[node]), 0.0)
            near = np.sqrt((gap * gap).sum(axis=1)) <= reach[row]
            row, node = row[near], node[near]
            if level < self.depth:
                row, node = np.repeat(row, 2), np.column_stack([2 * node + 1, 2 * node + 2]).ravel()
        leaf = node - (2**self.depth - 1)
        many = self.blocks[leaf]
        ends = np.cumsum(many)
        inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - many, many)
        return np.repeat(row, many), np.repeat(self.first_block[leaf], many) + inner


def _radius(z: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Distance within which each row of a block has k other ids; inf if too few."""
    radius = np.empty(len(z))
    keep = min(k + 1, len(z))
    for start in range(0, len(z), SLICE_ROWS):
        own = np.arange(start, min(start + SLICE_ROWS, len(z)))[:, None]
        d = _distances(z[own[:, 0]], z)
        near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        dist = np.take_along_axis(d, near, axis=1)
        order = np.argsort(dist, axis=1)
        near, dist = np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)
        enough = np.cumsum(copies[near] - (near == own), axis=1) >= k
        reached = dist[np.arange(len(own)), enough.argmax(axis=1)]
        radius[own[:, 0]] = np.where(enough.any(axis=1), reached, np.inf)
    return radius


def _nearest(targets: pd.DataFrame, block: pd.DataFrame, k: int, dims: int) -> pd.DataFrame:
    """For each target row the k + 1 nearest ids of one block, ties by id."""
    if not len(targets) or not len(block):
        none = np.array([], dtype=object)
        return pd.DataFrame({"rep": none, "peer_id": none, "distance": np.array([], dtype=float)})
    candidates, ids = _matrix(block["at"], dims), block["ids"].to_numpy()
    keep = min(k + 1, len(block))
    found = []
    for start in range(0, len(targets), SLICE_ROWS):
        some = targets.iloc[start:start + SLICE_ROWS]
        d = _distances(_matrix(some["z"], dims), candidates)
        limit = np.minimum(np.partition(d, keep - 1, axis=1)[:, keep - 1],
                           some["radius"].to_numpy() * (1 + 1e-9) + 1e-9)
        row, col = np.nonzero(d <= limit[:, None])
        found.append(pd.DataFrame({
            "rep": some["rep"].to_numpy()[row], "peer_id": ids[col], "distance": d[row, col],
        }))
    pairs = pd.concat(found).explode("peer_id").sort_values(["rep", "distance", "peer_id"])
    return pairs[pairs.groupby("rep").cumcount() <= k]


def _plant(vectors: DataFrame, n: int, depth: int, dims: int, leaf_size: int) -> Tree:
    """Cut by a hash sample of a bounded number of rows; then measure the leaves."""
    every = max(1, n // SAMPLE_ROWS)
    picked = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("z").toPandas()
    tree = Tree(_matrix(picked["z"], dims), depth)
    placed = _placed(vectors, tree, dims)
    bounds = [f(F.col("z")[i]).alias(f"{name}{i}")
              for i in range(dims) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    # one row per leaf, at most 2 ** MAX_DEPTH
    leaves = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *bounds).toPandas()
    tree.set_leaves(leaves, dims, 2 * leaf_size)
    return tree


def _placed(vectors: DataFrame, tree: Tree, dims: int) -> DataFrame:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            yield batch.assign(leaf=tree.leaf(_matrix(batch["z"], dims)).astype("int32"))

    return vectors.select("rep", "ids", "z").mapInPandas(
        place, "rep string, ids array<string>, z array<double>, leaf int"
    )


def _in_blocks(vectors: DataFrame, tree: Tree, dims: int) -> DataFrame:
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in filter(len, batches):
            leaf = tree.leaf(_matrix(batch["z"], dims))
            part = batch["spread"].to_numpy() % np.maximum(tree.blocks[leaf], 1)
            block = (tree.first_block[leaf] + part).astype("int32")
            yield batch.drop(columns="spread").assign(block=block)

    return vectors.select(
        "rep", "ids", "z", F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).cast("int").alias("spread")
    ).mapInPandas(locate, "rep string, ids array<string>, z array<double>, block int")


def _visits(blocks: DataFrame, tree: Tree, k: int, dims: int) -> DataFrame:
    """One row per vector and block it must be compared with."""
    def reach(block: pd.DataFrame) -> pd.DataFrame:
        z = _matrix(block["z"], dims)
        radius = _radius(z, block["ids"].map(len).to_numpy(), k)
        row, dst = tree.visits(z, radius)
        return pd.DataFrame({
            "block": dst.astype("int32"), "rep": block["rep"].to_numpy()[row],
            "z": block["z"].to_numpy()[row], "radius": radius[row],
        })

    return blocks.groupBy("block").applyInPandas(
        reach, "block int, rep string, z array<double>, radius double"
    )


def _parts(visits: DataFrame, most: int) -> DataFrame:
    """Into how many parts the visitors of a crowded block are split; other blocks are absent."""
    crowded = visits.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return crowded.select("block", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def nearest_vectors(
    vectors: DataFrame, k: int, dims: int, leaf_size: int = LEAF_SIZE, visitors: int = VISITORS
) -> DataFrame:
    """(rep, near): the k + 1 nearest ids of each vector as sorted structs.

    ``vectors`` must be a stored table: it is read several times.
    """
    tree, blocks = _planted(vectors, dims, leaf_size)
    return _merged(write_scratch(_visits(blocks, tree, k, dims), "knn-visits"), blocks, k, dims, visitors)


def _planted(vectors: DataFrame, dims: int, leaf_size: int) -> tuple[Tree, DataFrame]:
    n = vectors.count()
    depth = min(MAX_DEPTH, max(MIN_DEPTH, int(np.ceil(np.log2(max(n, 1) / leaf_size)))))
    tree = _plant(vectors, n, depth, dims, leaf_size)
    return tree, write_scratch(_in_blocks(vectors, tree, dims), "knn-blocks")


def _merged(visits: DataFrame, blocks: DataFrame, k: int, dims: int, visitors: int) -> DataFrame:
    """(rep, near) of all visitors from the blocks they visit; ``visits`` is stored."""
    # a block's visitors and a copy of the block meet in one task; a crowded
    # block is copied to several, so both sides and what is found stay bounded
    most = max(1, min(visitors, PAIRS // (k + 1)))
    parts = write_scratch(_parts(visits, most), "knn-parts")
    n_parts = F.coalesce("parts", F.lit(1))
    asking = visits.join(parts, "block", "left").select(
        "block", F.pmod(F.xxhash64("rep"), n_parts).cast("int").alias("part"), "rep", "z", "radius"
    )
    offered = blocks.join(parts, "block", "left").select(
        F.col("block").alias("to_block"), F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("to_part"),
        "ids", F.col("z").alias("at"),
    )

    def compare(targets: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _nearest(targets, block, k, dims)

    found = (
        asking.groupBy("block", "part").cogroup(offered.groupBy("to_block", "to_part"))
        .applyInPandas(compare, "rep string, peer_id string, distance double")
    )
    best = top_k(found, ["rep"], [F.col("distance"), F.col("peer_id")], k + 1, "i")
    return best.groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("distance", "peer_id"))).alias("near")
    )


def knn_edges(
    features: DataFrame, k: int = 10, metrics: Sequence[str] = tuple(schema.METRICS),
    leaf_size: int = LEAF_SIZE, visitors: int = VISITORS,
) -> DataFrame:
    """Edge table ``(target_id, peer_id, rank, distance)``, nearest first.

    Runs jobs when called: the distinct vectors, the blocks and the visits are
    written to the scratch folder.
    """
    cols = list(metrics)
    vectors = write_scratch(_vectors(features, cols, k), "knn-vectors")
    near = nearest_vectors(vectors, k, len(cols), leaf_size, visitors)
    lists = vectors.select(*cols, "rep").join(near, "rep").drop("rep")
    targets = features.select(F.col("inst_id").alias("target_id"), *cols)
    others = F.filter("near", lambda e: e["peer_id"] != F.col("target_id"))
    return (
        targets.join(lists, cols)
        .select("target_id", F.posexplode(F.slice(others, 1, k)).alias("i", "e"))
        .select("target_id", F.col("e.peer_id").alias("peer_id"),
                (F.col("i") + 1).alias("rank"), F.col("e.distance").alias("distance"))
    )


class PeerModel:
    """Fitted once and stored: scales, tree and blocks answer for any vectors later.

    ``folder`` holds the blocks (``blocks``) and one row with the rest (``model``), whose
    size is bounded by the tree's depth.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.blocks = spark.read.parquet(f"{folder}/blocks")
        row = spark.read.parquet(f"{folder}/model").first()
        self.metrics, self.k, self.stats = list(row["metrics"]), row["k"], row["stats"]
        held = np.load(io.BytesIO(bytes(row["tree"])))
        self.tree = Tree.__new__(Tree)
        self.tree.depth = int(held["depth"])
        for name in TREE_ARRAYS:
            setattr(self.tree, name, held[name])

    @staticmethod
    def fit(
        features: DataFrame, folder: str, k: int = 10, metrics: Sequence[str] = tuple(schema.METRICS),
        leaf_size: int = LEAF_SIZE,
    ) -> PeerModel:
        """Fit on ``features`` for up to ``k`` peers and store the model below ``folder``."""
        spark, cols = features.sparkSession, list(metrics)
        vectors = write_scratch(_vectors(features, cols, k), "knn-vectors")
        tree, blocks = _planted(vectors, len(cols), leaf_size)
        blocks.hint("rebalance").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{folder}/blocks")
        held = io.BytesIO()
        np.savez(held, depth=tree.depth, **{name: getattr(tree, name) for name in TREE_ARRAYS})
        stats = scales(features, cols)
        stats.select(F.lit(bytearray(held.getvalue())).alias("tree"), F.array(*[F.lit(m) for m in cols]).alias("metrics"),
                     F.lit(k).alias("k"), F.struct(*stats.columns).alias("stats")
                     ).write.mode("overwrite").parquet(f"{folder}/model")
        return PeerModel(spark, folder)

    def peers(self, targets: DataFrame, k: int | None = None, visitors: int = VISITORS) -> DataFrame:
        """``knn_edges`` rows for the vectors of ``targets`` (inst_id and metrics), nearest first.

        Targets need not be among the fitted entities; one that is, is no peer of itself.
        Null metrics count as 0. Only ``targets`` are compared, with the blocks near them.
        ``target_id`` must be unique.
        """
        k = self.k if k is None else k
        if k > self.k:
            raise ValueError(f"the model was fitted for {self.k} peers")
        dims, tree = len(self.metrics), self.tree
        told = {f: self.stats[f] for f in self.stats.__fields__}
        stats = {f: F.lit(v) for f, v in told.items()}
        asked = write_scratch(targets.na.fill(0, subset=self.metrics).select(
            F.col("inst_id").alias("rep"), scaled(self.metrics, stats).alias("z")), "knn-asked")

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in filter(len, batches):
                leaf = tree.leaf(_matrix(batch["z"], dims))
                # a leaf that no fitted vector is in has no block
                block = np.where(tree.blocks[leaf] > 0, tree.first_block[leaf], -1)
                yield batch.assign(block=block.astype("int32"))

        def reach(some: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            z = _matrix(some["z"], dims)
            radius = _radius_to(z, _matrix(block["at"], dims), block["ids"].map(len).to_numpy(), k)
            row, to = tree.visits(z, radius)
            return pd.DataFrame({"block": to.astype("int32"), "rep": some["rep"].to_numpy(object)[row],
                                 "z": some["z"].to_numpy(object)[row], "radius": radius[row]})

        placed = asked.mapInPandas(place, "rep string, z array<double>, block int")
        # asked in parts of bounded size, each with its block
        part = F.pmod(F.xxhash64("rep"), F.lit(max(1, asked.count() // visitors + 1))).cast("int")
        parts = placed.withColumn("part", part)
        needed = parts.select("block", "part").distinct()
        offered = self.blocks.join(needed, "block").select(
            F.col("block").alias("to_block"), F.col("part").alias("to_part"), "ids", F.col("z").alias("at"))
        visits = write_scratch(parts.groupBy("block", "part").cogroup(offered.groupBy("to_block", "to_part")).applyInPandas(
            reach, "block int, rep string, z array<double>, radius double"), "knn-visits")
        visited = self.blocks.join(visits.select("block").distinct(), "block", "left_semi")
        near = _merged(visits, visited, k, dims, visitors)
        others = F.slice(F.filter("near", lambda e: e["peer_id"] != F.col("rep")), 1, k)
        return near.select(F.col("rep").alias("target_id"), F.posexplode(others).alias("i", "e")).select(
            "target_id", F.col("e.peer_id").alias("peer_id"), (F.col("i") + 1).alias("rank"),
            F.col("e.distance").alias("distance"))


TREE_ARRAYS = ("axis", "cut", "low", "high", "blocks", "first_block")


def _radius_to(z: np.ndarray, block: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Distance within which each row has k + 1 ids of a block; inf if the block has fewer."""
    radius = np.full(len(z), np.inf)
    if not len(block):
        return radius
    for start in range(0, len(z), SLICE_ROWS):
        d = _distances(z[start:start + SLICE_ROWS], block)
        order = np.argsort(d, axis=1)
        enough = np.cumsum(copies[order], axis=1) > k
        reached = np.take_along_axis(d, order, axis=1)[np.arange(len(d)), enough.argmax(axis=1)]
        radius[start:start + SLICE_ROWS] = np.where(enough.any(axis=1), reached, np.inf)
    return radius
