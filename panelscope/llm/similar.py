"""Classes of similar sets from banded signatures, shared by documents and lines.

A node is the 64-bit fingerprint of a text; texts with one fingerprint are one
node. Nodes meet in buckets (equal band keys). Every bucket links its members to
its least one; links are verified on the whole sets, and components are formed.
Buckets that still hold several components are searched block by block, blocks of
one component not with each other. The least member is searched with the others, as
members that one Arrow batch held have been compared with that batch's center only.
Neither step writes all pairs of a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import U, mix
from .graph import components

EXACT = 1e-9  # counts are whole; a similarity of just the threshold counts
BLOCK = 256  # members of a bucket compared with as many others in one group
BROADCAST_ROWS = 1_000_000  # rows of two or three numbers, under 32 MB
PACKED = "part int, keys binary, nodes binary, local binary"
ENTRIES = 1 << 21  # of a part, which one task holds: 16 bytes each, and as much again while it sorts
PAIRS = "key long, a long, b long"


def small_join(left: DataFrame, right: DataFrame, on, how: str, entries: Column | None = None) -> DataFrame:
    """Join a narrow stored ``right``: broadcast if counted small, else as Spark decides.

    ``entries`` is what a row of ``right`` counts for, if it holds a list.
    """
    held = right.agg(F.sum(F.lit(1) if entries is None else entries)).first()[0] or 0
    return left.join(F.broadcast(right) if held <= BROADCAST_ROWS else right, on, how)


def bucket_parts(spark: SparkSession, entries: int) -> int:
    """Parts that the keys are dealt to, for about so many (key, node) entries."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries // ENTRIES))


def _packed(values: np.ndarray, part: np.ndarray, parts: int) -> pa.Array:
    """The bytes of each part's rows of 64-bit numbers, which are in the order of parts."""
    width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    ends = np.searchsorted(part, np.arange(parts + 1)).astype(np.int32) * np.int32(width)
    return pa.BinaryArray.from_buffers(
        pa.binary(), parts, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def keyed_batch(keys: np.ndarray, nodes: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of ``PACKED`` for the (key, node) entries of one Arrow batch, one a part.

    A key sends one entry to its bucket's part; the other nodes of the batch with that
    key are paired with that entry's node here, however many they are, and these pairs
    go to any part.
    """
    keys = keys.astype(U)
    order = np.argsort(keys)
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = nodes[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))] if len(keys) else nodes
    local = np.flatnonzero(~new & (nodes != first))
    again = local[np.lexsort((nodes[local], keys[local]))]
    same = (keys[again[1:]] == keys[again[:-1]]) & (nodes[again[1:]] == nodes[again[:-1]])
    local = np.setdiff1d(local, again[1:][same], assume_unique=True)
    high = U(32)
    # the upper half of a key tells its part, so sorted keys are in the order of parts
    part = (keys[new] >> high) * U(parts) >> high
    held = np.stack([keys[local].view(np.int64), first[local], nodes[local]], axis=1)
    to = (mix(keys[local] ^ mix(nodes[local].astype(U))) >> high) * U(parts) >> high
    order = np.argsort(to, kind="stable")
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(parts, dtype=np.int32)), _packed(keys[new], part, parts), _packed(nodes[new], part, parts),
         _packed(held[order], to[order], parts)], [c.split()[0] for c in PACKED.split(", ")])


def _numbers(column: pa.Array) -> np.ndarray:
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(held.tobytes(), np.int64)


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the buckets of one part: each member with the least, and what batches have paired."""
    keys, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def rows(key, a, b):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b)], ["key", "a", "b"])

    for batch in batches:
        keys.append(_numbers(batch.column("keys")))
        nodes.append(_numbers(batch.column("nodes")))
        local = _numbers(batch.column("local")).reshape(-1, 3)
        if len(local):
            yield rows(*local.T)
    key, node = np.concatenate(keys), np.concatenate(nodes)
    del keys, nodes
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = node[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else node
    other = ~new & (node != first)
    other[1:] &= new[1:] | (node[1:] != node[:-1])  # a node that several batches sent
    yield rows(key[other], first[other], node[other])


def bucket_pairs(keyed: DataFrame, parts: int) -> DataFrame:
    """(key, a, b): each member of a bucket with the least member, or with its batch's, stored."""
    held = keyed.where((F.length("keys") > 0) | (F.length("local") > 0))
    return write_scratch(held.repartitionById(parts, "part").mapInArrow(_pair_up, PAIRS), "pairs")


class Items(NamedTuple):
    """Distinct items of texts, and one more entry per repetition of an item."""

    items: np.ndarray
    owner: np.ndarray
    extra: np.ndarray
    extra_owner: np.ndarray


ItemsOf = Callable[[pa.Array], Items]


def overlap(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, n: int) -> np.ndarray:
    """Numbers of items that the n sets of ``a`` share with those of ``b``; items have 44 bits."""
    keys = np.sort(np.concatenate([of.astype(U) << U(44) | x for x, of in ((a, of_a), (b, of_b))]))
    return np.bincount((keys[1:][keys[1:] == keys[:-1]] >> U(44)).astype(np.int64), minlength=n)


def agree(a: Items, b: Items, n: int, threshold: float) -> np.ndarray:
    """Which of n pairs reach the threshold as sets or as sets with counts."""
    both = overlap(a.items, a.owner, b.items, b.owner, n)
    either = np.bincount(a.owner, minlength=n) + np.bincount(b.owner, minlength=n) - both
    more = overlap(a.extra, a.extra_owner, b.extra, b.extra_owner, n)
    beside = np.bincount(a.extra_owner, minlength=n) + np.bincount(b.extra_owner, minlength=n) - more
    return (both >= threshold * either - EXACT) | (both + more >= threshold * (either + beside) - EXACT)


def verified(pairs: DataFrame, texts: DataFrame, items_of: ItemsOf, threshold: float) -> DataFrame:
    """The (a, b) whose texts reach the threshold."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                a, b = (items_of(part.column(c)) for c in ("_a", "_b"))
                chosen = pa.array(agree(a, b, part.num_rows, threshold))
                yield part.select(["a", "b"]).filter(chosen)

    of = {s: texts.select(F.col("node").alias(s), F.col("text").alias(f"_{s}")) for s in "ab"}
    return pairs.join(of["a"], "a").join(of["b"], "b").select("a", "b", "_a", "_b").mapInArrow(
        check, "a long, b long")


def _take(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray):
    """The items of the chosen sets, one set after the other, and which of them each is of."""
    n = sizes[chosen]
    owner = np.repeat(np.arange(len(chosen)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + starts[chosen][owner]
    return values[at], owner


AT_ONCE = 2048  # rows of sorted groups handled at once
COLUMNS = 4096  # shared items handled at once


def _shared(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x n numbers of items that the sets have in common."""
    out = np.zeros((n, n), np.float32)
    _, item, held = np.unique(values, return_inverse=True, return_counts=True)
    met = held > 1
    number = np.cumsum(met) - 1
    chosen = met[item]
    item, owner = number[item[chosen]], owner[chosen]
    for low in range(0, int(met.sum()), COLUMNS):
        part = (item >= low) & (item < low + COLUMNS)
        table = np.zeros((n, COLUMNS), np.float32)
        table[owner[part], item[part] - low] = 1
        out += table @ table.T
    return out


def _search(items_of: ItemsOf, threshold: float):
    """Compares the members of each (key, low, high) group of sorted rows across components."""
    names = ["key", "low", "high", "node", "root", "block"]

    def links(members, root, crossed, found, places):
        """Pairs of places in ``members`` that are alike and of two components."""
        (size, first), (more, first_more) = places
        n = len(members)
        both = _shared(*_take(found.items, first, size, members), n)
        either = size[members][:, None] + size[members][None] - both
        alike = both >= threshold * either - EXACT
        if more[members].any():
            beside = _shared(*_take(found.extra, first_more, more, members), n)
            total = either + more[members][:, None] + more[members][None] - beside
            alike |= both + beside >= threshold * total - EXACT
        return np.nonzero(alike & crossed)

    def compare(table: pa.Table) -> pa.RecordBatch:
        key, low, high, node, root, block = (table.column(c).to_numpy() for c in names)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        cuts = np.append(np.flatnonzero(new), len(key))
        _, first, number = np.unique(node, return_index=True, return_inverse=True)
        found = items_of(table.column("text").take(pa.array(first)).combine_chunks())
        places = []
        for owner in (found.owner, found.extra_owner):
            size = np.bincount(owner, minlength=len(first))
            places.append((size, np.cumsum(size) - size))
        a, b = [], []
        for s, e in zip(cuts[:-1], cuts[1:]):
            crossed = (root[s:e, None] != root[s:e]) & (block[s:e, None] == low[s]) & (block[s:e] == high[s])
            if crossed.any():
                i, j = links(number[s:e], root[s:e], crossed, found, places)
                a.append(i + s)
                b.append(j + s)
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        # one link joins two components
        roots = np.sort(np.stack([root[i], root[j]]), axis=0)
        _, once = np.unique(roots, axis=1, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(node[i][once]), pa.array(node[j][once])], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            key, low, high = (table.column(c).to_numpy() for c in names[:3])
            starts = np.flatnonzero((key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1
            done = 0
            for cut in starts[np.diff(starts // AT_ONCE, append=-1) != 0]:  # the last start of each stretch
                yield compare(table.slice(done, cut - done))
                done = int(cut)
            held = table.slice(done)
        if held is not None:
            yield compare(held)

    return search


def _spread(members: DataFrame) -> DataFrame:
    """Members of buckets of several blocks, once for each pair of blocks that must meet.

    A component with more members than a block has blocks of its own, which need not
    meet each other; the small ones of a bucket share blocks. So a large component
    beside a few others costs a row or two a member.
    """
    members = write_scratch(members, "crowded-members")
    sizes = members.groupBy("key", "root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_own"),
                                               F.count(F.lit(1)).alias("_n"))
    large = F.col("_own") > 1
    shared = F.sum(F.when(~large, F.col("_n"))).over(Window.partitionBy("key"))
    placed = sizes.withColumn("_shared", F.ceil(F.coalesce(shared, F.lit(0)) / BLOCK).cast("int"))
    own = F.when(large, F.transform(F.sequence(F.lit(0), F.col("_own") - 1), lambda i: F.xxhash64("root", i))).otherwise(
        F.array(F.pmod(F.xxhash64("root"), F.greatest("_shared", F.lit(1))).cast("long")))
    placed = write_scratch(placed.select("key", "root", large.alias("_large"), own.alias("_blocks")), "blocks")
    every = placed.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("_blocks"))).alias("_every"))
    blocks = members.join(placed, ["key", "root"]).join(every, "key")
    home = F.get("_blocks", F.pmod(F.xxhash64("node"), F.size("_blocks")).cast("int"))
    others = F.when(F.col("_large"), F.array_except("_every", "_blocks")).otherwise(F.col("_every"))
    return blocks.select("key", "node", "root", home.alias("block"), F.explode(others).alias("_j")).select(
        "key", F.least("block", "_j").alias("low"), F.greatest("block", "_j").alias("high"),
        "node", "root", "block")


def open_links(
    pairs: DataFrame, roots: DataFrame, texts: DataFrame, items_of: ItemsOf, threshold: float
) -> DataFrame:
    """Links between members of one bucket that are not in one component yet."""
    # if all pairs of a bucket have one center, that one has been compared with all others, they with
    # each other not; members that Arrow batches paired with several centers have met only their own
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("center")),
                   F.struct(F.col("b").alias("node"), F.lit(False).alias("center")))
    rest = pairs.select("key", F.explode(ends).alias("e")).groupBy("key", "e.node").agg(
        F.bool_or("e.center").alias("center")).join(roots, "node", "left").select(
        "key", "node", "center", F.coalesce("root", "node").alias("root"))

    def span(of: Column, suffix: str) -> list[Column]:
        return [f(F.when(of, F.col("root"))).alias(f"_{n}{suffix}") for f, n in ((F.min, "low"), (F.max, "high"))]

    told = rest.groupBy("key").agg(
        *span(F.lit(True), ""), *span(~F.col("center"), "_met"),
        F.count_if("center").alias("_centers"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("_sum")).where(
        F.when(F.col("_centers") > 1, F.col("_low") != F.col("_high")).otherwise(
            F.col("_low_met") != F.col("_high_met")))
    # buckets with the same members are searched once
    open_keys = told.groupBy("_n", "_sum").agg(F.min("key").alias("key")).select("key")
    members = rest.drop("center").join(open_keys, "key", "left_semi")
    members = write_scratch(members, "members")
    crowded = write_scratch(members.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > BLOCK).select("key"), "crowded")
    zero = F.lit(0).cast("long")
    spread = small_join(members, crowded, "key", "left_anti").select(
        "key", zero.alias("low"), zero.alias("high"), "node", "root", zero.alias("block"))
    if not crowded.isEmpty():
        spread = spread.union(_spread(small_join(members, crowded, "key", "left_semi")))
    group = ["key", "low", "high"]  # of two blocks at most
    dealt = spread.join(texts, "node").repartition(*group).sortWithinPartitions(*group)
    return dealt.select(*group, "node", "root", "block", "text").mapInArrow(
        _search(items_of, threshold), "a long, b long")


def similar_classes(
    pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], items_of: ItemsOf, threshold: float
) -> DataFrame:
    """(node, root) of every node that is linked; ``pairs`` is what ``bucket_pairs`` stored.

    ``texts_of`` gives (node, text) for a table of nodes.
    """
    distinct = write_scratch(pairs.select("a", "b").distinct(), "candidates")
    nodes = write_scratch(
        distinct.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = write_scratch(texts_of(nodes), "texts")
    links = write_scratch(verified(distinct, texts, items_of, threshold), "verified")
    roots = write_scratch(components(links), "roots")
    more = write_scratch(open_links(pairs, roots, texts, items_of, threshold), "more-links")
    if more.isEmpty():
        return roots
    # join the components, not the nodes
    ends = more
    for end in "ab":
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
        ends = ends.join(named, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    met = components(ends).select(F.col("node").alias("root"), F.col("root").alias("_root"))
    alone = met.join(roots, "root", "left_anti").select(F.col("root").alias("node"), "root")
    every = roots.union(alone).join(met, "root", "left")
    return write_scratch(every.select("node", F.coalesce("_root", "root").alias("root")), "roots")
