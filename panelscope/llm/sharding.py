"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into a fixed number of cells. Every shard owns several virtual
nodes, each in the cell its hash names; a key belongs to the first virtual node
clockwise of its own cell. A shard takes its own keys in ring order up to its
capacity; keys that overflow continue clockwise to the next virtual node whose
shard has room. Only the number of rows per cell reaches the driver, so that
table is as large as the ring, whatever the input.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import whole_text

CELLS = 4096  # cells of the ring
LANES = 16  # parts of a cell, so that one repeated key spreads over several tasks
EXPLODE = 65_536  # copies of one row written by one array


class Range(NamedTuple):
    """Ranks ``start`` to ``stop`` of a (cell, lane) go to ``shard`` from ``slot`` on."""

    cell: int
    lane: int
    start: int
    stop: int
    shard: int
    slot: int


def virtual_nodes(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; a shard's do not depend on the others."""
    placed = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = int.from_bytes(hashlib.blake2b(f"{shard}:{v}".encode(), digest_size=8).digest())
            placed.append((digest % cells, digest, shard))
    return [(cell, shard) for cell, _, shard in sorted(placed)]


def capacities(rows: int, shards: int, load: float | None) -> list[int]:
    """``load`` times the mean, rounded up; None: as equal as whole rows allow."""
    if load is None:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    if load < 1:
        raise ValueError("a load factor under 1 leaves rows without a shard")
    return [-int(-rows * load // shards)] * shards


def place(
    counts: list[tuple[int, int, int]], shards: int, vnodes: int, load: float | None,
    cells: int = CELLS,
) -> list[Range]:
    """Walk the ring over (cell, lane, rows) counts."""
    ring = virtual_nodes(shards, vnodes, cells)
    room = capacities(sum(n for _, _, n in counts), shards, load)
    filled = [0] * shards
    out: list[Range] = []
    waiting: list[list[tuple[int, int, int, int]]] = [[] for _ in ring]

    def take(shard: int, cell: int, lane: int, start: int, stop: int) -> int:
        n = min(stop - start, room[shard] - filled[shard])
        if n:
            out.append(Range(cell, lane, start, start + n, shard, filled[shard]))
            filled[shard] += n
        return start + n

    at = 0
    for cell, lane, n in sorted(counts):
        while at < len(ring) and ring[at][0] < cell:
            at += 1
        owner = at % len(ring)
        left = take(ring[owner][1], cell, lane, 0, n)
        if left < n:
            waiting[owner].append((cell, lane, left, n))
    carried: list[tuple[int, int, int, int]] = []
    for _ in range(3):  # two rounds meet every shard after the last overflow
        for i, (_, shard) in enumerate(ring):
            still = []
            for cell, lane, start, stop in carried:
                start = take(shard, cell, lane, start, stop)
                if start < stop:
                    still.append((cell, lane, start, stop))
            carried, waiting[i] = still + waiting[i], []
        if not carried:
            break
    return out


def ring_shards(
    rows: DataFrame, key: str, shards: int, content: tuple[str, ...] = (), vnodes: int = 64,
    load: float | None = None,
) -> DataFrame:
    """Append ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` decides the place on the ring; ``content`` orders rows of one key. The
    result depends on the rows alone, not on their files or order. A null key is a
    key like any other. Rows equal in key and content are counted before they are
    moved and written again at the end, so a much repeated row is no hot spot.
    Other columns are not carried; clashing names cannot arise. An empty table
    gives an empty table.
    """
    spark = rows.sparkSession
    names = [key, *content]
    tie = F.xxhash64(*[F.col(c) for c in names])
    counted = rows.select(*names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(
        *names, "_n", F.pmod(F.xxhash64(key), F.lit(CELLS)).cast("int").alias("_cell"),
        F.pmod(tie, F.lit(LANES)).cast("int").alias("_lane"), tie.alias("_tie"))
    stored = write_scratch(counted, "ring")
    counts = [tuple(r) for r in stored.groupBy("_cell", "_lane").agg(F.sum("_n")).collect()]
    placed = place(counts, shards, vnodes, load)
    table = F.broadcast(spark.createDataFrame(
        placed, "_cell int, _lane int, _start long, _stop long, shard int, _slot long"))
    order = Window.partitionBy("_cell", "_lane").orderBy("_tie", *names)
    first = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ranked = stored.withColumn("_first", first)
    start = F.greatest("_first", "_start")
    parts = (ranked.join(table, ["_cell", "_lane"])
             .where((F.col("_start") < F.col("_first") + F.col("_n")) & (F.col("_stop") > F.col("_first")))
             .select(*names, "shard", (F.col("_slot") + start - F.col("_start")).alias("_at"),
                     (F.least(F.col("_first") + F.col("_n"), "_stop") - start).alias("_n")))
    return _copies(parts, names)


def _copies(parts: DataFrame, names: list[str]) -> DataFrame:
    """``_n`` rows with consecutive slots for each row; arrays stay short."""
    pieces = parts.withColumn("_from", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("_n") - 1, F.lit(EXPLODE).cast("long"))))
    last: Column = F.least(F.col("_n") - 1, F.col("_from") + EXPLODE - 1)
    return pieces.withColumn("_i", F.explode(F.sequence(F.col("_from"), last))).select(
        *names, "shard", (F.col("_at") + F.col("_i")).alias("slot"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, bytes of the text plus 8, CRC-32 of the text; a null text has no bytes."""
    text = whole_text()
    return docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 64) -> DataFrame:
    """All documents in shards whose row counts differ by one at most."""
    placed = ring_shards(document_sizes(docs), "doc_id", shards, ("size", "text_crc32"), vnodes)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
