"""Benchmark items inside documents, by size-partitioned MinHash containment.

Items are partitioned by their number of shingles (powers of two). The sketch of
an item is its ``SKETCH`` least shingle hashes; a document's sketch for a
partition is all its shingles up to the partition's largest sketch hash, so long
items need only a small part of a document, and short ones are looked up whole.
Documents too short to hold four fifths of a partition's items skip it. The share
of an item's sketch found in a document estimates its containment; pairs that may
reach the threshold are verified on the exact shingle sets.

Items of fewer than five words are one shingle, all their words; they are a partition
for each number of words, and documents are probed with all their runs of so many
words. Such a run is the whole item, so a hit needs no further check.

A bit table of fixed size per partition holds back shingles that no sketch has
before anything is moved; it never decides a match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import (
    PUNCTUATION, Hasher, Texts, bound_batches, boxed, distinct_per, list_column, lowered, separators, shingles,
    text_key, text_slices, unboxed, whole_text, word_runs, word_spans,
)
from .similar import small_join

WORDS = 5
THRESHOLD = 0.8
SKETCH = 32
LEAST_SHARE = 0.3  # of a sketch; containment 0.8 falls below with probability under 1e-8
BITS = 22  # the bit table of a partition has 2 ** BITS bits


class Plain:
    """Shingles of a slice: ASCII letters lowered, ASCII punctuation and white space apart."""

    def __init__(self) -> None:
        self.hasher, self.lower, self.apart = Hasher(31), lowered(), separators(PUNCTUATION)

    def words(self, part: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of a slice, and the texts they are in."""
        data = self.lower[part.data]
        starts, ends, doc = word_spans(data, part.offsets, self.apart)
        return self.hasher.spans(data, starts, ends), doc

    def __call__(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        items, owner, _ = distinct_per(*shingles(hashes, doc, n, WORDS))
        return items.astype(np.int64), owner


def _shingle_sets(keys: list[str]):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Plain()
        for part in text_slices(batches):
            hashes, doc = plain.words(part)
            items, owner = plain(hashes, doc, part.rows.num_rows)
            words = np.bincount(doc, minlength=part.rows.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*[part.rows.column(k) for k in keys], pa.array(words.astype(np.int64)),
                 list_column(items, owner, part.rows.num_rows, pa.int64())], [*keys, "words", "items"])

    return sets


def item_sets(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_key, items, part): items with shingles, stored. Equal rows are one.

    ``part`` is minus the number of words of an item that is shorter than a shingle.
    """
    chosen = benchmark.select(F.col("item_id").cast("long"), whole_text().alias("text"),
                              text_key().alias("item_key")).distinct()
    sets = chosen.select("item_id", "item_key", "text").mapInArrow(
        _shingle_sets(["item_id", "item_key"]), "item_id long, item_key long, words long, items array<long>")
    part = F.when(F.col("words") < WORDS, -F.col("words")).otherwise(F.ceil(F.log2(F.size("items")))).cast("int")
    return write_scratch(sets.where(F.size("items") > 0).withColumn("part", part).drop("words"), "items")


def item_sketches(items: DataFrame) -> DataFrame:
    """(item_id, item_key, part, hash, of): one row per sketch hash of an item of ``of`` hashes."""
    sketch = F.slice(F.sort_array("items"), 1, SKETCH)
    return write_scratch(items.select(
        "item_id", "item_key", "part", F.size(sketch).alias("of"), F.explode(sketch).alias("hash")),
        "sketches")


def bit_tables(sketches: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Per partition its largest sketch hash and its bit table; as large as ``BITS`` says."""
    tops = {r.part: r.top for r in sketches.groupBy("part").agg(F.max("hash").alias("top")).collect()}
    bit = F.shiftrightunsigned("hash", 64 - BITS)
    words = sketches.groupBy("part", F.floor(bit / 32).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(32)).cast("int")))
        .alias("set")).collect()
    tables = {p: np.zeros((1 << BITS) // 32, np.uint32) for p in tops}
    for row in words:
        tables[row.part][row.word] = row.set
    return {p: (tops[p], tables[p]) for p in tops}


def sketch_hits(docs: DataFrame, tables: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """(doc_id, text_key, part, hash) of document shingles that a sketch may have."""
    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = Plain()
        for part in text_slices(batches):
            hashes, doc = plain.words(part)
            items, owner = plain(hashes, doc, part.rows.num_rows)
            size = np.bincount(owner, minlength=part.rows.num_rows)
            for number, (top, table) in tables.items():
                if number < 0:
                    probes, of = word_runs(hashes, doc, -number)
                    probes = probes.astype(np.int64)
                else:
                    long = size[owner] >= THRESHOLD * (2 ** (number - 1) + 1 if number else 1)
                    probes, of = items[long], owner[long]
                bit = probes.astype(np.uint64) >> np.uint64(64 - BITS)
                word, mask = (bit >> np.uint64(5)).astype(np.int64), np.uint32(1) << (bit & np.uint64(31)).astype(np.uint32)
                found = np.flatnonzero((table[word] & mask != 0) & (probes <= top))
                if len(found):
                    at = pa.array(of[found])
                    yield pa.RecordBatch.from_arrays(
                        [part.rows.column("doc_id").take(at), part.rows.column("text_key").take(at),
                         pa.array(np.full(len(found), number, np.int32)), pa.array(probes[found])],
                        ["doc_id", "text_key", "part", "hash"])

    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"),
                       text_key().alias("text_key"))
    return rows.mapInArrow(hits, "doc_id long, text_key long, part int, hash long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, shared, item_shingles, containment) of all leaks.

    Texts without words neither leak nor are leaked. An item of fewer than five
    words is found wherever its words follow each other. Rows repeated whole are found once; a null
    id is a value like any other. An empty table gives an empty table.
    """
    bound_batches(docs.sparkSession)
    items = item_sets(benchmark)
    sketches = item_sketches(items)
    hits = sketch_hits(docs, bit_tables(sketches)).distinct()
    met = write_scratch(hits.join(sketches, ["part", "hash"]), "sketch-hits")
    near = (met.where(F.col("part") >= 0).groupBy("doc_id", "text_key", "item_id", "item_key", "of").agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_SHARE * F.col("of")))
    near = write_scratch(near.select("doc_id", "text_key", "item_id", "item_key"), "near-items")
    wanted = write_scratch(near.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
                           .distinct(), "wanted")
    keyed = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), whole_text().alias("text"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    held = small_join(keyed, wanted, on, "left_semi").mapInArrow(
        _shingle_sets(["doc_id", "text_key"]), "doc_id long, text_key long, words long, items array<long>")
    sets = held.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("items").alias("_doc"))
    of = items.select(F.col("item_id").alias("_item"), F.col("item_key").alias("_ikey"), "items")
    pairs = near.join(of, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_key") == F.col("_ikey")))
    shared = F.size(F.array_intersect("items", "_doc"))
    found = pairs.join(sets, on).select(
        "doc_id", "text_key", "item_id", shared.alias("shared"), F.size("items").alias("item_shingles"))
    short = met.where(F.col("part") < 0).select(
        "doc_id", "text_key", "item_id", F.lit(1).alias("shared"), F.lit(1).alias("item_shingles"))
    return found.where(F.col("shared") >= THRESHOLD * F.col("item_shingles") - 1e-9).union(short).withColumn(
        "containment", F.col("shared") / F.col("item_shingles")).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns as they are."""
    leaks = write_scratch(contaminated(docs, benchmark).select(
        F.col("doc_id").alias("_leak_id"), F.col("text_key").alias("_leak_key")).distinct(), "leaks")
    on = F.col("_id").eqNullSafe(F.col("_leak_id")) & (F.col("_key") == F.col("_leak_key"))
    return unboxed(small_join(boxed(docs), leaks, on, "left_anti"), docs)
