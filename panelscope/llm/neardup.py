"""Near-duplicate documents by DartMinHash over shingles of five words.

DartMinHash (Christiani 2020): darts fall, by hashing alone, on the plane of
weight and rank above every element. A weighted set is hit by the darts under its
weights; each dart names one of k coordinates, and each coordinate keeps its
earliest dart. Ranks are cut into intervals, so that a set with total weight W
throws only the first t / W of them, t being k ln k + 2 k: a large set throws as
few darts as a small one.

A document is thrown as a set (weight 1 for each distinct shingle) and, where
shingles repeat, with their counts too. Signatures are banded; pairs are verified
on the whole shingle sets and linked if the similarity as sets or with counts
reaches the threshold; classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import (
    OWNER_BITS, Hasher, Texts, U, bound_batches, boxed, counts_per, mix, separators, shingles, sorted_sets, text_key,
    text_slices, unboxed, whole_text, word_spans,
)
from .similar import PACKED, Items, bucket_pairs, bucket_parts, keyed_batch, similar_classes, small_join

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4  # a pair of similarity 0.8 shares a band with probability 0.999997
COORDINATES = BANDS * ROWS
LOWEST = -12  # the first rank interval is 0 to 2 ** LOWEST
UNIT = 2.0**-53


def dart_target(k: int) -> float:
    return k * np.log(k) + 2 * k


def _poisson(uniform: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts by inversion."""
    steps, term = [np.exp(-mean)], np.exp(-mean)
    while steps[-1] < 1 - UNIT and len(steps) < 40:
        term *= mean / len(steps)
        steps.append(steps[-1] + term)
    return np.searchsorted(np.array(steps), uniform, "right")


def _uniform(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(float) * UNIT


def _intervals(reach: np.ndarray) -> Iterator[tuple[int, float, float, np.ndarray]]:
    """Rank intervals (number, low, high) and the elements whose ``reach`` covers them.

    ``reach`` is a power of two: doubling intervals below 1, unit ones above.
    """
    yield 0, 0.0, 2.0**LOWEST, np.arange(len(reach))
    for e in range(LOWEST, 0):
        inside = np.flatnonzero(reach >= 2.0 ** (e + 1))
        if len(inside):
            yield e - LOWEST + 1, 2.0**e, 2.0 ** (e + 1), inside
    c, inside = 1, np.flatnonzero(reach >= 2)
    while len(inside):
        yield c - LOWEST, float(c), float(c + 1), inside
        c += 1
        inside = inside[reach[inside] >= c + 1]


def darts(
    elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = COORDINATES
) -> np.ndarray:
    """n x k signatures (dart ids; 0 where no dart fell) of n weighted sets.

    ``elements`` are hashes ordered by ``owner``; weights are positive. Weight above
    a whole number is met by darts whose own weight lies below it.
    """
    total = np.bincount(owner, weights, n)
    with np.errstate(divide="ignore"):
        reach = np.exp2(np.maximum(np.ceil(np.log2(dart_target(k) / total)), LOWEST))
    # one cell of weight 1 per started unit of weight
    cells = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), cells)
    level = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    seeds = np.where(level == 0, elements[at], mix(elements[at] + level.astype(U) * U(0xA24BAED4963EE407)))
    room, set_of = weights[at] - level, owner[at]
    ids, ranks, sets = [], [], []
    for number, low, high, inside in _intervals(reach[set_of]):
        seed = mix(seeds[inside] + U((number + 1) * 0x9FB21C651E98DF25 % 2**64))
        hits = _poisson(_uniform(seed), high - low)
        hit = np.flatnonzero(hits)
        many = np.repeat(hit, hits[hit])
        order = np.arange(len(many)) - np.repeat(np.cumsum(hits[hit]) - hits[hit], hits[hit])
        dart = mix(seed[many] + (order + 1).astype(U) * U(0xE7037ED1A0B428DB))
        where = inside[many]
        under = _uniform(mix(dart + U(3))) < room[where]
        ids.append(dart[under])
        ranks.append(low + (high - low) * _uniform(mix(dart[under] + U(1))))
        sets.append(set_of[where[under]])
    ids, ranks, sets = np.concatenate(ids), np.concatenate(ranks), np.concatenate(sets)
    coordinate = (mix(ids + U(2)) >> U(32)) * U(k) >> U(32)
    late = np.argsort(-ranks)
    out = np.zeros(n * k, U)
    out[(sets * k + coordinate.astype(np.int64))[late]] = ids[late]  # the earliest is written last
    return out.reshape(n, k)


def band_entries(signature: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of every band that has a dart in all its coordinates."""
    grouped = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), grouped.shape[:2])
    for r in range(rows):
        key = mix(key + grouped[:, :, r])
    full = (grouped != 0).all(axis=2)
    return np.nonzero(full)[0], key[full].astype(np.int64)


class Shingled:
    """Words, fingerprints and shingles of a slice; words are runs of non-white bytes."""

    def __init__(self, seed: int = 21):
        self.first, self.second, self.apart = Hasher(seed), Hasher(seed + 1), separators()

    def words(self, part: Texts):
        starts, ends, doc = word_spans(part.data, part.offsets, self.apart)
        return starts, ends, doc, self.first.spans(part.data, starts, ends)

    @staticmethod
    def print_of(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """One fingerprint per text from its words in order."""
        per = counts_per(doc, n)
        at = (np.arange(len(doc)) - (np.cumsum(per) - per)[doc]).astype(U)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes + at * U(0xC2B2AE3D27D4EB4F)))])
        ends = np.cumsum(per)
        return mix(sums[ends] - sums[ends - per] + per.astype(U)).astype(np.int64)

    def nodes(self, part: Texts):
        starts, ends, doc, hashes = self.words(part)
        n = part.rows.num_rows
        return hashes, doc, counts_per(doc, n), self.print_of(hashes, doc, n), (starts, ends)


def document_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, check) of the documents with words, stored."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingled()
        for part in text_slices(batches):
            _, doc, per, node, (starts, ends) = shingled.nodes(part)
            check = shingled.print_of(shingled.second.spans(part.data, starts, ends), doc, len(per))
            some = np.flatnonzero(per)
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id").take(at), part.rows.column("text_key").take(at),
                 pa.array(node[some]), pa.array(check[some])],
                ["doc_id", "text_key", "node", "check"])

    bound_batches(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"),
                         text_key().alias("text_key"))
    return write_scratch(chosen.mapInArrow(
        rows, "doc_id long, text_key long, node long, check long"), "documents")


def document_keys(docs: DataFrame, parts: int) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingled = Shingled()
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part in text_slices(iter([batch]), last=False):
                hashes, doc, per, node, _ = shingled.nodes(part)
                once = np.zeros(len(per), bool)
                once[np.unique(node, return_index=True)[1]] = True
                once &= per > 0
                chosen = once[doc]
                items, owner = shingles(hashes[chosen], doc[chosen], len(per), WORDS)
                items, owner, n = sorted_sets(items, owner)
                at, key = band_entries(darts(items, np.ones(len(items)), owner, len(per)), BANDS, ROWS)
                found.append((key, node[at]))
                repeats = np.bincount(owner, n > 1, len(per)) > 0
                if repeats.any():
                    number = np.cumsum(repeats) - 1
                    again = repeats[owner]
                    at, key = band_entries(darts(
                        items[again], n[again].astype(float), number[owner[again]],
                        int(repeats.sum())), BANDS, ROWS)
                    found.append((key, node[np.flatnonzero(repeats)[at]]))
            if found:
                yield keyed_batch(*(np.concatenate(x) for x in zip(*found)), parts)

    return docs.select(whole_text().alias("text")).mapInArrow(keys, PACKED)


def document_items(texts: pa.Array) -> Items:
    """The distinct shingles of texts, and one more entry per repetition."""
    shingled, n_texts = Shingled(), len(texts)
    found, base = [], 0
    for part in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), last=False):
        _, _, doc, hashes = shingled.words(part)
        items, owner = shingles(hashes, doc, part.rows.num_rows, WORDS)
        items, owner, n = sorted_sets(items, owner)
        more = np.repeat(np.arange(len(items)), n - 1)
        turn = np.arange(len(more)) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
        extra = mix(items[more] + (turn + 1).astype(U) * U(0xD1B54A32D192ED03)) >> U(OWNER_BITS)
        found.append((items, owner + base, extra, owner[more] + base))
        base += part.rows.num_rows
    return Items(*(np.concatenate(x) for x in zip(*found)))


def document_texts(docs: DataFrame, firsts: DataFrame):
    """A function from a table of nodes to their texts; ``firsts`` tells where each is found."""
    def of(nodes: DataFrame) -> DataFrame:
        wanted = write_scratch(firsts.join(nodes, "node", "left_semi").select("node", "_at.*"), "wanted")
        keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"),
                            whole_text().alias("text"))
        on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
        # a repeated row gives its text again
        return small_join(keyed, wanted, on, "inner").select("node", "text").dropDuplicates(["node"])

    return of


def document_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and ``first`` (doc_id, text_key) for each row whose text has words.

    ``first`` is the document that stands for the class: the one with the smallest
    id. A null id comes first, like any value. Texts whose fingerprints meet
    although they differ (told by a second fingerprint) are classes of their own.
    """
    table = document_table(docs)
    nodes = write_scratch(table.groupBy("node").agg(
        F.min("check").alias("_check"), F.min(F.struct("doc_id", "text_key")).alias("_at")), "nodes-of")
    parts = bucket_parts(docs.sparkSession, table.count() * 2 * BANDS)  # as sets and with counts
    pairs = bucket_pairs(document_keys(docs, parts), parts)
    roots = similar_classes(pairs, document_texts(docs, nodes), document_items, THRESHOLD)
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = classed.groupBy("root").agg(F.min("_at").alias("first"))
    stored = write_scratch(classed.join(firsts, "root").select("node", "_check", "first"), "classes")
    own = F.struct("doc_id", "text_key")
    return table.join(stored, "node").select(
        "doc_id", "text_key",
        F.when(F.col("check") == F.col("_check"), F.col("first")).otherwise(own).alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), is_first.

    Null, empty and white texts are no one's copies: each is its own class.
    Repeated rows share a class. An empty table gives an empty table.
    """
    blank = docs.where(~whole_text().rlike(r"[^\x20\x09-\x0D]")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("class_id"),
        F.lit(True).alias("is_first"))
    found = document_classes(docs)
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"),
                        F.struct("doc_id", "text_key").eqNullSafe(F.col("first")).alias("is_first")
                        ).unionByName(blank)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class; columns as they are.

    Rows repeated whole are one document. Documents without words stay.
    """
    classes = document_classes(docs)
    own = F.struct("doc_id", "text_key")
    told = classes.groupBy(F.col("doc_id").alias("_told_id"), F.col("text_key").alias("_told_key")).agg(
        F.min(own.eqNullSafe(F.col("first"))).alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    told = write_scratch(told.where(~F.col("_stays") | (F.col("_rows") > 1)), "near-duplicates")
    on = F.col("_id").eqNullSafe(F.col("_told_id")) & (F.col("_key") == F.col("_told_key"))
    left = small_join(boxed(docs), told, on, "left").where(F.coalesce("_stays", F.lit(True)))
    if not told.where("_stays").isEmpty():  # repeated rows: few, so only they are dealt by key
        turn = F.row_number().over(Window.partitionBy("_id", "_key").orderBy("_key"))
        again = left.where(F.col("_rows").isNotNull()).withColumn("_turn", turn).where("_turn = 1")
        left = left.where(F.col("_rows").isNull()).unionByName(again.drop("_turn"))
    return unboxed(left, docs)
