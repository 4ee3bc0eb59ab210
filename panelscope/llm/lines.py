"""Fuzzy line de-duplication by MinHash over character shingles.

Every line that has a word takes part. Equal lines meet by fingerprint;
different ones by banded one-permutation MinHash signatures (empty bins borrow
from hashed others) and an exact Jaccard check of their shingles. One line of each
component stays: the first by document and line number.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import (
    U, bound_batches, boxed, groups, mix, sorted_sets, text_key, text_slices, unboxed, whole_text, words_pattern,
)
from .similar import PACKED, Items, bucket_pairs, bucket_parts, keyed_batch, similar_classes, small_join

SHINGLE = 7  # characters
BANDS, ROWS = 20, 4  # a pair of similarity 0.8 shares a band with probability 0.99997
SLICE = 1 << 18  # bytes of text whose arrays stay in cache
THRESHOLD = 0.8
MIN_WORDS = 1  # words of a line that takes part


class Letters(NamedTuple):
    """The code points of a slice and where its texts start and end."""

    points: np.ndarray
    offsets: np.ndarray


def letters_of(texts: pa.Array) -> Letters:
    held = pc.fill_null(texts, "")
    lengths = pc.utf8_length(held).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(held.to_pylist()).encode("utf-32-le"), np.uint32)
    return Letters(points, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]))


class Lines(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    number: np.ndarray


def lines_of(letters: Letters, min_words: int) -> Lines:
    """The lines that take part."""
    points, offsets = letters
    n = len(offsets) - 1
    breaks = np.flatnonzero(points == 10)
    per = np.searchsorted(breaks, offsets)  # a text of k breaks has k + 1 lines
    doc = np.repeat(np.arange(n), np.diff(per) + 1)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    number = np.arange(len(doc)) - (per[:-1] + np.arange(n))[doc]
    white = (points == 32) | (points - np.uint32(9) < 5)
    first = np.empty(len(points), bool)
    first[:1] = True
    first[1:] = white[:-1]
    first[offsets[:-1][offsets[:-1] < len(points)]] = True
    words = np.concatenate([[0], np.cumsum(first & ~white, dtype=np.int32)])
    chosen = words[ends] - words[starts] >= min_words
    return Lines(starts[chosen], ends[chosen], doc[chosen], number[chosen])


class LineHasher:
    """Fingerprints of lines and hashes of their runs of characters."""

    ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self) -> None:
        self.powers = [np.ones(1, U) for _ in self.ODD]
        self.back = [np.ones(1, U) for _ in self.ODD]

    def prints(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """Fingerprints of lines; ``points`` may be 64-bit numbers already."""
        out = np.empty(len(starts), np.int64)
        for i, j in groups(starts, ends, SLICE):
            low = starts[i]
            out[i:j] = self._prints(points[low:ends[j - 1]], starts[i:j] - low, ends[i:j] - low, which)
        return out

    def _prints(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        if len(self.powers[which]) <= len(points):
            for table, base in ((self.powers, self.ODD[which]), (self.back, pow(self.ODD[which], -1, 1 << 64))):
                table[which] = np.concatenate([np.ones(1, U), np.cumprod(np.full(len(points), U(base)))])
        sums = np.zeros(len(points) + 1, U)
        np.cumsum((points + points.dtype.type(1)) * self.powers[which][:len(points)], out=sums[1:])
        total = (sums[ends] - sums[starts]) * self.back[which][starts]
        return mix(total + (ends - starts).astype(U)).astype(np.int64)

    def runs(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = SHINGLE):
        """Hashes of all runs of ``size`` characters, and the line each is in.

        A shorter line has one shingle, itself.
        """
        n = np.maximum(ends - starts - size + 1, 0)
        line = np.repeat(np.arange(len(starts)), n)
        # runs of every place of the slice, by doubling
        width, base, total = 1, U(self.ODD[0]), (points + np.uint32(1)) * U(self.ODD[1])
        ones = total
        while width * 2 <= size:
            total = total[:-width] + total[width:] * base**U(width) if len(total) > width else total[:0]
            width *= 2
        for k in range(width, size):
            m = min(len(total), max(len(ones) - k, 0))
            total = total[:m] + ones[k:k + m] * base**U(k)
        at = np.zeros(len(points), bool)
        edge = np.zeros(len(points) + 1, np.int8)
        edge[starts[n > 0]] += 1
        edge[(starts + n)[n > 0]] -= 1
        np.cumsum(edge[:-1], out=edge[:-1])
        at = edge[:len(total)] > 0
        total = total[at]
        total ^= total >> U(32)
        total *= U(0xD6E8FEB86659FD93)
        total ^= total >> U(29)
        short = np.flatnonzero(n == 0)
        if len(short):
            own = self.prints(points, starts[short], ends[short], 1).astype(U)
            total, line = np.concatenate([total, own]), np.concatenate([line, short])
            order = np.argsort(line, kind="stable")
            total, line = total[order], line[order]
        return total, line


def minhash(hashes: np.ndarray, owner: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures by one permutation, its range cut into k bins."""
    cell = owner * k + ((hashes >> U(32)) * U(k) >> U(32)).astype(np.int64)
    empty = np.uint32(0xFFFFFFFF)
    table = np.full(n * k, empty, np.uint32)
    low = hashes.astype(np.uint32) & np.uint32(0x7FFFFFFF)
    np.minimum.at(table, cell, low)
    # all bins of a short line would borrow from the only one that is filled
    alone = (np.bincount(owner, minlength=n) == 1)[owner]
    table.reshape(n, k)[owner[alone]] = low[alone, None]
    open_cells, source, attempt = np.flatnonzero(table == empty), table.copy(), 0
    while len(open_cells):
        attempt += 1
        lane = (mix((open_cells % k).astype(U) + U(attempt * 1_000_003)) % U(k)).astype(np.int64)
        found = table[open_cells // k * k + lane]
        source[open_cells] = found
        open_cells = open_cells[found == empty]
    return source.reshape(n, k)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys; a key holds its band's number."""
    grouped = signature.reshape(len(signature), bands, rows).astype(U)
    total = np.broadcast_to(np.arange(bands, dtype=U) * U(0x9E3779B97F4A7C15), grouped.shape[:2])
    for r in range(rows):
        total = mix(total + grouped[:, :, r])
    return total.astype(np.int64)


def line_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, line_no, node, check) of the lines that take part, stored."""
    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = LineHasher()
        for part in text_slices(batches, limit=SLICE):
            letters = letters_of(part.rows.column("text"))
            starts, ends, doc, number = lines_of(letters, min_words)
            node, check = (hasher.prints(letters.points, starts, ends, k) for k in (0, 1))
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id").take(at), part.rows.column("text_key").take(at),
                 pa.array(number.astype(np.int32)), pa.array(node), pa.array(check)],
                ["doc_id", "text_key", "line_no", "node", "check"])

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"),
                       text_key().alias("text_key"))
    return write_scratch(rows.mapInArrow(
        table, "doc_id long, text_key long, line_no int, node long, check long"), "lines")


def line_keys(docs: DataFrame, parts: int, min_words: int = MIN_WORDS) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = LineHasher()
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for part in text_slices(iter([batch]), limit=SLICE, last=False):
                letters = letters_of(part.rows.column("text"))
                starts, ends, _, _ = lines_of(letters, min_words)
                node = hasher.prints(letters.points, starts, ends, 0)
                _, once = np.unique(node, return_index=True)
                once.sort()
                starts, ends, node = starts[once], ends[once], node[once]
                for i, j in groups(starts, ends, SLICE):
                    low = starts[i]
                    hashes, line = hasher.runs(letters.points[low:ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
                    signature = minhash(hashes, line, j - i, BANDS * ROWS)
                    found.append((band_keys(signature, BANDS, ROWS).ravel(), np.repeat(node[i:j], BANDS)))
            if found:
                yield keyed_batch(*(np.concatenate(x) for x in zip(*found)), parts)

    return docs.select(whole_text().alias("text")).mapInArrow(keys, PACKED)


def line_items(texts: pa.Array) -> Items:
    """The distinct runs of characters of lines."""
    letters = letters_of(texts)
    hashes, line = LineHasher().runs(letters.points, letters.offsets[:-1], letters.offsets[1:])
    items, owner, _ = sorted_sets(hashes, line)
    return Items(items, owner, items[:0], owner[:0])


def line_texts(docs: DataFrame, firsts: DataFrame):
    """A function from a table of nodes to their texts; ``firsts`` tells where each is found."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, found = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                split = text.split("\n")
                nodes += [w["node"] for w in wanted]
                found += [split[w["line_no"]] for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(found, pa.string())],
                                             ["node", "text"])

    def of(nodes: DataFrame) -> DataFrame:
        wanted = write_scratch(
            firsts.join(nodes, "node", "left_semi").groupBy("_at.doc_id", "_at.text_key").agg(
                F.collect_list(F.struct("_at.line_no", "node")).alias("wanted")), "wanted")
        keyed = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"),
                            whole_text().alias("text"))
        on = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))
        held = small_join(keyed, wanted, on, "inner", F.size("wanted")).select("text", "wanted")
        # a repeated row gives its texts again
        return held.mapInArrow(texts, "node long, text string").dropDuplicates(["node"])

    return of


def line_classes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line that takes part: doc_id, text_key, line_no, first, kept.

    ``first`` is the (doc_id, text_key, line_no) of the line that stays for its
    class. Null texts have no lines. Rows repeated whole stand or fall together, as
    their lines are the same lines. A null doc_id is a value like any other and
    comes first. Lines whose fingerprints meet although they differ (told by a
    second fingerprint) stay.
    """
    lines = line_table(docs, min_words)
    # combined before it is moved: a line with a third of all rows is no hot spot
    nodes = write_scratch(lines.groupBy("node").agg(
        F.min("check").alias("_check"), F.min(F.struct("doc_id", "text_key", "line_no")).alias("_at")), "line-nodes")
    parts = bucket_parts(docs.sparkSession, lines.count() * BANDS)
    pairs = bucket_pairs(line_keys(docs, parts, min_words), parts)
    roots = similar_classes(pairs, line_texts(docs, nodes), line_items, THRESHOLD)
    classed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = classed.groupBy("root").agg(F.min("_at").alias("first"))
    table = write_scratch(classed.join(firsts, "root").select("node", "_check", "first"), "line-classes")
    own = F.struct("doc_id", "text_key", "line_no")
    joined = lines.join(table, "node").withColumn(
        "first", F.when(F.col("check") == F.col("_check"), F.col("first")).otherwise(own))
    return joined.select("doc_id", "text_key", "line_no", "first",
                         own.eqNullSafe(F.col("first")).alias("kept"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the lines that repeat another one.

    ``n_chars`` follows the text. Documents that lose all their words go; documents
    without words stay as they are, as do columns not named here.
    """
    gone = write_scratch(
        line_classes(docs, min_words).where(~F.col("kept"))
        .groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key"))
        .agg(F.collect_set("line_no").alias("_gone")), "gone-lines")
    on = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key"))
    joined = small_join(boxed(docs), gone, on, "left", F.size("_gone"))
    touched, row = F.col("_gone").isNotNull(), F.col("_row")
    split = joined.withColumn("_lines", F.when(touched, F.split("_text", "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    cut = split.withColumn("_text", F.when(touched, left).otherwise(row.getField("text"))).where(
        ~touched | F.col("_text").rlike(words_pattern()))
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(touched, F.length("_text")).otherwise(row.getField("n_chars")).cast(
            docs.schema["n_chars"].dataType)
    return unboxed(cut, docs, **changed)
