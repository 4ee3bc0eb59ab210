"""Toxic passages by maximum-scoring segments of token log-odds.

1. Hashed token counts of toxic, clean and all documents give each token a
   log-odds ratio with an informative Dirichlet prior (Monroe et al. 2008).
2. A text is a sequence of these scores less a drift. Its maximal scoring
   segments (Ruzzo and Tompa 1999) are found in one linear scan.
3. Karlin-Altschul statistics turn a segment's score S in a text of n tokens
   into an expected number of chance segments, K n exp(-lambda S). lambda
   follows from the clean tokens, K from the clean training documents.
4. A text's evidence is the sum of -ln of that number over its significant
   segments; a logistic curve over the training documents makes it a score.

Bound: labels come from at most ``TRAIN_ROWS`` labelled documents (least hash of
the id first). The prior covers all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import (
    PUNCTUATION, Hasher, Texts, U, bound_batches, boxed, lowered, separators, text_slices, unboxed, whole_text,
    word_spans,
)
from .similar import small_join

BUCKETS = 1 << 17
TRAIN_ROWS = 50_000
PRIOR_TOKENS = 2_000.0  # weight of the Dirichlet prior
LEAST_Z = 3.0  # log-odds shrink to 0 at this many standard errors
DRIFT = 0.15  # what every token costs
BIN, BINS = 0.25, 1024
SEGMENTS = "struct<n:long,scores:array<double>,starts:array<int>,ends:array<int>>"


class Model(NamedTuple):
    weights: np.ndarray
    scale: float  # lambda
    log_k: float
    intercept: float
    slope: float


def folds(doc_id: str = "doc_id") -> Column:
    """True for rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) of at most ``rows`` training documents; unknown labels are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~folds())
    return (known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


class Tokens:
    """Hash buckets of the words of a slice: ASCII letters lowered, ASCII punctuation apart."""

    def __init__(self) -> None:
        self.hasher, self.lower, self.apart = Hasher(7), lowered(), separators(PUNCTUATION)

    def __call__(self, part: Texts):
        data = self.lower[part.data]
        starts, ends, doc = word_spans(data, part.offsets, self.apart)
        bucket = (self.hasher.spans(data, starts, ends) >> U(13)) % U(BUCKETS)
        return bucket.astype(np.int64), doc, starts, ends


def token_counts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(bucket, n, toxic, clean): occurrences in all, toxic and clean training documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokens(), np.zeros((3, BUCKETS), np.int64)
        for part in text_slices(batches):
            bucket, doc, _, _ = tokens(part)
            label = part.rows.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False)[doc]
            for k, chosen in enumerate((slice(None), label == 1, label == 0)):
                total[k] += np.bincount(bucket[chosen], minlength=BUCKETS)
        seen = np.flatnonzero(total[0])
        for i in range(0, len(seen), 1 << 15):
            at = seen[i:i + (1 << 15)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *[pa.array(total[k][at]) for k in range(3)]],
                ["bucket", "n", "toxic", "clean"])

    flagged = docs.select("doc_id", whole_text().alias("text")).join(
        F.broadcast(train), "doc_id", "left")
    found = flagged.select("text", "toxic").mapInArrow(
        count, "bucket long, n long, toxic long, clean long")
    return found.groupBy("bucket").agg(F.sum("n"), F.sum("toxic"), F.sum("clean"))


def log_odds(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights per bucket and the clean token distribution from (bucket, n, toxic, clean)."""
    table = np.zeros((3, BUCKETS))
    if len(counts):
        table[:, counts[:, 0]] = counts[:, 1:].T
    prior = PRIOR_TOKENS * (table[0] + 0.5) / (table[0] + 0.5).sum()
    toxic, clean = table[1] + prior, table[2] + prior
    delta = np.log(toxic / (toxic.sum() - toxic)) - np.log(clean / (clean.sum() - clean))
    # twice the log-likelihood ratio against one rate for both classes
    both, share = table[1] + table[2], table[1:].sum(1) / max(table[1:].sum(), 1)
    gain = np.zeros(BUCKETS)
    for k in (0, 1):
        seen = table[k + 1] > 0
        gain[seen] += 2 * table[k + 1, seen] * np.log(table[k + 1, seen] / (both[seen] * share[k]))
    return delta * np.maximum(0, 1 - LEAST_Z**2 / np.maximum(gain, 1e-9)), clean / clean.sum()


def karlin_scale(scores: np.ndarray, chance: np.ndarray) -> float:
    """The lambda > 0 at which the mean of exp(lambda score) is 1; 1 if there is none."""
    if (scores * chance).sum() >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    with np.errstate(over="ignore"):
        while (chance * np.exp(high * scores)).sum() < 1:
            high *= 2
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if (chance * np.exp(middle * scores)).sum() < 1 else (low, middle)
    return high


def maximal_segments(gains: list[tuple[int, float, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, in one pass.

    ``gains``: of each positive token its place, and the sums of all scores before
    and up to it. Returns (first, last, score).
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, before, after, lower
    for place, before, after in gains:
        first, below = place, len(stack) - 1
        while True:
            while below >= 0 and stack[below][2] >= before:
                below = stack[below][4]
            if below < 0 or stack[below][3] >= after:
                break
            first, before = stack[below][0], stack[below][2]
            del stack[below:]
            below = len(stack) - 1
        stack.append((first, place, before, after, below))
    return [(first, last, after - before) for first, last, before, after, _ in stack]


def segments_of(part: Texts, tokens: Tokens, weights: np.ndarray):
    """Token counts, and the maximal segments as (text, start, end, score); byte places."""
    bucket, doc, starts, ends = tokens(part)
    n = np.bincount(doc, minlength=part.rows.num_rows)
    score = weights[bucket] - DRIFT
    sums = np.concatenate([[0.0], np.cumsum(score)])
    good = np.flatnonzero(score > 0)
    owner = doc[good]
    found = []
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for group in np.split(good, cuts) if len(good) else []:
        gains = list(zip(group.tolist(), sums[group].tolist(), sums[group + 1].tolist()))
        found += [(int(doc[group[0]]), int(starts[a]), int(ends[b]), s)
                  for a, b, s in maximal_segments(gains)]
    return n, found


def scan(weights: np.ndarray):
    """An Arrow function: text to its token count and maximal segments, in code points."""
    @F.arrow_udf(SEGMENTS)
    def segments(texts: pa.Array) -> pa.Array:
        tokens, out = Tokens(), []
        for part in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), last=False):
            n, found = segments_of(part, tokens, weights)
            rows = [(int(k), [], [], []) for k in n]
            if found:
                points = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                for doc, a, b, s in found:
                    base = points[part.offsets[doc]]
                    rows[doc][1].append(s)
                    rows[doc][2].append(int(points[a] - base))
                    rows[doc][3].append(int(points[b] - base))
            out += rows
        n, scores, starts, ends = zip(*out) if out else ((), (), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.float64())),
             pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
            ["n", "scores", "starts", "ends"])

    return segments


def evidence(found: Column, scale: float, log_k: float) -> Column:
    """Sum of -ln(expected chance segments) over the significant segments."""
    chance = F.lit(log_k) + F.log(F.greatest(found["n"], F.lit(1)))
    return F.aggregate(
        found["scores"], F.lit(0.0),
        lambda total, s: total + F.greatest(F.lit(scale) * s - chance, F.lit(0.0)))


def logistic(bins: list[tuple[int, int, int]]) -> tuple[float, float]:
    """Intercept and slope from (bin, rows, toxic rows), lightly regularised."""
    x = (np.array([b for b, _, _ in bins], float) + 0.5) * BIN
    n, y = (np.array([r[k] for r in bins], float) for k in (1, 2))
    theta = np.array([-2.0, 1.0])
    design = np.stack([np.ones_like(x), x])
    for _ in range(1000):
        p = 1 / (1 + np.exp(-np.clip(theta @ design, -30, 30)))
        slope = design @ (y - n * p) - 0.1 * (theta - [-2.0, 1.0])
        curve = (design * (n * p * (1 - p))) @ design.T + 0.1 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta + np.clip(step, -0.2, 0.2)  # short steps: far ones may swing
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(max(theta[1], 1e-6))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    bound_batches(docs.sparkSession)
    chosen = training_labels(labels, rows)
    counted = token_counts(docs, chosen).collect()  # one row per bucket at most
    weights, chance = log_odds(np.array([tuple(r) for r in counted], np.int64).reshape(-1, 4))
    scale = karlin_scale(weights - DRIFT, chance)
    scanned = write_scratch(
        docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(chosen), "doc_id")
        .select("toxic", scan(weights)("text").alias("found")), "toxicity")
    best = F.coalesce(F.array_max(F.col("found.scores")), F.lit(0.0))
    clean, total = scanned.where("toxic = 0").agg(
        F.count(F.lit(1)), F.sum(F.col("found.n") * F.exp(-scale * best))).first()
    log_k = math.log(clean / total) if clean and total else 0.0
    bins = scanned.groupBy(
        F.least(F.floor(evidence(F.col("found"), scale, log_k) / BIN), F.lit(BINS)).alias("bin")
    ).agg(F.count(F.lit(1)), F.sum("toxic")).collect()
    return Model(weights, scale, log_k, *logistic([tuple(r) for r in bins] or [(0, 0, 0)]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, ``predicted`` and ``passages`` (code points, end exclusive).

    Rows are independent: repeated rows score alike, and null or empty texts get
    the score of no evidence.
    """
    found = docs.withColumn("_found", scan(model.weights)(whole_text()))
    chance = F.lit(model.log_k) + F.log(F.greatest(F.col("_found.n"), F.lit(1)))
    z = evidence(F.col("_found"), model.scale, model.log_k)
    listed = F.arrays_zip(F.col("_found.starts").alias("start"), F.col("_found.ends").alias("end"),
                          F.col("_found.scores").alias("score"))
    return (
        found.withColumn("score", 1 / (1 + F.exp(-(model.intercept + model.slope * z))))
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
        .withColumn("passages", F.filter(listed, lambda s: model.scale * s["score"] > chance))
        .drop("_found")
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", folds().alias("held_out"), "score", "predicted", "passages")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they are."""
    scored = score_documents(boxed(docs).select("_id", "_key", F.col("_text").alias("text")), train(docs, labels))
    gone = write_scratch(scored.where("predicted = 1").select(
        F.col("_id").alias("_gone_id"), F.col("_key").alias("_gone_key")).distinct(), "toxic")
    on = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_key") == F.col("_gone_key"))
    return unboxed(small_join(boxed(docs), gone, on, "left_anti"), docs)
