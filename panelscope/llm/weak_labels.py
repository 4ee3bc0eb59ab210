"""A quality classifier learned from overlapping heuristics, without labels.

1. Heuristic labellers vote good, bad or nothing on every document.
2. Expectation-maximisation over the counted vote patterns estimates how each
   labeller votes on good and on bad documents, and the share of good ones; a
   pattern's posterior is its label. There are at most 3 ** labellers patterns,
   whatever the number of documents.
3. A hashed linear scorer is fitted to the posteriors and scores every document,
   so that it also judges what no heuristic looks at.

Bound: the scorer is fitted on at most ``TRAIN_ROWS`` documents (least hash of the
id first). Votes and their model cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import Hasher, Texts, U, bound_batches, mix, separators, text_key, text_slices, whole_text, word_spans

FEATURES = 1 << 16
TRAIN_ROWS = 8_000
EPOCHS, RATE, SHRINK = 150, 0.5, 1e-5
GOOD, BAD, NONE = 1, 0, 2
SYMBOLS = b"#*$%&|<>"
LABELLERS = ("capitals", "symbols", "shouts", "repeats", "length", "sentences", "word_size", "fragments")


class Statistics(NamedTuple):
    """Per document."""

    words: np.ndarray
    capitals: np.ndarray  # share of ASCII letters
    symbols: np.ndarray  # per word
    shouts: np.ndarray  # share of words that end in two exclamation marks
    repeats: np.ndarray  # share of words equal to the word before
    stops: np.ndarray  # share of words that end in a full stop
    size: np.ndarray  # mean bytes of a word
    fragments: np.ndarray  # share of words of one byte that is no letter


class Words:
    """Word hashes and places of a slice."""

    def __init__(self) -> None:
        self.hasher, self.apart = Hasher(51), separators()
        self.symbol = np.zeros(256, bool)
        self.symbol[list(SYMBOLS)] = True

    def __call__(self, part: Texts):
        starts, ends, doc = word_spans(part.data, part.offsets, self.apart)
        return starts, ends, doc, self.hasher.spans(part.data, starts, ends)


def statistics(part: Texts, words: Words, spans) -> Statistics:
    starts, ends, doc, hashes = spans
    data, n = part.data, part.rows.num_rows
    per = np.bincount(doc, minlength=n)

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[part.offsets[1:]] - sums[part.offsets[:-1]]

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(doc[mask], minlength=n) / np.maximum(per, 1)

    upper, lower = within((data - np.uint8(65)) < 26), within((data - np.uint8(97)) < 26)
    last = data[ends - 1]
    shout = (last == 33) & (data[np.maximum(ends - 2, 0)] == 33) & (ends - starts > 1)
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    single = (ends - starts == 1) & ~(((last | 32) - np.uint8(97)) < 26)
    return Statistics(
        per, upper / np.maximum(upper + lower, 1), within(words.symbol[data]) / np.maximum(per, 1),
        share(shout), share(again), share(last == 46),
        np.bincount(doc, ends - starts, n) / np.maximum(per, 1), share(single))


def votes(s: Statistics) -> np.ndarray:
    """documents x labellers: GOOD, BAD or NONE. Texts without words get no vote but on length."""
    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NONE))

    some = s.words > 0
    long = s.words >= 30
    return np.stack([
        vote(s.capitals > 0.5, some & (s.capitals < 0.25)),
        vote(s.symbols > 0.2, some & (s.symbols < 0.05)),
        vote(s.shouts > 0.1, some & (s.shouts < 0.02)),
        vote(s.repeats > 0.2, long & (s.repeats < 0.05)),
        vote(s.words < 3, s.words >= 20),
        vote(long & (s.stops == 0), long & (s.stops > 0.01) & (s.stops < 0.3)),
        vote(some & ((s.size < 2) | (s.size > 15)), some & (s.size >= 3) & (s.size <= 9)),
        vote(s.fragments > 0.15, some & (s.fragments < 0.05)),
    ], axis=1)


def pattern_codes(voted: np.ndarray) -> np.ndarray:
    return voted @ 3 ** np.arange(voted.shape[1])


def pattern_votes(codes: np.ndarray, labellers: int) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(labellers) % 3


def label_model(codes: np.ndarray, rows: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 300):
    """Expectation-maximisation over vote patterns and how many documents have each.

    Votes are independent given the kind of document: good, or bad in the way one
    labeller was made for. (With a single bad kind, two labellers that see the same
    fault would define it, and other faults would count as good.) The start gives a
    pattern to the labellers that vote bad, or to good; counts are smoothed by one
    document a cell. Returns the shares of the kinds, good first, and
    P(vote | kind) as kind x labeller x vote: a labeller's accuracies.
    """
    voted = pattern_votes(codes, labellers)
    hot = np.eye(3)[voted][:, :, :2]  # pattern x labeller x vote; not voting tells nothing
    bad = (voted == BAD).astype(float)
    member = np.concatenate([np.where(bad.sum(1) > 0, 0.1, 1.0)[None], bad.T], axis=0)
    member /= member.sum(0)
    share, table = None, None
    for _ in range(rounds):
        weight = member * rows
        share = (weight.sum(1) + 1) / (rows.sum() + labellers + 1)
        table = np.einsum("kp,plv->klv", weight, hot) + 1.0
        table /= table.sum(2, keepdims=True)
        new = memberships(voted, share, table)
        if np.abs(new - member).max(initial=0) < 1e-9:
            break
        member = new
    return share, table


def memberships(voted: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """kind x row posteriors."""
    at = np.arange(voted.shape[1])
    told = np.where(voted == NONE, 0.0, np.log(table)[:, at, np.minimum(voted, 1)])
    logs = np.log(share)[:, None] + told.sum(2)
    logs -= logs.max(0)
    out = np.exp(logs)
    return out / out.sum(0)


def posteriors(voted: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Of being good."""
    return memberships(voted, share, table)[0]


def features(part: Texts, spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value): words, word endings and repetitions, at unit length per text."""
    starts, ends, doc, hashes = spans
    data = part.data
    # nothing beyond a word, where another text may be
    more = ends - starts > 1
    ending = data[ends - 1].astype(U) << U(8) | np.where(more, data[np.maximum(ends - 2, 0)], 0).astype(U)
    head = ((data[starts] - np.uint8(65)) < 26).astype(U) + U(2) * (
        more & ((data[np.minimum(starts + 1, len(data) - 1)] - np.uint8(65)) < 26)).astype(U)
    again = np.zeros(len(doc), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    seen = [hashes, mix(ending + U(1 << 32)), mix(head + U(1 << 40)), mix(again.astype(U) + U(1 << 48))]
    bucket = np.concatenate([(x >> U(20)) % U(FEATURES) for x in seen]).astype(np.int64)
    cell, n = np.unique(np.tile(doc, len(seen)) * FEATURES + bucket, return_counts=True)
    owner, value = cell // FEATURES, np.sqrt(n)
    norm = np.sqrt(np.bincount(owner, value * value, part.rows.num_rows))
    return owner, cell % FEATURES, value / norm[owner]


def count_patterns(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = Words(), np.zeros(3 ** len(LABELLERS), np.int64)
        for part in text_slices(batches):
            codes = pattern_codes(votes(statistics(part, words, words(part))))
            total += np.bincount(codes, minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    found = docs.select(whole_text().alias("text")).mapInArrow(count, "code long, n long").groupBy(
        "code").agg(F.sum("n").alias("n")).collect()  # at most 3 ** labellers rows
    return (np.array([r.code for r in found], np.int64), np.array([r.n for r in found], np.int64))


def fit(rows: Iterator[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adagrad; a bounded number of rows."""
    bucket, value, target = [], [], []
    for b, v, t in rows:
        bucket.append(b)
        value.append(v)
        target.append(t)
    weights, bias = np.zeros(FEATURES), 0.0
    if not target:
        return weights, bias
    owner = np.repeat(np.arange(len(target)), [len(b) for b in bucket])
    bucket, value, target = np.concatenate(bucket), np.concatenate(value), np.array(target)
    # both classes count alike, as far as there are any of each
    balance = np.where(target > 0.5, 0.5 / max((target > 0.5).sum(), 1), 0.5 / max((target <= 0.5).sum(), 1))
    seen, bias_seen = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(EPOCHS):
        raw = np.bincount(owner, weights[bucket] * value, len(target)) + bias
        error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - target) * balance
        slope = np.bincount(bucket, error[owner] * value, FEATURES) + SHRINK * weights
        seen += slope * slope
        weights -= RATE * slope / np.sqrt(seen)
        bias_seen += error.sum() ** 2
        bias -= RATE * error.sum() / np.sqrt(bias_seen)
    return weights, float(bias)


def train(docs: DataFrame, share: np.ndarray, table: np.ndarray, rows: int = TRAIN_ROWS):
    ids = (docs.select("doc_id", text_key().alias("_key")).distinct()
           .orderBy(F.xxhash64("doc_id", "_key"), "doc_id", "_key").limit(rows))
    chosen = write_scratch(ids.select(F.col("doc_id").alias("_id"), "_key"), "train-ids")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in text_slices(batches):
            spans = words(part)
            label = posteriors(votes(statistics(part, words, spans)), share, table)
            owner, bucket, value = features(part, spans)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.rows.num_rows))])
            ends = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(label), pa.ListArray.from_arrays(ends, pa.array(bucket.astype(np.int32))),
                 pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
                ["label", "bucket", "value"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for row in range(batch.num_rows):
                    yield (np.array(batch.column("bucket")[row].values), np.array(batch.column("value")[row].values),
                           batch.column("label")[row].as_py())

        weights, bias = fit(each())
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], ["weights", "bias"])

    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key() == F.col("_key"))
    # a repeated row is one row of the sample, so the limit cuts none
    keyed = docs.select("doc_id", whole_text().alias("text"))
    sample = keyed.join(F.broadcast(chosen), on, "left_semi").distinct().select("text")
    rows_of = sample.mapInArrow(featurise, "label double, bucket array<int>, value array<float>")
    learned = rows_of.limit(rows).coalesce(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not learned:
        return np.zeros(FEATURES), 0.0
    return np.frombuffer(learned[0].weights, float), learned[0].bias


def weak_quality(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, votes, posterior, score, predicted, kept.

    ``votes`` has a letter per labeller: g, b or -. Null and empty texts are judged by
    their length alone. Repeated rows are judged alike. An empty table gives an
    empty table.
    """
    bound_batches(docs.sparkSession)
    codes, counted = count_patterns(docs)
    share, table = label_model(codes, counted)
    weights, bias = train(docs, share, table, rows)
    letters = np.array(["b", "g", "-"])

    @F.arrow_udf("struct<votes:string,posterior:double,score:double>")
    def judge(texts: pa.Array) -> pa.Array:
        words, out = Words(), []
        for part in text_slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), last=False):
            spans = words(part)
            voted = votes(statistics(part, words, spans))
            owner, bucket, value = features(part, spans)
            raw = np.bincount(owner, weights[bucket] * value, part.rows.num_rows) + bias
            out.append(pa.StructArray.from_arrays(
                [pa.array(["".join(x) for x in letters[voted]], pa.string()),
                 pa.array(posteriors(voted, share, table)),
                 pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], ["votes", "posterior", "score"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct(
            [("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64())]))

    judged = docs.select("doc_id", judge(whole_text()).alias("j")).select("doc_id", "j.*")
    return judged.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn(
        "kept", F.col("score") >= 0.5)
