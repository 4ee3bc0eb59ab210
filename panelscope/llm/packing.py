"""Packing along a space-filling curve.

1. Every document's hashed word counts, at unit length, are projected to a few
   dimensions by fixed random directions.
2. The coordinates, scaled by their corpus mean and deviation, give a cell of a
   grid and its place on the Hilbert curve. Ties, such as copies, are ordered by a
   hash of the id, so a group of copies can be cut anywhere.
3. Quantiles of that order cut the corpus into runs. Documents are tokenised once,
   dealt to runs, sorted along the curve and packed by filling one sequence after
   the other. What is left at the end of a run is written as sequences whose
   lengths are powers of two, so no token of padding is needed.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import Hasher, U, bound_batches, mix, separators, text_slices, whole_text, word_spans

LENGTH = 2048
END_ID = 1
DIMENSIONS, GRID_BITS, TIE_BITS = 4, 12, 15
VECTOR = 256  # buckets of the hashed word counts
SPAN = 2.5  # deviations either side of the mean that the grid covers
LONG_TEXT = 1 << 20
WEIGHT = 4096
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


class Projection:
    """Coordinates of the texts of a slice; texts without words are at 0."""

    def __init__(self) -> None:
        self.hasher, self.apart = Hasher(41), separators()
        self.directions = np.random.default_rng(42).standard_normal((VECTOR, DIMENSIONS))

    def __call__(self, part) -> np.ndarray:
        starts, ends, doc = word_spans(part.data, part.offsets, self.apart)
        bucket = (self.hasher.spans(part.data, starts, ends) % U(VECTOR)).astype(np.int64)
        n = part.rows.num_rows
        counts = np.bincount(doc * VECTOR + bucket, minlength=n * VECTOR).reshape(n, VECTOR)
        length = np.sqrt((counts * counts).sum(axis=1))
        return counts @ self.directions / np.maximum(length, 1)[:, None]


def hilbert_place(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid cells (one row each), after Skilling (2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    x ^= turn
    place = np.zeros_like(turn)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << 1 | (x[i] >> b & 1)
    return place


def curve_order(points: np.ndarray, ids: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    size = 1 << GRID_BITS
    scaled = (points - mean) / np.where(deviation > 0, deviation, 1) / (2 * SPAN) + 0.5
    cells = np.clip(np.floor(scaled * size), 0, size - 1)
    tie = (mix(ids.astype(U) + U(1)) >> U(64 - TIE_BITS)).astype(np.int64)
    return hilbert_place(cells, GRID_BITS) << TIE_BITS | tie


def project(docs: DataFrame) -> DataFrame:
    """(doc_id, point, size): where every document lies and its bytes, stored."""
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection = Projection()
        for part in text_slices(batches):
            flat = pa.array(projection(part).ravel())
            ends = pa.array(np.arange(part.rows.num_rows + 1, dtype=np.int32) * DIMENSIONS)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), pa.ListArray.from_arrays(ends, flat), pa.array(np.diff(part.offsets))],
                ["doc_id", "point", "size"])

    chosen = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return write_scratch(chosen.mapInArrow(points, "doc_id long, point array<double>, size long"), "points")


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def run_bounds(points: DataFrame, mean: np.ndarray, deviation: np.ndarray, runs: int) -> np.ndarray:
    """Curve places that cut the documents into ``runs`` parts of about equal size.

    A document counts once for each ``WEIGHT`` bytes begun: long documents lie close
    together on the curve.
    """
    def orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("point").flatten().to_numpy().reshape(-1, DIMENSIONS)
            place = curve_order(at, _ids(batch.column("doc_id")), mean, deviation)
            times = 1 + batch.column("size").to_numpy() // WEIGHT
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(place, times))], ["place"])

    shares = [i / runs for i in range(1, runs)]
    if not shares:
        return np.zeros(0, np.int64)
    found = points.mapInArrow(orders, "place long").agg(
        F.percentile_approx("place", shares, max(10_000, 20 * runs))).first()[0]
    return np.array(found or [], np.int64)


# where no token reaches across: after a line break between words, before a blank between words
CUT = re.compile(r"(?<=[^\s]\n)(?=[^\s])|(?<=[^\s])(?= [^\s])")
# white space as the vocabulary's pattern knows it; longer runs are beyond what its matcher holds
WHITE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def text_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """A long text cut where no token reaches across."""
    out, at = [], 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if found is None:
            break
        out.append(text[at:found.start()])
        at = found.start()
    return [*out, text[at:]]


def added_tokens(vocabulary_path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file, which it finds inside text."""
    with open(vocabulary_path, encoding="utf-8") as held:
        listed = json.load(held)["added_tokens"]
    for token in listed:
        if token["content"].split() != [token["content"]] or any(token[x] for x in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"no plain added token: {token}")  # a text is cut at white space
    return {token["content"]: token["id"] for token in listed}


def encoder(ranks_path: str, pattern: str, special: dict[str, int] | None = None):
    """Text to ids by a byte-level vocabulary of (token, id) lines; ``special`` tokens are found inside text."""
    import tiktoken

    special = special or {}
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(number) for token, number in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(part: str) -> list[int]:
        if any(token in part for token in special):
            return encoding.encode(part, allowed_special="all")
        return encoding.encode_ordinary(part)

    def pieces(text: str) -> Iterator[list[int]]:
        at = 0
        for run in WHITE_RUN.finditer(text):
            start, end = run.span()
            # the pattern leaves the last blank to what follows, but for an added token
            if end < len(text) and not any(text.startswith(token, end) for token in special):
                end -= 1
            yield from (ids(part) for part in text_parts(text[at:start]))
            yield encoding._encode_single_piece(text[start:end])
            at = end
        yield from (ids(part) for part in text_parts(text[at:]))

    def encode(text: str) -> np.ndarray:
        return np.concatenate([*[np.array(part, np.uint32) for part in pieces(text)], np.array([END_ID], np.uint32)])

    return encode


def tail_lengths(tokens: int) -> list[int]:
    """``tokens`` as powers of two, largest first."""
    return [1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1]


class Packer:
    """Fills sequences of a run one after the other."""

    def __init__(self, run: int, length: int):
        self.run, self.length, self.number = run, length, 0
        self.waiting: list[tuple[int | None, int, int, np.ndarray]] = []  # pieces of the open sequence
        self.filled = 0
        self.done: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(len(ids) - at, self.length - self.filled)
            self.waiting.append((doc_id, at, len(ids), ids[at:at + take]))
            self.filled += take
            at += take
            if self.filled == self.length:
                self._close([self.length])

    def _close(self, lengths: list[int]) -> None:
        """Write the waiting pieces as sequences of the given lengths."""
        room, offset, todo = list(lengths), 0, self.waiting[::-1]
        while todo:
            doc_id, start, total, ids = todo.pop()
            take = min(len(ids), room[0] - offset)
            crc = zlib.crc32(ids[:take].astype("<u4").tobytes())
            self.done.append((doc_id, start, take, crc, total, (self.run << 40) + self.number, offset))
            offset += take
            if take < len(ids):
                todo.append((doc_id, start + take, total, ids[take:]))
            if offset == room[0]:
                room.pop(0)
                offset = 0
                self.number += 1
        self.waiting, self.filled = [], 0

    def finish(self) -> None:
        if self.filled:
            self._close(tail_lengths(self.filled))

    def rows(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECES.split(", ")]
        columns = list(zip(*self.done)) or [()] * len(names)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(
    docs: DataFrame, ranks_path: str, pattern: str, length: int = LENGTH, runs: int | None = None,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of all documents along the curve.

    Null and empty texts are the end id alone. Repeated rows are packed as often as
    they occur; a null id is carried. Other columns are not. An empty table gives an
    empty table. ``length`` is a power of two. ``special`` tokens are found inside text.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    runs = runs or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = project(docs)
    moments = points.agg(*[f(F.col("point")[i]) for f in (F.avg, F.stddev_pop) for i in range(DIMENSIONS)]).first()
    mean, deviation = (np.array([x or 0.0 for x in moments[a:a + DIMENSIONS]]) for a in (0, DIMENSIONS))
    bounds = run_bounds(points, mean, deviation, runs)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        projection, encode = Projection(), encoder(ranks_path, pattern, special)
        for part in text_slices(batches):
            place = curve_order(projection(part), _ids(part.rows.column("doc_id")), mean, deviation)
            held = [encode(t or "").astype("<u2" if small_ids else "<u4").tobytes()
                    for t in part.rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.searchsorted(bounds, place, "right").astype(np.int32)), pa.array(place),
                 part.rows.column("doc_id"), pa.array(held, pa.binary())],
                ["run", "place", "doc_id", "ids"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for batch in batches:
            for run, doc_id, ids in zip(*(batch.column(c).to_pylist() for c in ("run", "doc_id", "ids"))):
                if packer is None or packer.run != run:
                    if packer is not None:
                        packer.finish()
                        yield packer.rows()
                    packer = Packer(run, length)
                packer.add(doc_id, np.frombuffer(ids, "<u2" if small_ids else "<u4"))
            if packer is not None:
                yield packer.rows()
        if packer is not None:
            packer.finish()
            yield packer.rows()

    small_ids = max([vocabulary_size(ranks_path), *(1 + i for i in (special or {}).values())]) <= 1 << 16
    chosen = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    tokens = chosen.mapInArrow(tokenise, "run int, place long, doc_id long, ids binary")
    dealt = tokens.repartitionById(runs, "run").sortWithinPartitions("run", "place", "doc_id")
    return dealt.mapInArrow(fill, PIECES)


def vocabulary_size(ranks_path: str) -> int:
    with open(ranks_path, "rb") as lines:
        return 1 + max(int(line.split()[1]) for line in lines)
