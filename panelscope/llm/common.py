"""Text helpers shared by the corpus operators.

Texts reach Python workers as Arrow batches. They are cut into slices of bounded
bytes and handled as byte arrays, so memory per worker does not grow with the
table, and no Python code runs per row or word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
BATCH_BYTES = 16 << 20
WHITE = bytes([32, 9, 10, 11, 12, 13])
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower Spark's bound on the bytes of an Arrow batch, if it allows more.

    JVM and Python hold a batch or two of every running task.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def whole_text(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def text_key(text: str = "text") -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(whole_text(text))


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text, and the whole row as ``_row``: no column can clash then."""
    return docs.select(
        F.col("doc_id").cast("long").alias("_id"), text_key().alias("_key"), whole_text().alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unboxed(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``_row``, some of them changed."""
    return rows.select(*[
        changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def words_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


class Texts(NamedTuple):
    rows: pa.RecordBatch
    data: np.ndarray  # bytes of all texts of the slice
    offsets: np.ndarray  # where each text starts, and the end


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, last: bool = True
) -> Iterator[Texts]:
    """Slices of about ``limit`` bytes of text; a longer text is a slice of its own.

    Memory that is free at the end goes back to the system, if this is the ``last`` text
    of a task: workers are kept, and one that grew would stay as large.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column).fill_null("")
        wide = pa.types.is_large_string(texts.type)
        _, ends, data = texts.buffers()
        offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
        offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
            j = min(max(j, i + 1), len(texts))
            yield Texts(batch.slice(i, j - i), held[offsets[i]:offsets[j]],
                        offsets[i:j + 1] - offsets[i])
            i = j
        del batch, texts, ends, data, offsets, held
    if last:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system; what a worker keeps counts as long as it lives."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)


def groups(starts: np.ndarray, ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of spans in order that lie within ``limit`` places; a longer span is alone."""
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        yield i, j
        i = j


class Hasher:
    """64-bit hashes of substrings through prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 1):
        self.values, self.powers, self.back = byte_values(seed), np.ones(1, U), np.ones(1, U)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SLICE_BYTES + 1)
            base = U(self.BASE)
            inverse = U(pow(self.BASE, -1, 1 << 64))
            self.powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, base))])
            self.back = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, inverse))])

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of spans in order, apart from each other; those of a long text some at a time."""
        if len(data) <= 2 * SLICE_BYTES:
            return self._spans(data, starts, ends)
        out = np.empty(len(starts), U)
        for i, j in groups(starts, ends, SLICE_BYTES):
            out[i:j] = self._spans(data[starts[i]:ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i])
        return out

    def _spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, U)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(U))


def separators(extra: bytes = b"") -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(WHITE + extra)] = True
    return table


def lowered() -> np.ndarray:
    """Bytes with ASCII letters in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def word_spans(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of bytes that ``apart`` does not mark."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~apart[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def counts_per(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def shingles(
    hashes: np.ndarray, doc: np.ndarray, n: int, size: int = 5
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all runs of ``size`` words.

    A text of fewer words has one shingle of all its words, one without words none.
    """
    per = counts_per(doc, n)
    factors = [pow(Hasher.BASE | 1, 3 * k + 1, 1 << 64) for k in range(size)]
    m = len(hashes) - size + 1
    out, owner = np.zeros(0, U), np.zeros(0, np.int64)
    if m > 0:
        total = hashes[:m] * U(factors[0])
        for k in range(1, size):
            total += hashes[k:m + k] * U(factors[k])
        whole = doc[:m] == doc[size - 1:]
        out, owner = mix(total[whole]), doc[:m][whole]
    short = np.flatnonzero((per > 0) & (per < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(per)])
        extra = [mix(np.array([sum(int(h) * f for h, f in zip(hashes[at[d]:at[d + 1]], factors))
                               + int(per[d]) & (1 << 64) - 1], U))[0] for d in short]
        out, owner = np.concatenate([out, np.array(extra, U)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner


def word_runs(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all runs of ``size`` words, which are those of texts of so few words."""
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.full(m, size, U)
    for k in range(size):
        total += hashes[k:m + k] * U(pow(Hasher.BASE | 1, 3 * k + 1, 1 << 64))
    whole = doc[:m] == doc[size - 1:]
    return mix(total[whole]), doc[:m][whole]


def distinct_per(
    values: np.ndarray, doc: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs with their counts, ordered by text."""
    keyed = mix(values ^ mix(doc.astype(U) + U(0x51ED2701)))
    _, at, n = np.unique(keyed, return_index=True, return_counts=True)
    order = np.argsort(at)
    at, n = at[order], n[order]
    return values[at], doc[at], n


OWNER_BITS = 20


def sorted_sets(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs and their counts, by text; values keep 44 of their bits.

    For comparing the sets of a few texts: 44 bits tell apart the items of any two.
    Sorting one number for each pair is several times faster than ``distinct_per``.
    """
    if len(doc) and int(doc.max()) >> OWNER_BITS:
        raise ValueError(f"a slice holds at most {1 << OWNER_BITS} texts")
    keyed = np.sort(doc.astype(U) << U(64 - OWNER_BITS) | values >> U(OWNER_BITS))
    new = np.ones(len(keyed), bool)
    new[1:] = keyed[1:] != keyed[:-1]
    at = np.flatnonzero(new)
    keyed = keyed[at]
    n = np.diff(at, append=len(new))
    return keyed & U((1 << 64 - OWNER_BITS) - 1), (keyed >> U(64 - OWNER_BITS)).astype(np.int64), n


def list_column(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list per text from values ordered by text."""
    ends = np.concatenate([[0], np.cumsum(counts_per(doc, n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))
