"""Runs of periodic words by longest common extensions.

Suffix trees (Ukkonen) of the words and of their reversal answer in constant time,
by an Euler tour and range minima, how far two places agree to the right and to the
left. Every run has a Lyndon root that is the longest Lyndon word at its place under
the order of words or under its reversal; these candidates, one a place and order,
are extended both ways and are runs if they reach twice their period.

Trees are built for the stretches of a document that can hold a run: a run of at
least 12 words repeats six-word windows at its period, so words without linked
windows close enough are passed over. Stretches above ``TREE_WORDS`` words get the
same answers from prefix hashes, in memory linear in their length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, bound_batches, mix, text_slices, whole_text
from .suffix_tree import HashedSuffixes, SuffixTree

LEAST = 12  # words of a run
WINDOW = 6  # LEAST / 2: a run of period q repeats max(LEAST - q, q) words at distance q
TREE_WORDS = 1 << 17
PIECE = 1 << 20  # bytes of a text whose words are split at once
KEPT_WORDS = 1 << 20  # different words whose numbers are kept from text to text
COLUMNS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")
WHITE = re.compile(rb"[\x20\x09-\x0D]")

Runs = np.ndarray  # rows of start, length, period


def smaller_after(rank) -> np.ndarray:
    """For each place the next one of lower rank: where the longest Lyndon word ends."""
    n = len(rank)
    after = array("q", bytes(8 * n))
    for i in range(n - 1, -1, -1):
        j, r = i + 1, rank[i]
        while j < n and rank[j] > r:
            j = after[j]
        after[i] = j
    return np.frombuffer(after, np.int64)


def runs_of(words: np.ndarray, least: int = LEAST, tree_words: int = TREE_WORDS) -> Runs:
    """All maximal runs of numbered words (from 0) with length >= max(least, 2 * period), by start, then period."""
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    _, symbols = np.unique(words, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    kind = SuffixTree if n <= tree_words else HashedSuffixes
    forth, back = kind(symbols), kind(symbols[::-1])
    found = []
    for backward in (False, True):
        i, j = np.arange(n), smaller_after(forth.ranks(backward))[:n]
        right, left = forth.common(i, j), back.common(n - i, n - j)
        period = j - i
        true = left + right >= period
        found.append(np.stack([i - left, period + left + right, period], axis=1)[true].astype(np.int64))
    runs = np.unique(np.concatenate(found), axis=0)[:, [0, 1, 2]]
    runs = runs[runs[:, 1] >= least]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(words: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Parts of the words that hold every run of ``2 * window`` words or more, with a word beside it.

    In a run of period q and length L, L - q - window + 1 >= q - window + 1 windows in
    a row occur again within q words. So runs start where windows in a row have a next
    occurrence, and reach no further than these windows' number and twice the window.
    """
    n = len(words)
    m = n - window + 1
    if m < 2:
        return []
    mixed, total = mix(words.astype(U) + U(1)), np.zeros(m, U)
    for k in range(window):
        total += mixed[k:k + m] * U(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
    ordered = np.sort(total)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    distance = np.zeros(m, np.int64)
    distance[order[:-1][same]] = (order[1:] - order[:-1])[same]
    linked = np.concatenate([[0], (distance > 0).astype(np.int8), [0]])
    first, last = np.flatnonzero(np.diff(linked) == 1), np.flatnonzero(np.diff(linked) == -1)
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), last.tolist()):
        reach = b - a + window - 1  # the largest period these windows allow
        near = np.flatnonzero(distance[a:b] <= reach)
        if not len(near):
            continue
        low, high = max(a - 1, 0), min(b + reach + window + 1, n)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def document_runs(words: np.ndarray, tree_words: int = TREE_WORDS) -> Runs:
    found = []
    for low, high in stretches(words):
        runs = runs_of(words[low:high], LEAST, tree_words)
        runs[:, 0] += low
        found.append(runs)
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def kept_words(n: int, runs: Runs) -> np.ndarray:
    """Marks the words that no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


class Words:
    """Numbers of the different words of texts."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.held: list[bytes] = []

    def __call__(self, text: bytes) -> np.ndarray:
        if len(self.number) > KEPT_WORDS:
            self.__init__()
        out, at = array("q"), 0
        number, held = self.number, self.held
        while at < len(text):
            gap = WHITE.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = gap.start() if gap else len(text)
            for word in text[at:end].split():
                k = number.get(word)
                if k is None:
                    k = number[word] = len(held)
                    held.append(word)
                out.append(k)
            at = end
        return np.frombuffer(out, np.int64) if out else np.zeros(0, np.int64)

    def joined(self, chosen: np.ndarray) -> str:
        """Digest of the words joined by one space."""
        digest, held = hashlib.sha256(), self.held
        for at in range(0, len(chosen), PIECE):
            digest.update((b" " if at else b"") + b" ".join([held[k] for k in chosen[at:at + PIECE].tolist()]))
        return digest.hexdigest()


Plant = Callable[[object, np.ndarray], np.ndarray]


def as_given(doc_id, words: np.ndarray) -> np.ndarray:
    return words


def planted(doc_id: int | None, words: np.ndarray) -> np.ndarray:
    """Words of a tenth of all ids, told by a checksum, repeat from some word on; a null id has none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return words[np.where(at >= a, a + (at - a) % p, at)]


def periodic_runs(docs: DataFrame, plant: Plant = as_given, tree_words: int = TREE_WORDS) -> DataFrame:
    """One row per document: the number of its runs, the longest one, digests of all runs and of the words left.

    Null, empty and blank texts have no words, no runs and the digests of nothing.
    Repeated rows have a row each; a null id is carried. Ties for the longest run go
    to the least start, then period. Texts are read whole, one at a time. An empty
    table gives an empty table; other columns are not read. ``plant`` may change the
    numbered words of an id before the search.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in text_slices(batches, limit=1 << 22):
            rows = []
            for i, doc_id in enumerate(part.rows.column("doc_id").to_pylist()):
                held = plant(doc_id, words(part.data[part.offsets[i]:part.offsets[i + 1]].tobytes()))
                runs = document_runs(held, tree_words)
                kept = held[kept_words(len(held), runs)] if len(runs) else held
                best = [None] * 4
                if len(runs):
                    s, n, q = max(runs.tolist(), key=lambda r: (r[1], -r[0], -r[2]))
                    best = [s, n, q, 1000 * n // q]
                told = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
                rows.append([doc_id, len(runs), *best, hashlib.sha256(told.encode()).hexdigest(), words.joined(kept)])
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in COLUMNS.split(", ")])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(found, COLUMNS)
