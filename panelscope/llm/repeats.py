"""Passages that occur more than once, by the interval tree of enhanced suffix arrays.

1. Every ``LEAST``-byte string has an anchor: its least hashed ``GRAM``-byte substring.
   The starts that share an anchor are a window of a text, cut so that it holds the
   ``LEAST`` bytes from each of its starts. Equal strings have equal anchors, so all
   occurrences of a string meet under one anchor hash, and lie in windows of that hash.
2. Anchors that occur once are dropped, equal windows are one window. Anchors with a
   single window that occurs often need no more; only the others' texts are read again.
3. The suffixes at the starts of an anchor's windows are sorted, with the lengths that
   neighbours have in common. A stack scan of these lengths gives the common-prefix
   intervals; an interval whose occurrences are preceded by different bytes, or by the
   border of a window, is a maximal repeat of the windows, with all its occurrences.
4. ``maximal_repeats`` joins repeats that go on from window to window with the same
   occurrences, moved by one distance.

Windows overlap by ``LEAST`` - 1 bytes, so every repeated string lies whole in one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_scratch
from .common import U, bound_batches, byte_values, give_back, mix, text_slices, whole_text
from .similar import small_join

LEAST = 400  # bytes of a repeat
GRAM = 100  # bytes of an anchor
BLOCK_BITS = 20  # a text is searched for anchors in blocks of half so many bytes
CHUNK = 1 << 18  # bytes of windows whose suffixes are sorted together; an anchor's windows are never parted
HOT = 1024  # an anchor with more different windows is searched start by start, by counting
SUFFIXES = 1 << 11  # suffixes whose bytes beyond LEAST are sorted at once
ANCHORS = "key long, check long, gram long, window long, first int, n int"
TEXT = ["key", "check"]


class Rolling:
    """Hashes of byte ranges through prefix sums of a polynomial."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 61):
        self.values, self.powers, self.back = byte_values(seed), np.ones(1, U), np.ones(1, U)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.powers) < n:
            base, inverse = U(self.BASE), U(pow(self.BASE, -1, 1 << 64))
            self.powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, base))])
            self.back = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, inverse))])
        out = np.zeros(n, U)
        np.cumsum(self.values[data] * self.powers[:n - 1], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.back[starts] + (ends - starts).astype(U))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    have = 1
    while 2 * have <= width:
        values, have = np.minimum(values[:-have], values[have:]), 2 * have
    rest = width - have
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def anchors_of(
    rolling: Rolling, data: np.ndarray, offsets: np.ndarray, least: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the texts in ``data``: text, anchor hash, content hash, first start, number of starts."""
    found = []
    place = U((1 << BLOCK_BITS) - 1)
    step = 1 << (BLOCK_BITS - 1)
    for low in range(0, max(len(data) - least + 1, 0), step):
        block = data[low:low + step + least - 1]
        sums, m = rolling.sums(block), len(block) - gram + 1
        hashes = mix((sums[gram:] - sums[:m]) * rolling.back[:m])
        at = (sliding_least(hashes & ~place | np.arange(m, dtype=U), least - gram + 1) & place).astype(np.int64)
        start = np.arange(len(at))
        text = np.searchsorted(offsets, start + low, "right") - 1
        inside = start + low + least <= offsets[text + 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        new, start, text, at = new[inside], start[inside], text[inside], at[inside]
        if not len(start):
            continue
        new[0] = True
        cut = np.flatnonzero(new)
        n = np.diff(np.append(cut, len(start)))
        first, text, at = start[cut], text[cut], at[cut]
        content = rolling.ranges(sums, first, first + n + least - 1)
        found.append((text, hashes[at], content, first + low - offsets[text], n))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none.astype(U), none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def keyed(docs: DataFrame) -> DataFrame:
    """key, check, n_bytes, text and the id of all rows; two hashes tell texts apart."""
    text = whole_text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"),
        F.xxhash64(F.lit(1), text).alias("check"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def copied_texts(rows: DataFrame) -> DataFrame:
    """(key, check, n_bytes, first_id) of texts with several rows, stored."""
    return write_scratch(rows.groupBy(*TEXT).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("n_bytes").alias("n_bytes"), F.min("doc_id").alias("first_id")
    ).where("_rows > 1").drop("_rows"), "copied")


def one_each(rows: DataFrame, copied: DataFrame) -> DataFrame:
    """The rows of each text that has its least id; repeated rows of it stay."""
    named = copied.select(F.col("key").alias("_key"), F.col("check").alias("_check"), "first_id", F.lit(True).alias("_c"))
    on = (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check"))
    return small_join(rows, named, on, "left").where(
        F.col("_c").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select(*rows.columns)


def anchor_table(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """Rows of ``ANCHORS``: the windows of all texts, stored."""
    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for part in text_slices(batches):
            text, grams, window, first, n = anchors_of(rolling, part.data, part.offsets, least, gram)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("key").take(at), part.rows.column("check").take(at),
                 pa.array(grams.astype(np.int64)), pa.array(window.astype(np.int64)),
                 pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))],
                [c.split()[0] for c in ANCHORS.split(", ")])

    return write_scratch(texts.select(*TEXT, "text").mapInArrow(table, ANCHORS), "anchors")


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """The rows whose anchor occurs elsewhere; ``mixed`` if not all windows of the anchor are equal. Stored."""
    # combined before it is moved: an anchor with a third of all rows is no hot spot
    seen = anchors.groupBy("gram").agg(
        F.count(F.lit(1)).alias("_n"), (F.min("window") != F.max("window")).alias("mixed")).where("_n > 1")
    return write_scratch(anchors.join(write_scratch(seen.drop("_n"), "grams"), "gram"), "repeated")


class Windows(NamedTuple):
    """Windows one after the other: their bytes, where each begins, its starts and how often it occurs."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    n: np.ndarray
    weight: np.ndarray


class Found(NamedTuple):
    """Occurrences of maximal repeats: window, start in it, length, and a hash of the repeat."""

    window: np.ndarray
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray


BORDER = -1  # preceded by the border of a window
MANY = -2  # preceded by different bytes


def intervals(common: list[int], left: list[int], whole: list[int], weight: list[int], every: bool):
    """Stack scan of sorted suffixes: (suffix, length) of the left-diverse common-prefix intervals.

    ``common`` is what each suffix has in common with the one before it, ``left`` the
    byte before it, ``whole`` its length. A window that occurs often is an interval of
    its own. Each suffix is given with its longest such interval, or with ``every`` one.
    """
    out: list[tuple[int, int]] = []
    stack: list[list] = []  # length, byte before, suffixes that are told when it closes, is a single window

    def close(node: list) -> list[int]:
        length, before, held, single = node
        if before < 0 and (not single or weight[held[0]] > 1):
            out.extend((i, length) for i in held)
            return held if every else []
        return held

    for i in range(len(left) + 1):
        shared = common[i] if 0 < i < len(left) else -1
        while stack and (stack[-1][0] > shared or stack[-1][3]):
            node = stack.pop()
            before, held = node[1], close(node)
            if shared < 0 and not stack:
                break
            if stack and stack[-1][0] >= shared and not stack[-1][3]:
                below = stack[-1]
                below[1] = below[1] if below[1] == before and before >= 0 else MANY
                below[2] += held
            else:
                stack.append([shared, before if before != BORDER else MANY, held, False])
                break
        if i < len(left):
            stack.append([whole[i], left[i], [i], True])
    return out


def repeats_of(windows: Windows, rolling: Rolling, least: int, every: bool = False) -> Found:
    """Maximal repeats of the windows of some anchors; all windows of these anchors are given."""
    data, begin, end, n, weight = windows
    sums = rolling.sums(data)
    owner = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[owner] + start
    hashes = rolling.ranges(sums, at, at + least)
    order = np.argsort(hashes, kind="stable")
    hashes, owner, start, at = hashes[order], owner[order], start[order], at[order]
    if not len(at):
        return Found(*[np.zeros(0, np.int64)] * 4)
    new = np.ones(len(at), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    before = np.where(start > 0, data[np.maximum(at - 1, 0)].astype(np.int16), BORDER)
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    # all longer repeats that begin like one that is preceded by one byte are preceded by it
    chosen = (np.add.reduceat(weight[owner], first) > 1) & ((low < 0) | (low != high))
    size = np.diff(np.append(first, len(at)))
    keep = np.repeat(chosen, size)
    owner, start, at, before = (x[keep] for x in (owner, start, at, before))
    size = size[chosen]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    done = 0
    while done < len(size):  # some classes at a time
        some = max(1, int(np.searchsorted(np.cumsum(size[done:]), SUFFIXES, "right")))
        base = int(size[:done].sum())
        here = np.arange(base, base + int(size[done:done + some].sum()))
        found.append(_classes(data, at[here], end[owner[here]], before[here], weight[owner[here]],
                              size[done:done + some], least, every, base))
        done += some
    if not found:
        return Found(*[np.zeros(0, np.int64)] * 4)
    suffix, length = (np.concatenate(x) for x in zip(*found))
    node = rolling.ranges(sums, at[suffix], at[suffix] + length)
    return Found(owner[suffix], start[suffix], length, node.astype(np.int64))


def _classes(data, at, end, before, weight, size, least, every, base):
    """(suffix, length) of the intervals of classes of suffixes that agree in their first ``least`` bytes."""
    left = end - at - least
    most = int(left.max()) + 1
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(most, np.uint8)]), most)
    tail = rows[at + least].astype(">u2") + np.uint16(1)
    tail[np.arange(most) >= left[:, None]] = 0
    # by class, then by bytes: big-endian numbers compare as their bytes do
    number = np.repeat(np.arange(len(size)), size)
    keys = np.empty((len(at), most + 2), ">u2")
    keys[:, :2] = number[:, None].astype(">u4").view(">u2")
    keys[:, 2:] = tail
    order = np.argsort(keys.view(f"V{2 * keys.shape[1]}").ravel(), kind="stable")
    tail, left, before, weight = tail[order], left[order], before[order], weight[order]
    differs = tail[1:] != tail[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), most)
    common = np.zeros(len(at), np.int64)
    common[1:] = least + np.minimum(shared, np.minimum(left[1:], left[:-1]))
    whole, common, before, weight = (least + left).tolist(), common.tolist(), before.tolist(), weight.tolist()
    out, a = [], 0
    for b in np.cumsum(size).tolist():
        out += [(i + a, n) for i, n in intervals(common[a:b], before[a:b], whole[a:b], weight[a:b], every)]
        a = b
    told = np.array(out, np.int64).reshape(-1, 2)
    return order[told[:, 0]] + base, told[:, 1]


def merged(window: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each window, those that meet made one."""
    if not len(window):
        return window, low, high
    order = np.lexsort((low, window))
    window, low, high = window[order], low[order], high[order]
    wide = int(high.max()) + 1
    reach = np.maximum.accumulate(window * wide + high)
    new = np.ones(len(window), bool)
    new[1:] = window[1:] * wide + low[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return window[first], low[first], np.maximum.reduceat(high, first)


def mixed_windows(repeated: DataFrame) -> DataFrame:
    """(gram, window, n, weight, key, check, first): one place of each different window to be read again, stored."""
    return write_scratch(repeated.where("mixed").groupBy("gram", "window").agg(
        F.min("n").alias("n"), F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("weight"),
        F.min(F.struct("key", "check", "first")).alias("_at")
    ).select("gram", "window", "n", "weight", "_at.*"), "mixed")


def window_bytes(texts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """(gram, window, n, weight, bytes) of the windows in ``wanted``."""
    listed = write_scratch(wanted.groupBy(F.col("key").alias("_key"), F.col("check").alias("_check")).agg(
        F.collect_list(F.struct("gram", "window", "n", "weight", "first")).alias("_wanted")), "wanted")
    on = (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check"))
    held = small_join(texts.select(*TEXT, "text"), listed, on, "inner", F.size("_wanted")).select(
        "text", F.col("_wanted").alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=1 << 18):
            lists = part.rows.column("wanted")
            struct = lists.flatten()
            per = np.array(lists.value_lengths())
            gram, window, n, weight, first = (struct.field(i) for i in range(5))
            low = part.offsets[:-1].repeat(per) + first.to_numpy()
            size = n.to_numpy() + least - 1
            ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            at = np.arange(ends[-1]) + (low - ends[:-1]).repeat(size)
            held = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(low), [None, pa.py_buffer(ends), pa.py_buffer(part.data[at].tobytes())])
            yield pa.RecordBatch.from_arrays(
                [gram, window, n, weight, held.cast(pa.binary())], ["gram", "window", "n", "weight", "bytes"])

    return held.mapInArrow(cut, "gram long, window long, n int, weight int, bytes binary")


def _windows(table: pa.Table) -> Windows:
    held = table.column("bytes").combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int32)[held.offset:held.offset + len(held) + 1].astype(np.int64)
    return Windows(np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends[:-1] - ends[0], ends[1:] - ends[0],
                   table.column("n").to_numpy().astype(np.int64), table.column("weight").to_numpy().astype(np.int64))


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole anchors, of about ``CHUNK`` bytes, from rows sorted by anchor."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("bytes").nbytes
        if size >= CHUNK:
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.column("bytes").nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


RANGES = "gram long, window long, low int, high int, node long"


def _search(least: int, every: bool):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for table in _sorted_groups(batches):
            # a repeated row of documents gives its windows again
            key = table.column("window").to_numpy()
            gram = table.column("gram").to_numpy()
            once = np.ones(len(key), bool)
            once[1:] = (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])
            table = table.filter(pa.array(once)).combine_chunks()
            found = repeats_of(_windows(table), rolling, least, every)
            if every:
                window, low, high, node = found.window, found.start, found.start + found.length, found.node
            else:
                window, low, high = merged(found.window, found.start, found.start + found.length)
                node = np.zeros(len(window), np.int64)
            at = pa.array(window)
            yield pa.RecordBatch.from_arrays(
                [table.column("gram").combine_chunks().take(at), table.column("window").combine_chunks().take(at),
                 pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(node)],
                [c.split()[0] for c in RANGES.split(", ")])
            del table, found
            give_back()

    return search


def _start_hashes(least: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                held = _windows(pa.Table.from_batches([part]))
                owner = np.repeat(np.arange(len(held.n)), held.n)
                start = np.arange(len(owner)) - np.repeat(np.cumsum(held.n) - held.n, held.n)
                at = held.begin[owner] + start
                node = rolling.ranges(rolling.sums(held.data), at, at + least).astype(np.int64)
                to = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("gram").take(to), part.column("window").take(to), pa.array(start.astype(np.int32)),
                     pa.array(node), part.column("weight").take(to)], ["gram", "window", "low", "node", "weight"])
        give_back()

    return hashes


def window_repeats(
    texts: DataFrame, repeated: DataFrame, least: int, every: bool = False, hot: int | None = None
) -> DataFrame:
    """Rows of ``RANGES``: the repeats of the windows of mixed anchors, stored.

    One range a window, unless ``every`` repeat is asked for: a window that occurs often
    is joined with all its places, and its ranges must not multiply them.
    """
    mixed = mixed_windows(repeated)
    crowded = write_scratch(mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > (HOT if hot is None else hot)).select("gram"), "crowded")
    held = window_bytes(texts, small_join(mixed, crowded, "gram", "left_anti"), least)
    dealt = held.repartition("gram").sortWithinPartitions("gram", "window")
    found = dealt.mapInArrow(_search(least, every), RANGES)
    if not crowded.isEmpty():
        # each start of a crowded anchor's windows is a key of its own, counted before it is moved
        starts = write_scratch(window_bytes(texts, small_join(mixed, crowded, "gram", "left_semi"), least).mapInArrow(
            _start_hashes(least), "gram long, window long, low int, node long, weight int").distinct(), "starts")
        often = starts.groupBy("gram", "node").agg(F.sum("weight").alias("_n")).where("_n > 1").drop("_n")
        told = starts.join(often, ["gram", "node"]).select(
            "gram", "window", "low", (F.col("low") + least).alias("high"), "node")
        if not every:
            # starts of a window are less than ``least`` apart, so their strings make one range
            told = told.groupBy("gram", "window").agg(
                F.min("low").alias("low"), F.max("high").alias("high"), F.lit(0).cast("long").alias("node"))
        found = found.union(told)
    return write_scratch(found, "window-repeats")


def repeated_runs(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """(key, check, runs): the maximal runs (low, high) of repeated bytes of every text that has some."""
    bound_batches(docs.sparkSession)
    rows = keyed(docs).where(F.col("n_bytes") >= least)
    copied = copied_texts(rows)
    texts = one_each(rows, copied)
    repeated = repeated_anchors(anchor_table(texts, least, gram))
    found = window_repeats(texts, repeated, least, False, hot)
    whole = repeated.where("not mixed").select(
        *TEXT, F.col("first").alias("low"), (F.col("first") + F.col("n") + least - 1).alias("high"))
    part = repeated.where("mixed").join(found, ["gram", "window"]).select(
        *TEXT, (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))
    same = copied.select(*TEXT, F.lit(0).alias("low"), F.col("n_bytes").cast("int").alias("high"))
    every = whole.union(part).union(same)
    within = Window.partitionBy(*TEXT).orderBy("low", "high")
    reach = F.max("high").over(within.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("_new", F.when(reach >= F.col("low"), 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*TEXT, "_run").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return runs.groupBy(*TEXT).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"))


def without_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans and the digest of the bytes left.

    A byte goes if a string of ``least`` bytes that covers it also starts anywhere else,
    in the same text too; strings are judged on the input. Null and empty texts have no
    bytes. Repeated rows are occurrences of their own, so a text of ``least`` bytes that
    two rows hold goes whole; a null id is carried. An empty table gives an empty table;
    other columns are not read.
    """
    runs = write_scratch(repeated_runs(docs, least, gram, hot).select(
        F.col("key").alias("_key"), F.col("check").alias("_check"), "runs"), "runs")
    on = (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check"))
    held = small_join(keyed(docs), runs, on, "left", F.size("runs")).select("doc_id", "text", "runs")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            out = []
            for i, cut in enumerate(part.rows.column("runs").to_pylist()):
                text = part.data[part.offsets[i]:part.offsets[i + 1]]
                digest, at = hashlib.sha256(), 0
                for run in cut or []:
                    digest.update(text[at:run["low"]])
                    at = run["high"]
                digest.update(text[at:])
                out.append((len(text), sum(r["high"] - r["low"] for r in cut or []), len(cut or []), digest.hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3])],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return held.mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def maximal_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """(repeat, length, key, check, start): maximal repeats of ``least`` bytes or more, all occurrences in all texts.

    Texts are told by ``key`` and ``check`` and count once, however many rows hold them.
    Repeats of windows whose occurrences are the same but for one distance are joined
    where they meet, so a repeat is as long as its strings of ``least`` bytes keep the same
    occurrences; one with a part that occurs more often is told as the stretches on either
    side, which reach into the part, and the part. In windows of crowded anchors no longer
    repeats inside such a stretch are told.
    """
    bound_batches(docs.sparkSession)
    rows = keyed(docs).where(F.col("n_bytes") >= least)
    texts = one_each(rows, copied_texts(rows))
    repeated = repeated_anchors(anchor_table(texts.dropDuplicates(TEXT), least, gram))
    found = window_repeats(texts, repeated, least, True, hot)
    whole = repeated.where("not mixed").select(
        F.xxhash64("gram", "window").alias("node"), (F.col("n") + least - 1).alias("size"), *TEXT,
        F.col("first").alias("low"))
    part = repeated.where("mixed").join(found, ["gram", "window"]).select(
        F.xxhash64("gram", "node").alias("node"), (F.col("high") - F.col("low")).alias("size"), *TEXT,
        (F.col("first") + F.col("low")).alias("low"))
    seen = write_scratch(whole.union(part).distinct(), "occurrences")
    first = seen.groupBy("node").agg(F.min(F.struct(*TEXT, "low")).alias("_at"))
    placed = seen.join(first, "node").withColumn("_by", F.col("low") - F.col("_at.low"))
    nodes = placed.groupBy("node", "size", "_at").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64(*TEXT, "_by").cast("decimal(38,0)")).alias("_same"))
    alike = Window.partitionBy("_at.key", "_at.check", "_n", "_same").orderBy("_at.low", "size")
    reach = F.max(F.col("_at.low") + F.col("size")).over(alike.rowsBetween(Window.unboundedPreceding, -1))
    islands = nodes.withColumn("_new", F.when(reach >= F.col("_at.low"), 0).otherwise(1)).withColumn(
        "_run", F.sum("_new").over(alike.rowsBetween(Window.unboundedPreceding, 0)))
    joined = islands.groupBy("_at.key", "_at.check", "_n", "_same", "_run").agg(
        F.min(F.struct("_at.low", "node")).alias("_first"), F.max(F.col("_at.low") + F.col("size")).alias("_end")
    ).select(F.col("_first.node").alias("node"), (F.col("_end") - F.col("_first.low")).alias("length"))
    return joined.join(seen, "node").select(
        F.col("node").alias("repeat"), "length", *TEXT, F.col("low").alias("start")).distinct()
