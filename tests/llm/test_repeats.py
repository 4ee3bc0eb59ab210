"""Repeated passages: suffix intervals against all substrings."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelscope.llm import repeats, similar


def covered(texts: list[bytes], least: int) -> list[np.ndarray]:
    seen = defaultdict(list)
    for t, x in enumerate(texts):
        for i in range(len(x) - least + 1):
            seen[x[i:i + least]].append((t, i))
    marks = [np.zeros(len(x), bool) for x in texts]
    for held in seen.values():
        if len(held) > 1:
            for t, i in held:
                marks[t][i:i + least] = True
    return marks


def digests(texts: list[bytes], least: int) -> list[tuple]:
    out = []
    for x, marks in zip(texts, covered(texts, least)):
        edges = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
        kept = bytes(b for b, m in zip(x, marks) if not m)
        out.append((len(x), int(marks.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def occurrences(texts: list[bytes], x: bytes) -> set[tuple[int, int]]:
    return {(t, i) for t, y in enumerate(texts) for i in range(len(y) - len(x) + 1) if y.startswith(x, i)}


def maximal(texts: list[bytes], least: int) -> dict[bytes, set]:
    """Repeats that no byte on either side extends in all their occurrences."""
    out = {}
    for n in range(least, max(map(len, texts)) + 1):
        seen = defaultdict(set)
        for t, x in enumerate(texts):
            for i in range(len(x) - n + 1):
                seen[x[i:i + n]].add((t, i))
        for x, held in seen.items():
            left = {texts[t][i - 1] if i else (t,) for t, i in held}
            right = {texts[t][i + n] if i + n < len(texts[t]) else (t,) for t, i in held}
            if len(held) > 1 and len(left) > 1 and len(right) > 1:
                out[x] = held
    return out


def odd_texts(rng: random.Random) -> list[bytes]:
    letters = rng.choice([b"ab", b"abcdefgh", b"a", bytes(range(256))])
    base = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(3)]
    out = []
    for _ in range(rng.randint(1, 8)):
        x = bytearray(b"".join(rng.choice(base)[rng.randint(0, 30):rng.randint(20, 120)] for _ in range(rng.randint(1, 3))))
        for _ in range(rng.randint(0, 3)):
            if x:
                x[rng.randrange(len(x))] = rng.choice(letters)
        out.append(bytes(x))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_windows_and_intervals_against_all_substrings(seed, monkeypatch):
    least, gram = 12, 4
    rng, rolling = random.Random(seed), repeats.Rolling()
    monkeypatch.setattr(repeats, "BLOCK_BITS", rng.choice([6, 20]))
    monkeypatch.setattr(repeats, "SUFFIXES", rng.choice([2, 1000]))
    texts = odd_texts(rng)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    found = repeats.anchors_of(rolling, data, offsets, least, gram)
    places, held = defaultdict(list), {}
    for t, g, w, a, n in zip(*(x.tolist() for x in found)):
        held[g, w] = texts[t][a:a + n + least - 1]
        places[g, w].append((t, a))
    # every start lies in one window
    starts = sorted((t, a + k) for (g, w), at in places.items() for t, a in at for k in range(len(held[g, w]) - least + 1))
    assert starts == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - least + 1)]
    names = sorted(held)
    ends = np.cumsum([len(held[k]) for k in names]).astype(np.int64)
    windows = repeats.Windows(
        np.frombuffer(b"".join(held[k] for k in names), np.uint8), np.append(0, ends[:-1])[:len(names)], ends,
        np.array([len(held[k]) - least + 1 for k in names], np.int64),
        np.array([min(2, len(places[k])) for k in names], np.int64))
    want = covered(texts, least)
    for every in (False, True):
        marks, told = [np.zeros(len(x), bool) for x in texts], defaultdict(set)
        got = repeats.repeats_of(windows, rolling, least, every)
        for w, s, n, node in zip(*(x.tolist() for x in got)):
            for t, a in places[names[w]]:
                marks[t][a + s:a + s + n] = True
                told[node].add((texts[t][a + s:a + s + n], t, a + s))
        assert all((a == b).all() for a, b in zip(marks, want))
        for group in told.values() if every else ():
            (x,) = {x for x, _, _ in group}
            assert len(group) > 1 and {g[1:] for g in group} <= occurrences(texts, x)


def test_many_classes_at_once():
    """More classes than one byte can number."""
    rng, rolling = random.Random(6), repeats.Rolling()
    words = [bytes(rng.choice(b"abcdefgh") for _ in range(20)) for _ in range(600)]
    held = [bytes([left]) + w + bytes([rng.choice(b"xyz")]) * rng.randint(1, 3) for w in words for left in b"pq"]
    ends = np.cumsum([len(x) for x in held]).astype(np.int64)
    windows = repeats.Windows(
        np.frombuffer(b"".join(held), np.uint8), np.append(0, ends[:-1]), ends,
        np.array([len(x) - 19 for x in held], np.int64), np.ones(len(held), np.int64))
    got = repeats.repeats_of(windows, rolling, 20)
    want = covered(held, 20)
    marks = [np.zeros(len(x), bool) for x in held]
    for w, s, n in zip(got.window.tolist(), got.start.tolist(), got.length.tolist()):
        marks[w][s:s + n] = True
    assert all((a == b).all() for a, b in zip(marks, want)) and sum(m.sum() for m in marks) >= 20 * 1200


def test_sliding_least():
    values = np.random.default_rng(1).integers(0, 99, 50)
    for width in (1, 2, 3, 7, 16, 50):
        assert repeats.sliding_least(values, width).tolist() == [min(values[i:i + width]) for i in range(51 - width)]


def check(table, rows, hot=None, least=30):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                  for r in repeats.without_repeats(table, least, 8, hot).collect()), key=repr)
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(((r[0], *d) for r, d in zip(rows, digests(texts, least))), key=repr)
    assert got == want and sum(r[2] for r in got)


def test_documents_against_all_substrings(docs, rows):
    check(docs, rows)


def test_crowded_anchors_give_the_same(docs, rows):
    check(docs, rows, hot=1)


@pytest.mark.parametrize("hot", [1, None])
def test_a_window_has_one_range(spark, hot):
    # a passage in many texts, its first and last bytes with others before and after them
    texts = [f"{i:03d}" * (i % 7) + "the very same passage of more than thirty bytes"[i % 5:44 + i % 4] + f"{i * i:05d}"
             for i in range(60)]
    rows = repeats.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    repeated = repeats.repeated_anchors(repeats.anchor_table(rows, 30, 8))
    found = repeats.window_repeats(rows, repeated, 30, hot=hot).select("gram", "window").collect()
    assert found and len(found) == len(set(found))


def test_joins_without_broadcast_give_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_ROWS", -1)
    check(docs, rows)


def test_bytes_ties_and_borders(spark):
    same = "é" * 40  # two bytes a letter
    texts = [same + "x", "y" + same, "a" * 29, "a" * 30, "a" * 31, "b" * 64, None, "", "c" * 30, "c" * 30,
             "\0" * 45 + "q", "q" + "\0" * 45, "d" * 29 + "e", "d" * 29 + "f"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z" * 15 + "w" * 20), (None, "z" * 15 + "w" * 20)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_occurrences_of_planted_repeats(spark):
    rng = random.Random(4)

    def noise(n):
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(n))

    long, short, part = noise(400), noise(50), noise(200)
    texts = [noise(60) + long + noise(50), noise(20) + long + noise(70) + short, short + noise(90) + short + noise(10),
             noise(200) + part + noise(40), part + noise(100)]
    table = spark.createDataFrame([*enumerate(texts), (9, texts[4]), (9, None)], "doc_id long, text string")
    place = {(r.key, r.check): texts.index(r.text) for r in repeats.keyed(table).where("text <> ''").collect()}
    got = defaultdict(set)
    for r in repeats.maximal_repeats(table, 30, 8).collect():
        t = place[r.key, r.check]
        got[r["repeat"], texts[t][r.start:r.start + r.length].encode()].add((t, r.start))
    want = maximal([t.encode() for t in texts], 30)
    assert len(want) == 3 and {x: at for (_, x), at in got.items()} == want and len(got) == 3


def test_a_part_that_occurs_more_often(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnop"
    long, *rest = ("".join(rng.choice(letters) for _ in range(n)) for n in (400, 60, 50, 70, 40))
    texts = [rest[0] + long, rest[1] + long + rest[2], rest[3] + long[100:300]]
    table = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    place = {(r.key, r.check): texts.index(r.text) for r in repeats.keyed(table).collect()}
    got = defaultdict(set)
    for r in repeats.maximal_repeats(table, 30, 8).collect():
        t = place[r.key, r.check]
        got[texts[t][r.start:r.start + r.length].encode()].add((t, r.start))
    whole = [t.encode() for t in texts]
    assert all(at == occurrences(whole, x) for x, at in got.items())  # all occurrences
    left, part, right = sorted(got, key=long.encode().index)
    assert part == long[100:300].encode() and len(left) >= 129 and len(right) >= 129
    assert long.encode().startswith(left) and long.encode().endswith(right)


def test_one_very_long_text(spark):
    rng = random.Random(2)
    part = "".join(rng.choice("abcdefgh \n") for _ in range(1 << 20))
    texts = [part + "x" * 3_000_000 + "yz" * 1000 + part[:5000], part[1000:3000], None]
    got = {r.doc_id: r for r in repeats.without_repeats(
        spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got[0].n_removed == 3_000_000 + 2000 + 5000 * 2 and got[0].n_spans == 2
    assert got[1].n_removed == 2000 and got[1].n_spans == 1 and got[2].n_bytes == 0


def test_empty(empty):
    assert repeats.without_repeats(empty).count() == 0
    assert repeats.maximal_repeats(empty).count() == 0


def test_search_memory():
    """A task holds the suffixes of some anchors at a time: memory follows the chunk, not the partition."""
    rng = np.random.default_rng(5)
    shared = [rng.integers(97, 123, 700, dtype=np.uint8).tobytes() for _ in range(40)]
    rows = [(g, w, bytes([97 + w]) + shared[g][1:650] + bytes([97 + w]) * 50) for g in range(40) for w in range(24)] * 2
    rows.sort(key=lambda r: r[:2])
    batches = [pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()),
         pa.array([len(r[2]) - 399 for r in part], pa.int32()), pa.array([1] * len(part), pa.int32()),
         pa.array([r[2] for r in part], pa.binary())], ["gram", "window", "n", "weight", "bytes"])
        for part in (rows[i:i + 64] for i in range(0, len(rows), 64))]
    tracemalloc.start()
    found = pa.Table.from_batches(repeats._search(400, False)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert found.num_rows == 40 * 24 and set(found.column("low").to_pylist()) == {1}
    assert peak < 15, peak
