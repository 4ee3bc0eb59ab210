"""Runs of periodic words against all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest

from panelscope.llm import periodic, suffix_tree


def plain_runs(words: list, least: int = 12) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                run = words[i:j + q]
                if not any(run[:-d] == run[d:] for d in range(1, q)):  # q is its smallest period
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng: random.Random, most: int = 70) -> list[int]:
    n = rng.randint(0, most)
    words = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(n)]
    if n > 10 and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, n // 2)
        words = [words[i] if i < a else words[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return words


@pytest.mark.parametrize("tree_words", [1 << 17, 0])
def test_runs_against_all_periods(tree_words):
    rng = random.Random(1)
    for _ in range(400):
        words = some_words(rng)
        held, want = np.array(words, np.int64), plain_runs(words)
        assert [tuple(r) for r in periodic.runs_of(held, 12, tree_words).tolist()] == want
        assert [tuple(r) for r in periodic.document_runs(held, tree_words).tolist()] == want
    assert [tuple(r) for r in periodic.runs_of(np.array([1, 1, 2, 1, 2]), 2).tolist()] == [(0, 2, 1), (1, 4, 2)]


def test_common_extensions_and_orders():
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.randrange(1, 4) for _ in range(rng.randint(1, 40))]
        n = len(words)
        tree, hashed = (kind(np.array(words)) for kind in (suffix_tree.SuffixTree, suffix_tree.HashedSuffixes))
        for backward in (False, True):
            order = sorted(range(n + 1), key=lambda i: [-x if backward else x for x in words[i:]])
            rank = [order.index(i) for i in range(n + 1)]
            assert list(tree.ranks(backward)) == rank and list(hashed.ranks(backward)) == rank
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        i, j = np.array(pairs).T
        want = [next((k for k in range(n) if max(a, b) + k >= n or words[a + k] != words[b + k])) if max(a, b) < n else 0
                for a, b in pairs]
        assert tree.common(i, j).tolist() == want and hashed.common(i, j).tolist() == want


def plain_row(doc_id, text, plant):
    words = brute.WORD.findall(text or "")
    if plant and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(runs), *(best or [None] * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("plant", [True, False])
def test_documents_against_all_periods(docs, rows, plant):
    got = periodic.periodic_runs(docs, periodic.planted if plant else periodic.as_given).collect()
    # the longest text has no small period: its rows are looked at in the other tests
    short = {r[0] for r in rows if len((r[1] or "").split()) < 1000}
    want = sorted((plain_row(r[0], r[1], plant) for r in rows if r[0] in short), key=repr)
    assert sorted((tuple(r) for r in got if r.doc_id in short), key=repr) == want
    assert sum(r[1] for r in want) >= 2 and len(got) == len(rows)


def test_many_planted_documents(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(str(rng.randrange(50)) for _ in range(rng.randint(0, 150)))) for i in range(200)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), periodic.planted).collect()
    want = [plain_row(*r, True) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and sum(r[1] > 0 for r in want) > 5


def test_white_space_and_pieces(spark, monkeypatch):
    text = "a b\tc\x0bd  e\ré f\ng " * 7
    words = periodic.Words()
    whole = words(text.encode())
    assert [words.held[k].decode() for k in whole] == brute.WORD.findall(text)
    monkeypatch.setattr(periodic, "PIECE", 3)
    parts = periodic.Words()
    assert parts(text.encode()).tolist() == whole.tolist()
    assert parts.joined(whole) == hashlib.sha256(" ".join(brute.WORD.findall(text)).encode()).hexdigest()


def test_long_texts(spark):
    rng = random.Random(5)
    period = [f"w{i}" for i in range(40_000)]
    texts = ["again " * 2_000_000, " ".join(period * 8), " " * 3_000_000 + "x", "y" * 5_000_000,
             " ".join(str(rng.random()) for _ in range(100_000))]
    got = {r.doc_id: r for r in periodic.periodic_runs(
        spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert (got[0].n_runs, got[0].length, got[0].period) == (1, 2_000_000, 1)
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].exponent_milli) == (1, 0, 320_000, 40_000, 8000)
    assert got[1].collapsed_sha256 == hashlib.sha256(" ".join(period).encode()).hexdigest()
    assert [got[i].n_runs for i in (2, 3, 4)] == [0, 0, 0]


def test_empty(empty):
    assert periodic.periodic_runs(empty).count() == 0
