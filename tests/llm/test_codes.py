"""Vector codes against the definition in plain Python."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np

from panelscope.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, _row int"


def plain(rows, parts, entries, rounds):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept = [(r[0], [math.floor(1024 * x) for x in r[1]], r[2]) for r in kept]
    size = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * size:(p + 1) * size] for r in first] for p in range(parts)]

    def nearest(v, p):
        x = v[p * size:(p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                held[nearest(v, p)[1]].append(v[p * size:(p + 1) * size])
            new.append([[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e
                        for k, e in enumerate(books[p])])
        books = new
    found = [[nearest(v, p) for p in range(parts)] for _, v, _ in kept]
    by = defaultdict(int)
    for (_, _, label), f in zip(kept, found):
        by[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by[label], digest)
                   for (i, _, label), f in zip(kept, found)), key=repr)


def odd_rows(seed: int, n: int, length: int = 8):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), [rng.choice([rng.gauss(0, 1), -0.5, 0.25]) for _ in range(length)],
             rng.choice([None, 1, 2])) for _ in range(n)]
    rows += [rows[0], rows[0], (None, [0.1] * length, None), (3, None, 1), (4, [None] * length, 1),
             (5, [math.nan] + [0.0] * (length - 1), 1), (6, [0.0] * (length - 1) + [-math.inf], None)]
    rng.shuffle(rows)
    return [(*r, "c", 1, 2) for r in rows]


def test_codes_against_the_definition(spark):
    for seed, n, entries in ((1, 200, 16), (2, 90, 256), (3, 5, 4)):
        rows = odd_rows(seed, n)
        table = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = vector_codes.compressed(table, entries=entries, rounds=3).collect()
        assert sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256"))
                       for r in got), key=repr) == plain(rows, 4, entries, 3)


def test_tables_give_the_distances():
    rng = np.random.default_rng(1)
    part, entries = rng.integers(-9, 9, (50, 5)), rng.integers(-9, 9, (7, 5))
    code, error = vector_codes.assign(part, entries)
    every = ((part[:, None] - entries) ** 2).sum(axis=2)
    assert (error == every.min(axis=1)).all() and (code == every.argmin(axis=1)).all()
    assert vector_codes.assign(np.zeros((2, 3), np.int64), np.ones((4, 3), np.int64))[0].tolist() == [0, 0]


def test_codes_stand_for_near_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vector_codes.integers(table, "embedding")
    books = vector_codes.fit(rows, vector_codes.first_entries(rows, "vec_id", 4, 256), 4)
    held = vector_codes.encode(rows, books).join(
        rows.select("_row", "_v"), "_row").select("_code", "_error", "_v").collect()
    back = vector_codes.decoded([r["_code"] for r in held], books)
    assert ((back - np.array([r["_v"] for r in held])) ** 2).sum(axis=1).tolist() == [r["_error"] for r in held]
    start = vector_codes.first_entries(rows, "vec_id", 4, 256)
    before = vector_codes.encode(rows, start).groupBy().sum("_error").first()[0]
    assert sum(r["_error"] for r in held) < before


def test_awkward_lengths_and_values(spark):
    rows = [(1, [1e30, -1e30, 0.0, 5.0], 1), (2, [1.0, 2.0], 1), (3, [], None), (4, [0.0, 0.0, 0.0, 1e-9], None)]
    got = {r.vec_id: r for r in vector_codes.compressed(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert set(got) == {1, 4} and all(r.error == 0 for r in got.values())
    odd = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compressed(odd).count() == 0
    none = spark.createDataFrame([], SCHEMA)
    assert vector_codes.compressed(none).count() == 0
    floats = spark.createDataFrame([(1, [0.5] * 4, "a"), (2, [0.25] * 4, "a")], "vec_id int, embedding array<float>, label string")
    assert [r.code for r in vector_codes.compressed(floats).orderBy("vec_id").collect()] == ["00000000", "01010101"]
