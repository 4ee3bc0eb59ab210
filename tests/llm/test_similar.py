"""Documents and lines of one class, against brute force."""

from __future__ import annotations

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from panelscope.llm import lines, neardup, similar
from panelscope.llm.common import U
from panelscope.llm.graph import components


@pytest.mark.parametrize("edges", [
    [], [(1, 2), (2, 1), (3, 3)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)],
    [(random.Random(i).randrange(60), random.Random(-i).randrange(60)) for i in range(45)],
])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for a, b in edges if a != b for n in (a, b)})
    union = brute.Union(61)
    for a, b in edges:
        union.join(a, b)
    want = {n: min(m for m in nodes if union.find(m) == union.find(n)) for n in nodes}
    assert got == want


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for n, shared in ((3, 3), (30, 25), (3000, 2600)):
        x = rng.integers(1, 2**63, 2 * n - shared).astype(U)
        w = rng.uniform(0.3, 4, len(x))
        items = np.concatenate([x[:n], x[n - shared:]])
        owner = np.repeat([0, 1], n)
        for weights in (np.ones(len(items)), np.concatenate([w[:n], w[n - shared:]])):
            sign = neardup.darts(items, weights, owner, 2, 2048)
            total = weights.sum() - weights[n - shared:n].sum()
            assert abs((sign[0] == sign[1]).mean() - weights[n - shared:n].sum() / total) < 0.045


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1100).astype(U)
    hashes, owner = np.concatenate([x[:1000], x[100:]]), np.repeat([0, 1], 1000)
    a, b = lines.minhash(hashes, owner, 2, 512)
    assert abs((a == b).mean() - 900 / 1100) < 0.06
    assert (lines.minhash(hashes[:2], owner[:2], 1, 80) != 0xFFFFFFFF).all()


def test_classes_of_documents(docs, rows):
    class_of = brute.classes([brute.word_shingles(r[1]) for r in rows])
    ids = {}
    for r, c in zip(rows, class_of):
        ids.setdefault(c, []).append(r[0])
    want = sorted(((r[0], min(ids[c], key=lambda i: (i is not None, i or 0)))
                   for r, c in zip(rows, class_of)), key=repr)
    got = neardup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == want


def test_one_document_of_each_class_stays(docs, rows):
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    class_of = brute.classes([brute.word_shingles(r[1]) for r in rows])
    blank = sum(not brute.WORD.search(r[1] or "") for r in rows)
    found = kept.collect()
    assert len(found) == len(set(class_of)) and sum(not brute.WORD.search(r.text or "") for r in found) == blank
    assert {tuple(r) for r in found} <= {tuple(r) for r in docs.collect()}


def test_lines_against_brute_force(docs, rows):
    listed = sorted({(r[0] is not None, r[0] or 0, r[1], n, x) for r in rows
                     for n, x in brute.lines(r[1], lines.MIN_WORDS)})
    texts = sorted({x for *_, x in listed})
    class_of = dict(zip(texts, brute.classes([brute.char_shingles(x, lines.SHINGLE) for x in texts])))
    got = lines.line_classes(docs).distinct().collect()
    first = {}
    by_place = {(r.doc_id, r.text_key, r.line_no): r for r in got}
    assert len(by_place) == len(listed)
    kept = {}
    for r in got:
        first.setdefault((r["first"].doc_id, r["first"].text_key, r["first"].line_no), []).append(r)
        kept[r.doc_id, r.line_no] = r.kept
    assert len(first) == len(set(class_of.values()))
    assert sum(r.kept for r in got) == len(first)


def test_documents_without_repeated_lines(docs, rows):
    cut = lines.dedup_lines(docs)
    assert cut.columns == docs.columns
    found = cut.collect()
    texts = [x for r in {(r.doc_id, r.text) for r in found} for _, x in brute.lines(r[1], lines.MIN_WORDS)]
    class_of = brute.classes([brute.char_shingles(x, lines.SHINGLE) for x in texts])
    assert len(set(class_of)) == len(texts)
    by_id = {r.doc_id: r for r in found}
    assert by_id[300].text is None and by_id[301].text == "" and by_id[305].text == "two words"
    assert by_id[403].n_chars == len(by_id[403].text)
    assert 3 in by_id and 201 not in by_id  # copies lose all their words and go


def test_short_lines_have_rows_and_classes(spark):
    texts = ["All rights reserved.\nx\n \na line of its own", "All rights reserved.\n一二三四五六七八九十甲乙丙丁",
             "X\nx\n\n一二三四五六七八九十甲乙丙丁", "All rights reserved!\nAll rights  reserved."]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.line_no): r["first"][::2] for r in lines.line_classes(table).collect()}
    listed = [(d, n, x) for d, t in enumerate(texts) for n, x in brute.lines(t, 1)]
    class_of = brute.classes([brute.char_shingles(x, lines.SHINGLE) for *_, x in listed])
    first = {}
    for (d, n, _), c in zip(listed, class_of):
        first.setdefault(c, (d, n))
    assert got == {(d, n): first[c] for (d, n, _), c in zip(listed, class_of)}
    assert got[1, 0] == (0, 0) and got[2, 1] == (0, 1) and got[2, 3] == (1, 1)
    cut = {r.doc_id: r.text for r in lines.dedup_lines(table).collect()}
    assert cut[1] == "一二三四五六七八九十甲乙丙丁" and cut[2] == "X\n"


def test_bands_of_lines_find_pairs_at_the_threshold():
    assert 1 - (1 - lines.THRESHOLD ** lines.ROWS) ** lines.BANDS >= 0.9996


def test_minhash_of_short_lines_is_what_borrowing_gives():
    rng = np.random.default_rng(2)
    hashes, owner = rng.integers(0, 2**63, 4).astype(U), np.array([0, 1, 1, 2])
    got = lines.minhash(hashes, owner, 3, 16)
    assert (got[0] == hashes[0].astype(np.uint32) & 0x7FFFFFFF).all()
    assert (got[2] == hashes[3].astype(np.uint32) & 0x7FFFFFFF).all()
    assert set(got[1]) == set(hashes[1:3].astype(np.uint32) & 0x7FFFFFFF)


def _members(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "node long, text string")


def test_links_between_members_that_differ_from_the_least(spark):
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(100)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in range(20, 24)]
    texts = _members(spark, ["other " * 9, *near, "and another one that is alone here"])
    pairs = spark.createDataFrame([(7, 0, i) for i in range(1, 6)], "key long, a long, b long")
    none = spark.createDataFrame([], "node long, root long")
    more = similar.open_links(pairs, none, texts, neardup.document_items, 0.8).collect()
    union = brute.Union(6)
    for r in more:
        union.join(r.a, r.b)
    assert len({union.find(i) for i in (1, 2, 3, 4)}) == 1
    assert len({union.find(i) for i in range(6)}) == 3


def test_least_member_is_searched_if_batches_had_centers(spark):
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(100)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1:]) for i in (20, 70)]
    center = "another text that is like none of them"
    for other in (center, near[1].replace(" x ", " y ")):  # the other two are apart, or alike
        texts = [near[0], center, near[1], other]
        pairs = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (7, 1, 3)], "key long, a long, b long")
        roots = similar.similar_classes(
            pairs, lambda nodes: _members(spark, texts).join(nodes, "node", "left_semi"),
            neardup.document_items, 0.8).collect()
        class_of = {r.node: r.root for r in roots}
        assert class_of[0] == class_of[2]


@pytest.mark.parametrize("at_once", [2, 3, 1000])
def test_batches_of_one_bucket_against_brute_force(spark, at_once):
    """One key holds all members, in Arrow batches of a few."""
    def keys(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            yield similar.keyed_batch(np.full(len(nodes), 7), nodes, 3)

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    for seed in range(3):
        rng = random.Random(seed)
        words = [[str(rng.random()) for _ in range(60)] for _ in range(4)]
        listed = [w[:i] + ["x"] + w[i + 1:] for w in words for i in rng.sample(range(60), 3)]
        listed = [" ".join(x) for x in rng.sample(listed, len(listed))]
        texts = _members(spark, listed).coalesce(1)
        try:
            spark.conf.set(name, str(at_once))
            pairs = similar.bucket_pairs(texts.select("node").mapInArrow(keys, similar.PACKED), 3)
        finally:
            spark.conf.set(name, before)
        found = similar.similar_classes(
            pairs, lambda nodes: texts.join(nodes, "node", "left_semi"), neardup.document_items, 0.8).collect()
        root = {i: i for i in range(len(listed))} | {r.node: r.root for r in found}
        class_of = brute.classes([brute.word_shingles(x) for x in listed])
        assert [[root[i] == root[j] for j in root] for i in root] == [[a == b for b in class_of] for a in class_of]


@pytest.mark.parametrize("block", [2, 5, 256])
def test_open_buckets_with_large_and_small_components(spark, monkeypatch, block):
    """Blocks of one component do not meet; all links across components are found, and rows stay few."""
    monkeypatch.setattr(similar, "BLOCK", block)
    rng = random.Random(4)
    base = [[str(rng.random()) for _ in range(150)] for _ in range(5)]
    listed = [w[:i] + ["x"] + w[i + 1:] for w, n in zip(base, (20, 9, 4, 2, 1)) for i in rng.sample(range(150), n)]
    texts = _members(spark, ["center of them"] + [" ".join(x) for x in listed])
    n = len(listed) + 1
    pairs = spark.createDataFrame([(7, 0, i) for i in range(1, n)], "key long, a long, b long")
    # half of the first group is one component already
    roots = spark.createDataFrame([(i, 1) for i in range(1, 11)], "node long, root long")
    counted = []
    deal = type(texts).repartition
    monkeypatch.setattr(type(texts), "repartition", lambda self, *a: counted.append(self.count()) or deal(self, *a))
    more = similar.open_links(pairs, roots, texts, neardup.document_items, 0.8).collect()
    union = brute.Union(n)
    for i in range(2, 11):
        union.join(1, i)
    for r in more:
        union.join(r.a, r.b)
    want = brute.classes([brute.word_shingles("center of them")] + [brute.word_shingles(" ".join(x)) for x in listed])
    assert [[union.find(i) == union.find(j) for j in range(n)] for i in range(n)] == [[a == b for b in want] for a in want]
    assert counted[-1] <= n * (2 + n // block)


def test_blocks_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 2)
    test_links_between_members_that_differ_from_the_least(spark)


@pytest.mark.parametrize("parts", [1, 4])
def test_pairs_cross_batches_and_hot_keys(parts):
    rng = np.random.default_rng(3)
    keys = np.concatenate([np.full(900, 5), [-6, 1 << 62, 1 << 62], rng.integers(-1 << 62, 1 << 62, 50)])
    nodes = np.concatenate([np.arange(900) % 450, [1, 2, 2], np.arange(1000, 1050)])
    sent = similar.keyed_batch(keys, nodes, parts)
    assert sent.num_rows == parts and sum(len(x) for x in sent.column("keys").to_pylist()) == 8 * 53  # one a key
    assert sum(len(x) for x in sent.column("local").to_pylist()) == 24 * 449
    twice = pa.Table.from_batches([sent, sent])
    seen = {}
    for p in range(parts):
        rows = twice.filter(pa.array([x == p for x in twice.column("part").to_pylist()]))
        for size in (1, 5000):
            found = [r for b in similar._pair_up(iter(rows.to_batches(max_chunksize=size))) for r in b.to_pylist()]
            seen.setdefault(size, []).extend((r["key"], r["a"], r["b"]) for r in found)
    assert sorted(seen[1]) == sorted(seen[5000])
    union = brute.Union(450)
    for key, a, b in seen[1]:
        assert key == 5
        union.join(a, b)
    assert len({union.find(i) for i in range(450)}) == 1
    with_nothing = similar.keyed_batch(keys[:0], nodes[:0], parts)
    assert [b.num_rows for b in similar._pair_up(iter([with_nothing]))] == [0]


def test_broadcast_and_shuffled_joins_agree(docs, monkeypatch):
    want = sorted(map(repr, neardup.near_duplicates(docs).collect()))
    monkeypatch.setattr(similar, "BROADCAST_ROWS", -1)
    assert sorted(map(repr, neardup.near_duplicates(docs).collect())) == want


def test_empty_tables(empty):
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.drop_near_duplicates(empty).count() == 0
    assert lines.line_classes(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
