"""Hashing, sharding, packing, toxicity, containment and weak labels."""

from __future__ import annotations

import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest

from panelscope.llm import common, contamination, packing, queries, sharding, toxicity, weak_labels


def _slices(texts, limit=64):
    return common.text_slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]),
                              limit=limit)


def test_memory_is_given_back_once_at_the_end(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(len(told)))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None, "b" * 99])], ["text"])
    for last, want in ((False, 0), (True, 1)):
        for part in common.text_slices(iter([batch, batch]), limit=2, last=last):
            assert part.rows.num_rows and not told
        assert len(told) == want
    monkeypatch.undo()
    common.give_back()


def test_words_of_slices_match_the_expression(rows):
    texts, found, prints = [r[1] for r in rows], [], {}
    hasher = common.Hasher()
    for part in _slices(texts):
        starts, ends, doc = common.word_spans(part.data, part.offsets, common.separators())
        hashes = hasher.spans(part.data, starts, ends)
        base = len(found)
        found += [[] for _ in range(part.rows.num_rows)]
        for a, b, d, h in zip(starts, ends, doc, hashes):
            word = bytes(part.data[a:b]).decode()
            found[base + d].append(word)
            assert prints.setdefault(word, h) == h
    assert found == [brute.WORD.findall(t or "") for t in texts]
    assert len(set(prints.values())) == len(prints)


def test_shingles_are_equal_for_equal_words(rows):
    texts = [r[1] for r in rows]
    hasher, seen, base = common.Hasher(), {}, 0
    for part in _slices(texts, 500):
        starts, ends, doc = common.word_spans(part.data, part.offsets, common.separators())
        got, owner = common.shingles(hasher.spans(part.data, starts, ends), doc, part.rows.num_rows)
        for d in range(part.rows.num_rows):
            want = brute.word_shingles(texts[base + d])
            items = got[owner == d]
            assert len(items) == want.total()
            values, counts = np.unique(items, return_counts=True)
            assert sorted(counts) == sorted(want.values())
            seen.setdefault(frozenset(want), set()).add(frozenset(values.tolist()))
        base += part.rows.num_rows
    assert all(len(v) == 1 for v in seen.values())


# sharding

def test_shards_are_even_and_slots_gapless(docs, rows):
    got = sharding.shard_documents(docs, 7).collect()
    assert len(got) == len(rows)
    by = [sorted(r.slot for r in got if r.shard == s) for s in range(7)]
    assert max(map(len, by)) - min(map(len, by)) <= 1 and all(x == list(range(len(x))) for x in by)
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == want


def test_shards_do_not_depend_on_files(docs):
    a, b = (sorted(map(repr, sharding.shard_documents(d, 5).collect()))
            for d in (docs, docs.repartition(7, "text")))
    assert a == b


def test_bounded_loads_keep_movement_small(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    old, new = ({r.doc_id: r.shard for r in sharding.ring_shards(keys, "doc_id", n, load=1.25).collect()}
                for n in (10, 11))
    sizes = np.bincount(list(new.values()))
    assert sizes.max() <= 1.25 * 20_000 / 11 + 1
    moved = np.mean([old[k] != new[k] for k in old])
    assert moved < 0.25  # the fresh share is 0.09; a modulus moves 0.91


def test_overflow_goes_clockwise():
    ring = sharding.virtual_nodes(3, 4, 64)
    placed = sharding.place([(c, 0, 10) for c in range(64)], 3, 4, None, 64)
    assert sum(r.stop - r.start for r in placed) == 640
    for shard in range(3):
        slots = sorted((r.slot, r.stop - r.start) for r in placed if r.shard == shard)
        assert [s for s, _ in slots] == [sum(n for _, n in slots[:i]) for i in range(len(slots))]
    owners = {c: next((s for cell, s in ring if cell >= c), ring[0][1]) for c in range(64)}
    assert any(r.shard != owners[r.cell] for r in placed) and any(r.shard == owners[r.cell] for r in placed)
    with pytest.raises(ValueError):
        sharding.place([(0, 0, 1)], 2, 2, 0.5, 64)


def test_repeated_rows_are_written_as_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "EXPLODE", 7)
    same = spark.range(100).selectExpr("cast(null as long) as doc_id")
    got = sharding.ring_shards(same, "doc_id", 3).collect()
    assert sorted((r.shard, r.slot) for r in got) == sorted(
        (s, i) for s, n in enumerate((34, 33, 33)) for i in range(n))


# packing

def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = packing.hilbert_place(grid, bits)
        assert sorted(place) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def _tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for x in text]


def test_packing_round_trip(docs, rows):
    got = queries.packed(docs).collect()
    want = sorted((zlib.crc32(ids.tobytes()), len(ids)) for ids in _tokens(r[1] for r in rows))
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    whole = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        total = sum(p.length for p in pieces)
        assert total & (total - 1) == 0 and total <= packing.LENGTH  # no padding
        whole += [(p.ids_crc32, p.length) for p in pieces if p.length == p.doc_tokens]
    assert sum(r.length for r in got) == sum(n for _, n in want)
    assert set(whole) <= set(want)
    ids = {r[0]: x for r, x in zip(rows, _tokens(r[1] for r in rows)) if r[0] in (404, 402, 300)}
    for r in got:
        if r.doc_id in ids:
            assert zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes()) == r.ids_crc32


def test_long_texts_are_tokenised_in_parts():
    rng = random.Random(1)
    text = "".join(rng.choice(["a b", "\n", "\n\n", " \nx", "word ", "\t\n ", "é\n", "1\n2"]) for _ in range(5000))
    parts = packing.text_parts(text, 100)
    assert "".join(parts) == text and len(parts) > 20
    assert [i for x in _tokens(parts) for i in x[:-1]] == list(_tokens([text])[0][:-1])


def test_added_tokens_inside_text(spark, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [f"hello {end} world", end, f"{end}{end} a", f"a  {end}\n\n{end}b", "<|endoftext| >", f"x\n{end}\ny",
             "\n".join([f"some words {end}", f"{end} and more", "<|endof", "text|>"] * 50)]
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(x, add_special_tokens=False).ids, packing.END_ID] for x in texts]
    assert want[0][:-1] == [31373, 220, 50256, 995]
    parts = packing.text_parts
    monkeypatch.setattr(packing, "text_parts", lambda x: parts(x, 40))
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                             packing.added_tokens(path))
    assert [encode(x).tolist() for x in texts] == want
    got = queries.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) for i, x in enumerate(want)}
    for r in got:
        ids = np.array(want[r.doc_id][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_long_runs_of_blanks(spark, monkeypatch):
    """As the tokenizers library has them, whatever follows the run."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                             packing.added_tokens(path))
    for blank in (" ", "\n", "\xa0", "\t", "\u3000", " \n"):
        for n in (4095, 4096, 5000):
            for tail in ("", "x", " x", "<|endoftext|>", "é", "\x1cq", "\n1"):
                text = "word" + blank * n + tail
                assert encode(text)[:-1].tolist() == whole.encode(text, add_special_tokens=False).ids
    rng = random.Random(4)
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    parts = packing.text_parts
    monkeypatch.setattr(packing, "text_parts", lambda x: parts(x, 50))
    pieces = ["a", "foo", " ", "  ", "\n", "\n\n", "'s", " 12", "é", "\x1c", "\x85", "!", "<|endoftext|>", "\t"]
    for _ in range(500):
        text = "".join(rng.choice([*pieces, " " * 5000 if rng.random() < 0.05 else " "]) for _ in range(rng.randint(0, 200)))
        assert encode(text)[:-1].tolist() == whole.encode(text, add_special_tokens=False).ids
    texts = ["word" + blank * 2_000_000 + "x" for blank in (" ", "\n", "\xa0")] + [" " * 2_000_000]
    want = [whole.encode(x, add_special_tokens=False).ids for x in texts]
    got = queries.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(x) + 1 for i, x in enumerate(want)}
    for r in got:
        ids = np.array([*want[r.doc_id], packing.END_ID][r.start:r.start + r.length], "<u4")
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_hashes_of_long_texts_in_groups(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(32, 40, 20_000).astype(np.uint8)
    starts, ends, _ = common.word_spans(data, np.array([0, len(data)]), common.separators())
    hasher = common.Hasher()
    want = hasher.spans(data, starts, ends)
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    assert (hasher.spans(data, starts, ends) == want).all()


def test_one_text_of_fifty_megabytes(spark):
    """Every operator that reads texts in tasks takes it whole."""
    from panelscope.llm import lines, neardup

    rng = random.Random(3)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(99999)}" for _ in range(20_000)]
    page = " ".join(words)
    text = "\n".join(f"{i} {page}" for i in range(430))
    assert len(text) > 50_000_000
    docs = spark.createDataFrame([(1, text), (2, page), (4, "short one")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(7, " ".join(words[-30:])), (8, "never there")], "item_id long, text string")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        near = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
        assert near[1] == near[2] == 1 and near[4] == 4
        assert lines.line_classes(docs).count() == 430 + 2
        assert {r.doc_id for r in contamination.contaminated(docs, items).collect()} == {1, 2}
        assert toxicity.toxicity(docs, labels).count() == 3
        assert weak_labels.weak_quality(docs, 4).count() == 3
        packed = queries.packed(docs).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
        assert len(packed) == 3 and all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tail_lengths():
    assert packing.tail_lengths(1234) == [1024, 128, 64, 16, 2] and packing.tail_lengths(0) == []


# toxicity

def _segments(scores):
    """Every subsequence of which no proper part scores as much, and that is maximal (by definition)."""
    n, sums = len(scores), np.concatenate([[0], np.cumsum(scores)])
    good = [(i, j) for i in range(n) for j in range(i + 1, n + 1)
            if sums[j] > sums[i] and all(sums[k] > sums[i] for k in range(i + 1, j + 1))
            and all(sums[k] < sums[j] for k in range(i, j))]
    return {(i, j) for i, j in good if not any(a <= i and j <= b and (a, b) != (i, j) for a, b in good)}


def test_maximal_segments_match_the_definition():
    rng = np.random.default_rng(4)
    for _ in range(300):
        scores = rng.choice([-2.0, -1.0, -0.3, 0.7, 1.1, 3.0], rng.integers(1, 14)) + rng.normal(0, 0.01, 1)
        sums = np.concatenate([[0], np.cumsum(scores)])
        gains = [(i, sums[i], sums[i + 1]) for i in range(len(scores)) if scores[i] > 0]
        got = {(a, b + 1) for a, b, _ in toxicity.maximal_segments(gains)}
        assert got == _segments(scores)


def test_karlin_scale():
    scores, chance = np.array([2.0, -1.0]), np.array([0.2, 0.8])
    scale = toxicity.karlin_scale(scores, chance)
    assert abs((chance * np.exp(scale * scores)).sum() - 1) < 1e-6
    assert toxicity.karlin_scale(np.array([1.0]), np.array([1.0])) == 1.0


def test_toxic_documents_held_out(spark, sf):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(d, labels)
    known = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    assert got.count() == d.count() and len(known) > 500
    order = known.score.rank()
    n1, n0 = known.toxic.sum(), (1 - known.toxic).sum()
    assert (order[known.toxic == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0 > 0.95
    assert known.predicted[known.toxic == 0].mean() < 0.02


def test_toxicity_of_odd_rows(docs, empty, labels, no_labels, rows):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (300, 301, 302)}) == 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    text = {r[0]: r[1] for r in rows if r[0] not in (5, None)}
    assert all(0 <= p.start < p.end <= len(text[r.doc_id]) for r in got
               if r.doc_id in text for p in r.passages)
    assert toxicity.toxicity(docs, no_labels).count() == len(rows)
    assert toxicity.toxicity(empty, no_labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns


# containment

def _words(text):
    table = {c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return brute.WORD.findall(lowered.translate(str.maketrans(table)))


def _plain(text, size=5):
    words = _words(text)
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def _leaks(text, item):
    size = min(len(_words(item)), 5)
    wanted = _plain(item, size) if size else set()
    return wanted and len(_plain(text, size) & wanted) >= 0.8 * len(wanted)


def test_items_in_documents(docs, items, rows, empty, no_items):
    want = {(r[0], r[1], i.item_id) for r in rows for i in items.collect()
            if _leaks(r[1], i.text)}
    got = contamination.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got if r.item_id) == sorted((a, i) for a, _, i in want if i)
    assert len(got) == len(want) and any(i is None for _, _, i in want) and (305, "two words", 5) in want
    kept = contamination.drop_contaminated(docs, items)
    bad = {(a, t) for a, t, _ in want}
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.collect())) == sorted(
        repr(r) for r in docs.collect() if (r.doc_id, r.text) not in bad)
    assert contamination.contaminated(empty, items).count() == 0
    assert contamination.contaminated(docs, no_items).count() == 0


def test_short_items_inside_long_documents(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{rng.randrange(400)}" for _ in range(3000)]
    texts = ["One; two, three FOUR five six. " + " ".join(words), "two three", "two", "Two. Three!", "four three two",
             " ".join(words) + " alpha-beta gamma\ndelta", "", None, " ".join(words[5:9])]
    listed = ["two three", "TWO", "alpha beta gamma delta", "three four two", "nothing here", "", None, "six w w",
              " ".join(words[:4]), " ".join(words[5:9]), " ".join(words[10:30])]
    docs = spark.createDataFrame([*enumerate(texts), (None, "say two three")], "doc_id long, text string")
    items = spark.createDataFrame([*enumerate(listed), (1, "TWO")], "item_id long, text string")
    want = {(d, i) for d, t in [*enumerate(texts), (None, "say two three")] for i, x in enumerate(listed) if _leaks(t, x)}
    assert {(5, 2), (0, 0), (None, 0), (0, 9)} <= want
    for size in (22, 3):  # the bit table holds back hashes only, whatever its size
        monkeypatch.setattr(contamination, "BITS", max(size, 6))
        got = contamination.contaminated(docs, items).collect()
        assert sorted(((r.doc_id, r.item_id) for r in got), key=repr) == sorted(want, key=repr)
        assert all(r.containment == 1 for r in got if r.item_id < 10)
    left = {r.doc_id for r in contamination.drop_contaminated(docs, items).collect()}
    assert left == set(range(len(texts))) - {d for d, _ in want}


# weak labels

def test_repeated_rows_count_once_in_the_training_sample(spark, docs):
    once = docs.select("doc_id", "text").distinct()
    n = once.count()
    codes, counted = weak_labels.count_patterns(once)
    share, table = weak_labels.label_model(codes, counted)
    copies = once.where("doc_id = 1").crossJoin(spark.range(3 * n)).select("doc_id", "text")
    want, bias = weak_labels.train(once, share, table, n)
    got, other = weak_labels.train(copies.union(once), share, table, n)
    assert np.abs(want).max() > 0.01
    assert np.allclose(got, want, atol=1e-6) and abs(bias - other) < 1e-6


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(2)
    n, kind = 50_000, rng.choice(4, 50_000, p=[0.8, 0.08, 0.07, 0.05])
    voted = np.full((n, 3), weak_labels.GOOD)
    for k in range(3):
        bad = rng.random(n) < np.where(kind == k + 1, 0.9, 0.03)
        voted[bad, k] = weak_labels.BAD
        voted[rng.random(n) < 0.1, k] = weak_labels.NONE
    codes, rows = np.unique(weak_labels.pattern_codes(voted), return_counts=True)
    assert (weak_labels.pattern_votes(codes, 3)[np.searchsorted(codes, weak_labels.pattern_codes(voted))] == voted).all()
    share, table = weak_labels.label_model(codes, rows, 3)
    assert abs(share[0] - 0.8) < 0.03
    assert np.abs(table[0, :, weak_labels.BAD] - 0.03).max() < 0.02
    assert all(abs(table[k + 1, k, weak_labels.BAD] - 0.9) < 0.08 for k in range(3))


def test_weak_quality(spark, docs, empty, rows):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = weak_labels.weak_quality(d, 2000).join(labels, "doc_id").toPandas()
    assert known.predicted[known.quality == 1].mean() > 0.97
    assert known.predicted[known.quality == 0].mean() < 0.2
    got = weak_labels.weak_quality(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and len(r.votes) == 8 for r in got)
    assert weak_labels.weak_quality(empty).count() == 0


def test_weak_quality_against_plain_python(spark, rows):
    """Votes, the label model and the scorer; all documents are in the training sample."""
    listed = {(r[0], r[1] or "") for r in rows if len(r[1] or "") < 3000}
    listed |= {(900 + i, x) for i, x in enumerate(["BUY NOW !! " * 12, "# * $ % & | < > a b " * 5, "the the the the " * 10, "é Ö ñ", "wow!! yes!!", "!"])}
    texts = sorted(listed, key=repr)
    voted = [brute.weak_votes(t) for _, t in texts]
    held = brute.weak_posteriors(voted)
    scores = brute.weak_scores([t for _, t in texts], [held[v] for v in voted])
    got = {(r.doc_id, r.votes): r for r in weak_labels.weak_quality(
        spark.createDataFrame(texts, "doc_id long, text string"), 10 * len(texts)).collect()}
    assert len({v for v in voted}) > 5 and len(got) == len({(i, v) for (i, _), v in zip(texts, voted)})
    alone = [i for i, _ in texts]
    for (i, _), v, score in zip(texts, voted, scores):
        assert abs(got[i, v].posterior - held[v]) < 1e-6
        if alone.count(i) == 1:  # equal but for words that share a bucket
            assert abs(got[i, v].score - score) < 0.03


def test_weak_features_do_not_depend_on_neighbours():
    words = weak_labels.Words()
    alone = [weak_labels.features(p, words(p)) for t in ("A", "b", "É", "Cd") for p in _slices([t])]
    for part in _slices(["A", "b", "É", "Cd"]):
        owner, bucket, value = weak_labels.features(part, words(part))
        for i, (_, want, worth) in enumerate(alone):
            assert (bucket[owner == i] == want).all() and (value[owner == i] == worth).all()


def test_movement_of_exact_balance(spark):
    """At the registered setting one more shard moves about a twentieth of different keys; a load factor less."""
    table = spark.createDataFrame([(i, f"text {i}") for i in range(20_000)], "doc_id long, text string")
    places = [{r.doc_id: r.shard for r in sharding.shard_documents(table, n).collect()} for n in (24, 25)]
    moved = sum(places[0][i] != places[1][i] for i in places[0]) / 20_000
    assert 1 / 25 <= moved < 0.12


def test_empty_tables(empty):
    assert sharding.shard_documents(empty).count() == 0
    assert queries.packed(empty).count() == 0


def test_open_buckets_are_cut_at_groups(monkeypatch):
    """Groups of sorted rows are whole however the batches fall."""
    from panelscope.llm import neardup, similar

    monkeypatch.setattr(similar, "AT_ONCE", 3)
    rng = random.Random(2)
    base = [str(rng.random()) for _ in range(60)]
    rows = []
    for key in range(9):
        for i in range(4):
            text = " ".join([*base[:i], "edit", *base[i + 1:]]) if i < 3 else f"alone {key}"
            rows.append({"key": key, "low": 0, "high": 0, "node": 10 * key + i, "root": 10 * key + i,
                         "block": 0, "text": text + f" {key}" * 3})
    table = pa.Table.from_pylist(rows)
    search = similar._search(neardup.document_items, 0.8)
    for size in (1, 5, 100):
        found = [r for b in search(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        union = brute.Union(100)
        for r in found:
            union.join(r["a"], r["b"])
        assert all(len({union.find(10 * k + i) for i in range(3)}) == 1 for k in range(9))
        assert all(r["a"] // 10 == r["b"] // 10 and 3 not in (r["a"] % 10, r["b"] % 10) for r in found)
