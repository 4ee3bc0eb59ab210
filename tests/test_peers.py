"""Neighbours and peer statistics against brute force and hand-made rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelscope import schema
from panelscope.operators import knn, peers

COLUMNS = "inst_id string, name string, city string, state string, year int, " + ", ".join(
    f"{m} long" for m in schema.METRICS
)


def inst_row(i, year, total, parts=None, name=None, state="S0"):
    parts = parts or [total, 0, 0, 0, 0, 0]
    return (i, name or f"N{i}", "c", state, year, total, *parts)


def brute_knn(features, k):
    rows = sorted(features.select("inst_id", *schema.METRICS).collect())
    ids = np.array([r[0] for r in rows])
    logs = np.log1p(np.array([r[1:] for r in rows], dtype=float))
    sd = logs.std(axis=0)
    z = (logs - logs.mean(axis=0)) / np.where(sd > 0, sd, 1)
    out = {}
    for i, target in enumerate(ids):
        d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        order = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:k]
        out[target] = [ids[j] for j in order if np.isfinite(d[j])]
    return out


def as_lists(edges):
    out = {}
    for r in sorted(edges.collect(), key=lambda r: (r["target_id"], r["rank"])):
        out.setdefault(r["target_id"], []).append(r["peer_id"])
    return out


@pytest.fixture(scope="module")
def crowd(spark):
    """600 entities; a third share one vector, one source is constant."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        if i % 3 == 0:
            parts = [100, 100, 100, 100, 100, 7]
        else:
            parts = [int(np.exp(rng.gauss(10, 2))) for _ in range(5)] + [7]
        rows.append(inst_row(f"{i:04d}", 2020, sum(parts), parts, state=f"S{i % 5}"))
    return spark.createDataFrame(rows, COLUMNS).cache()


@pytest.mark.parametrize("leaf_size,visitors", [(1024, 10**6), (32, 10**6), (32, 20), (1024, 50)])
def test_knn_with_copies(crowd, leaf_size, visitors):
    features = knn.feature_rows(crowd)
    got = as_lists(knn.knn_edges(features, 6, leaf_size=leaf_size, visitors=visitors))
    assert got == brute_knn(features, 6)


@pytest.mark.parametrize("leaf_size", [1024, 16])
def test_served_peers_equal_the_edge_table(spark, crowd, tmp_path, leaf_size):
    features = knn.feature_rows(crowd)
    every = as_lists(knn.knn_edges(features, 6, leaf_size=leaf_size))
    knn.PeerModel.fit(features, str(tmp_path), 6, leaf_size=leaf_size)
    model = knn.PeerModel(spark, str(tmp_path))  # from the stored files alone
    some = features.where("inst_id < '0090'")
    assert as_lists(model.peers(some, visitors=20)) == {i: v for i, v in every.items() if i < "0090"}
    assert {len(v) for v in as_lists(model.peers(some, 2)).values()} == {2}
    # vectors that were not fitted, far from all and equal to some
    new = [inst_row("n1", 2021, 12, [1, 1, 1, 1, 1, 7]), inst_row("n2", 2021, 507, [100, 100, 100, 100, 100, 7]),
           inst_row("n3", 2021, 10**12, [10**12, None, 0, 0, 0, 7])]
    asked = spark.createDataFrame(new, COLUMNS)
    got = as_lists(model.peers(asked))
    rows = sorted(features.select("inst_id", *schema.METRICS).collect())
    logs = np.log1p(np.array([r[1:] for r in rows], dtype=float))
    sd = np.where(logs.std(axis=0) > 0, logs.std(axis=0), 1)
    for r in new:
        v = (np.log1p(np.array([x or 0 for x in r[5:]], dtype=float)) - logs.mean(axis=0)) / sd
        d = np.sqrt((((logs - logs.mean(axis=0)) / sd - v) ** 2).sum(axis=1))
        order = sorted(range(len(rows)), key=lambda j: (round(d[j], 9), rows[j][0]))[:6]
        assert got[r[0]] == [rows[j][0] for j in order]
    with pytest.raises(ValueError):
        model.peers(some, 7)
    assert model.peers(asked.where("false")).count() == 0


def test_knn_tied_leaf_is_cut_into_blocks(spark):
    """Vectors that no cut can separate still give bounded blocks and right results."""
    rows = [inst_row(f"{i:04d}", 2020, 1000 + i // 100, [1000 + i // 100, 0, 0, 0, 0, i % 2]) for i in range(400)]
    features = knn.feature_rows(spark.createDataFrame(rows, COLUMNS))
    assert as_lists(knn.knn_edges(features, 3, leaf_size=2)) == brute_knn(features, 3)


def test_knn_fewer_entities_than_k(spark):
    rows = [inst_row(f"{i}", 2020, 10 + i) for i in range(3)]
    edges = knn.knn_edges(knn.feature_rows(spark.createDataFrame(rows, COLUMNS)), 10)
    assert {k: len(v) for k, v in as_lists(edges).items()} == {"0": 2, "1": 2, "2": 2}


def test_features_fill_and_drop(spark):
    nothing = ("x", "X", "c", "S", 2020, *[None] * 7)
    partly = ("y", "Y", "c", "S", 2020, 5, None, None, None, None, None, None)
    old = inst_row("z", 2019, 5)
    rows = knn.feature_rows(spark.createDataFrame([nothing, partly, old], COLUMNS)).collect()
    assert [(r["inst_id"], r["federal"]) for r in rows] == [("y", 0)]


def brute_parity(rows, k, tolerance=0.2):
    out = {}
    for target, total in rows:
        near = sorted((abs(t - total), i) for i, t in rows
                      if i != target and total * (1 - tolerance) <= t <= total * (1 + tolerance))
        if near:
            out[target] = [i for _, i in near[:k]]
    return out


def test_parity(spark):
    rng = random.Random(5)
    totals = [(f"{i:04d}", 5000 if i % 3 == 0 else rng.randint(0, 20000)) for i in range(400)]
    inst = spark.createDataFrame([inst_row(i, 2019, t) for i, t in totals], COLUMNS)
    assert as_lists(peers.parity_edges(inst, 2019)) == brute_parity(totals, 8)


def test_state_edges_come_from_the_wide_table(spark, crowd):
    features = knn.feature_rows(crowd)
    wide = brute_knn(features, 40)
    state = {r["inst_id"]: r["state"] for r in features.collect()}
    want = {t: [p for p in near if state[p] == state[t]][:4] for t, near in wide.items()}
    got = as_lists(peers.state_edges(knn.knn_edges(features, 40), features, 4))
    assert got == {t: near for t, near in want.items() if near}


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        inst_row("a", 2015, 100, name="Old A"), inst_row("a", 2020, 200, name="New A"),
        inst_row("b", 2015, 100), inst_row("b", 2020, 400),
        inst_row("c", 2017, 100), inst_row("c", 2020, 80),   # enters late
        inst_row("d", 2015, 0), inst_row("d", 2020, 50),     # zero at the start
        inst_row("e", 2015, 10),                             # left the panel
    ]
    edges = [("a", p, i + 1, 0.0) for i, p in enumerate("bcde")] + [("e", "a", 1, 0.0)]
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(edges, schema.EDGES)


def test_peer_growth(small):
    inst, edges = small
    rows = {r["target_id"]: r for r in peers.peer_growth(inst, edges, 2015, 2020).collect()}
    # over five years a doubles (14.9), b quadruples (32.0); c loses over three (-7.2); d, e have no rate
    a = rows["a"]
    assert a["target_cagr"] == pytest.approx(14.9) and a["peer_avg_cagr"] == pytest.approx(12.4)
    assert (a["growth_rank"], a["total_in_group"]) == (2, 3)
    assert rows["e"]["target_cagr"] == 0.0 and (rows["e"]["growth_rank"], rows["e"]["total_in_group"]) == (2, 1)
    unranked = peers.peer_growth(inst, edges, 2015, 2020, ranked=False).collect()
    assert {r["growth_rank"] for r in unranked} == {None}


def test_peer_trend_and_band(small):
    inst, edges = small
    trend = peers.peer_trend(inst, edges, 2015, 2020)
    rows = {(r["target_id"], r["inst_id"], r["year"]): r for r in trend.collect()}
    assert rows["a", "a", 2015]["name"] == "New A"     # renamed: the current name
    assert rows["a", "e", 2015]["name"] == "Ne"        # gone: the name it had
    assert rows["a", "a", 2015]["is_target"] and not rows["a", "b", 2015]["is_target"]
    band = {(r["target_id"], r["year"]): r for r in peers.peer_band(trend).collect()}
    assert (band["a", 2020]["peer_min"], band["a", 2020]["peer_max"]) == (50, 400)
    assert band["a", 2020]["peer_mean"] == pytest.approx(530 / 3, abs=0.01)


def test_gap_skips_peers_without_features(small):
    inst, edges = small
    gap = {(r["target_id"], r["metric"]): r for r in peers.peer_gap(knn.feature_rows(inst), edges).collect()}
    assert gap["a", "total_rd"]["peer_avg"] == pytest.approx(530 / 3, abs=0.01)
    assert gap["a", "total_rd"]["gap"] == pytest.approx(200 - 530 / 3, abs=0.01)
    assert ("e", "total_rd") not in gap


def test_landing_signal_priorities(spark):
    move = spark.createDataFrame(
        [("a", 12, 40), ("b", 12, 40), ("c", -15, 90), ("d", 0, 5), ("e", 0, 5), ("f", 0, 9)],
        "inst_id string, rank_change int, current_rank int")
    growth = spark.createDataFrame(
        [("a", 9.0, 3.0, 2, 11), ("b", 9.0, 3.0, 5, 11), ("c", 3.0, 3.0, 6, 11), ("d", 3.0, 3.5, 6, 11),
         ("f", 1.0, 9.0, 9, 11)],
        "target_id string, target_cagr double, peer_avg_cagr double, growth_rank int, total_in_group int")
    told = spark.createDataFrame([("d", "Math", 30.0)], "inst_id string, top_field string, top_field_pct double")
    got = {r["inst_id"]: (r["signal"], r["value"]) for r in peers.landing_signal(move, growth, told).collect()}
    assert got == {
        "a": ("growth_leader", 2.0), "b": ("growth_faster", 6.0), "c": ("rank_fell", 15.0),
        "d": ("largest_field", 30.0), "e": (None, None), "f": ("growth_laggard", 9.0),
    }


def test_effective_edges(spark):
    rows = [inst_row(i, y, 10) for i in "abc" for y in range(2015, 2021)] + [inst_row("n", 2020, 10)]
    inst = spark.createDataFrame(rows, COLUMNS)
    prefs = spark.createDataFrame(
        [("u1", "Na", ["Nb", "Na", "Nobody", "Nn"]), ("u2", "Na", ["Na"]), ("u3", "Gone", ["Nb"]), ("u4", "Nb", [])],
        "user_id string, institution string, custom_peers array<string>")
    benchmark = spark.createDataFrame([("a", "c", 1, 0.1), ("b", "a", 1, 0.1)], schema.EDGES)
    got = sorted(tuple(r) for r in peers.effective_edges(prefs, inst, benchmark).collect())
    # n is new, so not on the picker's list; u2 named only the target itself
    assert got == [("u1", "a", "b", "custom"), ("u2", "a", "c", "benchmark"), ("u4", "b", "a", "benchmark")]


def test_pairs_of_a_task_are_bounded(spark, monkeypatch):
    """More neighbours make smaller parts of a crowded block, with the same edges."""
    rows = spark.range(600).select(
        F.format_string("%05d", "id").alias("inst_id"),
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1000)).alias(m) for i, m in enumerate(schema.METRICS)])
    whole = sorted(map(tuple, knn.knn_edges(rows, 50).collect()))
    seen, parts = [], knn._parts
    monkeypatch.setattr(knn, "PAIRS", 5100)
    monkeypatch.setattr(knn, "_parts", lambda visits, most: seen.append(most) or parts(visits, most))
    assert sorted(map(tuple, knn.knn_edges(rows, 50).collect())) == whole
    assert seen == [100]
