"""Packing and mixing: nothing lost or split, capacities and repeats kept, shares near their targets."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lanternfish.llm import mixing, packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=25), st.just(40))
def test_plan_uses_every_item_once(counts, capacity):
    sizes, numbers = np.array(list(counts)), np.array(list(counts.values()))
    p = packing.plan(sizes, numbers, capacity)
    load = {}
    for s, n in counts.items():
        t = p[p["size"] == s].sort_values("since")
        assert t["since"].iloc[0] == 0 and t["until"].iloc[-1] == n and (t["since"].iloc[1:].to_numpy() == t["until"].iloc[:-1].to_numpy()).all()
        for r in t.itertuples():
            for i in range(r.until - r.since):
                load[r.base + i // r.per] = load.get(r.base + i // r.per, 0) + s
    assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
    total = int((sizes * numbers).sum())
    assert len(load) <= 2 * -(-total // capacity)


def test_exact_complements_are_found():
    p = packing.plan(np.array([30, 10, 25, 5, 40]), np.array([7, 7, 3, 9, 2]), 40)
    assert p["base"].max() + 1 <= -(-(30 * 7 + 70 + 75 + 45 + 80) // 40) + 1


def test_pack_rows(spark):
    items = [(i, t) for i, t in enumerate([5, 5, 3, 7, 10, 23, 0, None, 2, 8, 1, 9, 4, 6] * 9)]
    df = spark.createDataFrame(items, "doc_id long, tokens long")
    caps = spark.createDataFrame([(1, 10), (2, 64), (3, 0), (None, 5)], "pack_id int, capacity_tokens int")
    rows = packing.pack(df, caps).collect()
    for p, c in ((1, 10), (2, 64)):
        mine = [r for r in rows if r.pack_id == p]
        size = {}
        for r in mine:
            size[r.container] = size.get(r.container, 0) + r.n_tokens
        assert max(size.values()) <= c and sorted(size) == list(range(len(size)))
        parts = {}
        for r in mine:
            parts.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        for i, t in items:
            if not t:
                assert i not in parts
                continue
            at = 0
            for s, n in sorted(parts[i]):
                assert s == at
                at += n
            assert at == t and (len(parts[i]) == 1 or t > c)
        assert len(size) <= -(-sum(t or 0 for _, t in items) // c) + 1
    assert {r.pack_id for r in rows} == {1, 2}
    report = {r.pack_id: r for r in packing.fill_report(packing.pack(df, caps), caps).collect()}
    assert report[1].unused_share < 0.03
    assert packing.pack(df.where("false"), caps).count() == 0 and packing.pack(df, caps.where("false")).count() == 0


@pytest.mark.parametrize("n", [3, 50, 700])
def test_flight_keeps_the_sums(n):
    rng = np.random.default_rng(n)
    size, chance = rng.integers(1, 900, n).astype(float), rng.uniform(0.05, 0.95, n)
    p = mixing.flight(size, chance, rng)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - chance.sum()) < 1e-6 and abs((p * size).sum() - (chance * size).sum()) < 1e-4


def test_flight_is_unbiased():
    size, chance = np.array([5.0, 9, 14, 3, 7, 11]), np.array([0.2, 0.5, 0.7, 0.4, 0.6, 0.3])
    got = np.mean([mixing.flight(size, chance, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.abs(got - chance).max() < 0.04


def test_mix_reaches_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(i, s, int(rng.integers(20, 400))) for i, s in enumerate(["Big"] * 900 + ["mid "] * 200 + ["small_one"] * 9 + [None] * 5 + ["other"] * 20)]
    rows += [(5000, "Big", 0), (5001, "Big", None)]
    records = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small-one", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    # A total that every source can supply its share of.
    out = mixing.mix(records, targets, total_tokens=45_000).collect()
    assert len({r.doc_id for r in out}) == len(out) and {r.source for r in out} == {"big", "mid", "small-one"}
    limit = {"big": 1, "mid": 2, "small-one": 4}
    assert all(1 <= r.copies <= limit[r.source] for r in out)
    total = sum(r.tokens * r.copies for r in out)
    for s, share in (("big", 0.5), ("mid", 0.3), ("small-one", 0.15)):
        assert abs(sum(r.tokens * r.copies for r in out if r.source == s) / total - share / 0.95) < 0.01
    report = {r.source: r.actual_share for r in mixing.share_report(spark.createDataFrame(out), targets).collect()}
    assert report["absent"] == 0.0 and abs(sum(report.values()) - 1) < 1e-9
    assert mixing.mix(records.where("false"), targets).count() == 0


def test_short_source_moves_neither_total_nor_other_shares(spark):
    rng = np.random.default_rng(6)
    rows = [(i, s, int(rng.integers(20, 400))) for i, s in enumerate(["big"] * 900 + ["mid"] * 700)]
    tiny = [(9000 + i, "tiny", 50) for i in range(3)]
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 1), ("tiny", 0.3, 2)], "source string, target_share double, max_repeats int")
    for have in (rows, rows + tiny):
        out = mixing.mix(spark.createDataFrame(have, "doc_id long, source string, tokens long"), targets).collect()
        got = {s: sum(r.tokens * r.copies for r in out if r.source == s) for s in ("big", "mid", "tiny")}
        total = sum(t for _, _, t in have) * mixing.TOTAL_SHARE
        assert got["tiny"] == (300 if have is not rows else 0)
        assert abs(sum(got.values()) - total) < 0.01 * total
        assert abs(got["big"] / (got["big"] + got["mid"]) - 4 / 7) < 0.01


def test_dues_fill_up_in_proportion():
    assert mixing.dues({"a": 10.0, "b": 100.0, "c": 100.0}, {"a": 0.5, "b": 0.25, "c": 0.25}, 100.0) == pytest.approx({"a": 10, "b": 45, "c": 45})
    assert mixing.dues({"a": 10.0}, {"a": 1.0}, 100.0) == {"a": 10.0}
    assert mixing.dues({}, {}, 0.0) == {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=30, max_size=30), st.integers(1, 29))
def test_triples_and_pairs_are_found_whenever_they_exist(numbers, total):
    counts = np.array([0, *numbers[:29]])
    index = packing._Index(counts)
    have = [s for s in range(1, 30) for _ in range(counts[s])]
    pair = any(a + b == total for i, a in enumerate(have) for b in have[i + 1 :])
    triple = any(a + b + c == total for i, a in enumerate(have) for j, b in enumerate(have[i + 1 :], i + 1) for c in have[j + 1 :])
    assert bool(index.pair(total)) == pair and bool(index.triple(total)) == triple
    for search in (index.pair, index.triple):
        found = search(total)
        assert not found or sum(found) == total and index.take(found)
    fresh = packing._Index(counts.copy())
    assert (fresh.pairs == index.pairs).all() and (fresh.twice == index.twice).all()
