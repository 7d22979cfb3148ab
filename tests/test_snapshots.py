"""Snapshot changes: defined cases, large snapshots and many keys."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lanternfish.functions.normalize import clean_hash, clean_path
from lanternfish.operators import snapshots as S
from lanternfish.sources import storage

LEAVES = "package_id string, snapshot_no int, idx long, path string, hash string, received_at timestamp_ntz, count long"


def run(spark, leaves, locks=()):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(p, n, i, path, h, t0 + dt.timedelta(hours=at), 1) for i, (p, n, path, h, at) in enumerate(leaves)]
    df = spark.createDataFrame(rows, LEAVES)
    snaps = spark.createDataFrame(list(locks), "package_id string, snapshot_no int, path string")
    out = S.snapshot_changes(df, snaps, group="package_id", number="snapshot_no", key=clean_path(F.col("path")), value=clean_hash(F.col("hash")), at="received_at", idx="idx")
    return {tuple(r) for r in out.select("package_id", "snapshot_no", "key", "change_kind").collect()}


def test_defined_cases(spark):
    h = ["sha256:" + c * 64 for c in "abc"]
    leaves = [
        ("p", 1, "./x//y.py", h[0], 0), ("p", 1, "gone", h[0], 0), ("p", 1, "late", h[0], 0), ("p", 1, "late", h[1], 9), ("p", 1, None, h[0], 0), ("p", 1, "n", None, 0),
        ("p", 4, "x\\y.py", " " + h[0].upper() + " ", 0), ("p", 4, "late", "b" * 64, 0), ("p", 4, "new", h[2], 0), ("p", 4, "n", h[0], 0), ("p", 4, "new", h[2], 0),
        (None, 1, "a", h[0], 0), ("p", None, "a", h[0], 0),
    ]
    got = run(spark, leaves, [("p", 6, "x"), ("q", 1, "x")])
    four = {("p", 4, "gone", "removed"), ("p", 4, "new", "added")}
    six = {("p", 6, k, "removed") for k in ("x/y.py", "late", "new", "n")}
    assert got == four | six


def test_empty_tables(spark):
    assert run(spark, []) == set()


@pytest.mark.parametrize(("width", "broadcast"), [(50, 100), (50, 0), (2, 100)])
def test_large_snapshots_are_split(spark, monkeypatch, width, broadcast):
    monkeypatch.setattr(S, "NODE_ROWS", width)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    state, leaves, want = {}, [], set()
    for n in range(1, 5):
        new = dict(state)
        for _ in range(60):
            new[f"f{rng.randrange(900)}"] = f"{rng.randrange(10**9):064x}"
        for k in rng.sample(sorted(new), 20):
            del new[k]
        if n > 1:
            want |= {("p", n, k, "added") for k in new.keys() - state.keys()} | {("p", n, k, "removed") for k in state.keys() - new.keys()}
            want |= {("p", n, k, "changed") for k in new.keys() & state.keys() if new[k] != state[k]}
        leaves += [("p", n, k, v, 0) for k, v in new.items() for _ in range(3)]
        state = new
    assert run(spark, leaves) == want


def test_many_snapshots_and_large_groups_are_not_broadcast_by_the_size_of_their_files(spark, monkeypatch):
    # Links take under 2 bytes each as files: Spark's 10 MB of them are millions of rows in the driver.
    leaves = [(f"p{g}", n, i, f"f{i}", f"{n * i:064x}", dt.datetime(2025, 1, 1), 1) for g in range(40) for n in (1, 2) for i in range(3)]
    df = spark.createDataFrame(leaves, LEAVES)
    monkeypatch.setattr(S, "NODE_ROWS", 2)

    def changes():
        return S.snapshot_changes(df, df, group="package_id", number="snapshot_no", key=F.col("path"), value=F.col("hash"), at="received_at", idx="idx")

    want = {tuple(r) for r in changes().collect()}
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 30)
    got = changes()
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == want and len(want) == 80


def test_nodes_stay_as_wide_when_rows_double(spark, monkeypatch):
    monkeypatch.setattr(S, "NODE_ROWS", 64)
    widest = []
    for n in (4_000, 8_000, 16_000):
        rows = spark.range(n).select(F.lit("p").alias("g"), F.lit(1).alias("s"), F.xxhash64("id").alias("k"))
        placed = S._with_bits(rows, S.large_groups(rows, "g", "s")).groupBy(S.node_of(F.col("k"), F.col("bits")).alias("node")).count()
        widest.append(placed.agg(F.max("count")).first()[0])
    assert max(widest) < 1.2 * min(widest) < 2 * 64


def test_neighbours_across_blocks(spark):
    df = spark.createDataFrame([("p", n) for n in (1, 5, 1023, 1024, 9000)], "g string, n int")
    got = {(r.n, r.prev_no, r.next_no) for r in S.snapshot_links(df, "g", "n").collect()}
    assert got == {(1, None, 5), (5, 1, 1023), (1023, 5, 1024), (1024, 1023, 9000), (9000, 1024, None)}
