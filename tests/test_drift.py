"""Schema drift against a plain version, and its defined cases."""

from __future__ import annotations

import json
import os
from collections import Counter, defaultdict

import pytest

from lanternfish.operators import drift

SCHEMA = "record_id long, producer_id string, artifact string, file_seq int, package_id string, received_at timestamp_ntz, body string, extra string"
FOLDER = "/root/testdata/sf0.001"


def kind(v):
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, dict):
        return "object"
    inner = kind(v[0]) if v and v[0] is not None else ""
    return f"array of {inner}".rstrip()


def fields(v, at=""):
    out = {}
    for k, x in v.items():
        if isinstance(x, dict) and k != "capabilities":
            out |= fields(x, f"{at}{k}.")
        elif x is not None:
            out[at + k] = x
    return out


def brute(rows):
    """All changes by plain loops over (producer, artifact, seq, package, body)."""
    files = defaultdict(list)
    for p, a, s, pkg, body in rows:
        try:
            v = json.loads(body)
            f = fields(v) if isinstance(v, dict) else {}
        except (TypeError, ValueError):
            f = {}
        files[p, a, s].append((pkg, f))
    have = {}
    for key, recs in files.items():
        n = Counter(x for _, f in recs for x in f)
        have[key] = {}
        for x, c in n.items():
            if 2 * c > len(recs):
                t = Counter(kind(f[x]) for _, f in recs if x in f)
                have[key][x] = min(t, key=lambda k: (k == "array of", -t[k], k))
    out = set()
    for p, a in {k[:2] for k in files}:
        seqs = sorted(s for q, b, s in files if (q, b) == (p, a))
        for before, s in zip(seqs, seqs[1:]):
            old, new = have[p, a, before], have[p, a, s]
            gone, come = set(old) - set(new), set(new) - set(old)
            cand = []
            for g in gone:
                for c in come:
                    if old[g] != new[c]:
                        continue
                    x, y = defaultdict(set), defaultdict(set)
                    for recs, f, to in ((files[p, a, before], g, x), (files[p, a, s], c, y)):
                        for pkg, vals in recs:
                            if f in vals:
                                to[pkg].add(json.dumps(vals[f], sort_keys=True))
                    both = set(x) & set(y)
                    same = sum(bool(x[k] & y[k]) for k in both)
                    if both and 2 * same >= len(both) and same:
                        cand.append((-same / len(both), g, c))
            used = set()
            for _, g, c in sorted(cand):
                if ("o", g) not in used and ("n", c) not in used:
                    used |= {("o", g), ("n", c)}
                    out.add((p, a, s, "renamed", g, c))
            out |= {(p, a, s, "removed", g, "") for g in gone if ("o", g) not in used}
            out |= {(p, a, s, "added", c, "") for c in come if ("n", c) not in used}
            out |= {(p, a, s, "retyped", x, "") for x in set(old) & set(new) if old[x] != new[x] and not (old[x].startswith("array") and new[x].startswith("array") and "array of" in (old[x], new[x]))}
    return out


def changes(spark, rows):
    df = spark.createDataFrame([(i, p, a, s, pkg, None, body, "x") for i, (p, a, s, pkg, body) in enumerate(rows)], SCHEMA)
    return {tuple(r) for r in drift.field_changes(drift.load_fields(df)).select(*drift.FILE, "change_kind", "field_path", "new_path").collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_against_brute_force(spark, folder):
    t = spark.read.parquet(f"{folder}/artifact_records.parquet")
    want = brute([tuple(r) for r in t.select("producer_id", "artifact", "file_seq", "package_id", "body").collect()])
    got = {tuple(r) for r in drift.field_changes(drift.load_fields(t)).select(*drift.FILE, "change_kind", "field_path", "new_path").collect()}
    assert got == want and want


def test_defined_cases(spark):
    body = lambda **k: json.dumps(k)
    rows = [
        ("p", "a", 1, "k1", body(x="1", y={"z": 3}, capabilities={"fs": {}}, gone=[])),
        ("p", "a", 1, "k2", body(x="2", y={"z": 4}, capabilities={})),
        ("p", "a", 1, "k3", "{broken"),
        ("p", "a", 5, "k1", body(x=1, w={"q": 3}, capabilities={"fs": {}})),
        ("p", "a", 5, "k2", body(x=2, w={"q": 5}, capabilities={})),
        ("p", "a", 5, None, None),
        ("q", "a", 1, "k1", None),
        ("q", "a", 2, "k1", '["no object"]'),
    ]
    assert changes(spark, rows) == brute(rows) == {("p", "a", 5, "retyped", "x", ""), ("p", "a", 5, "renamed", "y.z", "w.q")}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert drift.field_changes(drift.load_fields(df)).count() == 0


def test_consistent_table_and_failed_casts(spark):
    rows = [("p", "a", 1, "k1", '{"n": 1, "s": "a"}'), ("p", "a", 1, "k2", '{"n": 2, "s": "b"}'), ("p", "a", 2, "k1", '{"m": 1, "s": "a"}'), ("p", "a", 2, "k2", '{"m": "x", "s": "b"}'), ("p", "a", 2, "k4", '{"m": 5}')]
    df = spark.createDataFrame([(i, *r[:4], None, r[4], None) for i, r in enumerate(rows)], SCHEMA)
    loaded = drift.load_fields(df)
    values = drift.unified_values(loaded, drift.field_changes(loaded))
    targets = drift.target_types(values)
    cast = drift.cast_values(values, targets)
    table = {r.record_id: r for r in drift.consistent_table(loaded, cast, targets).collect()}
    assert [table[i].n for i in range(5)] == [1.0, 2.0, 1.0, None, 5.0]
    assert table[3].failed_fields == ["n"] and [r.field for r in drift.failed_casts(cast).collect()] == ["n"]


def typed_table(spark, rows):
    df = spark.createDataFrame([(i, *r[:4], None, r[4], None) for i, r in enumerate(rows)], SCHEMA)
    loaded = drift.load_fields(df)
    values = drift.unified_values(loaded, drift.field_changes(loaded))
    targets = drift.target_types(values)
    cast = drift.cast_values(values, targets)
    return {r.record_id: r for r in drift.consistent_table(loaded, cast, targets).collect()}, drift.failed_casts(cast).collect()


def test_one_name_with_other_types_in_two_artifacts(spark):
    rows = [("p", "lock", 1, "k1", '{"n": 1, "l": ["a"], "s": "x"}'), ("p", "report", 1, "k1", '{"n": "one", "l": "b", "s": "y"}')]
    table, failed = typed_table(spark, rows)
    assert (table[0].lock__n, table[0].report__n, table[1].lock__n, table[1].report__n) == (1.0, None, None, "one")
    assert (table[0].lock__l, table[1].report__l, table[0].s, table[1].s) == (["a"], "b", "x", "y")
    assert failed == [] and table[1].failed_fields == []


def test_a_name_used_again_after_its_rename(spark):
    rows = [("p", "a", 1, "k1", '{"A": "x"}'), ("p", "a", 1, "k2", '{"A": "y"}'), ("p", "a", 2, "k1", '{"B": "x"}'), ("p", "a", 2, "k2", '{"B": "y", "A": "old"}'), ("p", "a", 2, "k3", '{"B": "z"}')]
    rows += [("p", "a", 3, "k1", '{"B": "x", "A": 7}'), ("p", "a", 3, "k2", '{"A": 8}'), ("p", "a", 3, "k3", '{"B": "z", "A": 9}')]
    table, failed = typed_table(spark, rows)
    assert [table[i].A for i in range(8)] == ["x", "y", "x", "y", "z", "x", None, "z"]
    assert table[3]["A#2"] == "old" and [table[i]["A~2"] for i in (5, 6, 7)] == [7.0, 8.0, 9.0]
    assert failed == []
