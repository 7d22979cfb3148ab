"""Shredding against a plain walk, and its defined cases."""

from __future__ import annotations

import json
import os

import pytest

from lanternfish.operators.shredding import Child, Shape, element_listing, entity_table, shred
from lanternfish.plans import data_problems as P

FOLDER = "/root/testdata/sf0.01"


def held(v):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        return w if isinstance(w, (list, dict)) else v
    return v


def array(v):
    v = held(v)
    return [] if v is None else v if isinstance(v, list) else [v]


def obj(v):
    v = held(v)
    return v if isinstance(v, dict) else {}


def walk(body):
    """(child, parent_ord, ord, item) of one report, written out part by part."""
    top = obj(json.loads(body))
    det, eph = obj(top.get("deterministic")), obj(top.get("ephemeral"))
    tree, tax = obj(det.get("merkle_tree")), obj(eph.get("taxonomy"))
    out = []

    def elements(kind, v, item, parent=-1):
        found = []
        for i, x in enumerate(array(v)):
            if x is None:
                continue
            x = held(x) if item else x
            out.append((kind, parent, i, (x.get(item) if isinstance(x, dict) else x) if item else x))
            found.append((i, x if isinstance(x, dict) else {}))
        return found

    elements("merkle_leaf", tree.get("leaves"), "path")
    elements("merkle_node", tree.get("nodes"), None)
    for side in ("prohibited", "restricted"):
        for i, f in elements(f"{side}_finding", det.get(f"{side}_findings"), "file"):
            elements(f"{side}_scope", obj(f.get("capability")).get("scope"), None, i)
            elements(f"{side}_tag", f.get("tags"), None, i)
    elements("external_binary", det.get("external_binaries"), None)
    for i, r in elements("combination_risk", det.get("combination_risks"), "rule_id"):
        elements("matched_capability", r.get("matched_capabilities"), None, i)
    for i, m in elements("meta_insight", det.get("meta_insights"), "category"):
        elements("meta_evidence", m.get("evidence"), None, i)
    elements("unresolved_scope", eph.get("unresolved_scope_analysis"), "file")
    elements("permission_overreach", tax.get("permission_overreach"), None)
    return out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_against_plain_walk(spark):
    last = {}
    for r in spark.read.parquet(f"{FOLDER}/scan_reports.parquet").collect():
        if r.report_id not in last or (r.received_at, r.body) > (last[r.report_id].received_at, last[r.report_id].body):
            last[r.report_id] = r
    want = set()
    for r in last.values():
        try:
            want |= {(r.report_id, *x) for x in walk(r.body)}
        except ValueError:
            pass
    got = [tuple(r) for r in P.p4_found(spark, FOLDER).select("report_id", "child", "parent_ord", "ord", "item").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_defined_cases(spark):
    shape = Shape(frozenset(["a", "a[].t"]), frozenset(["a[]"]))
    bodies = ['{"a": [{"n": "x", "t": "one"}, null, {"t": ["p", null, "q"]}]}', '{"a": "[{\\"n\\": 5}]"}', '{"a": {"n": "solo"}}', "{broken", None, "[]", '{"a": null}', "NaN"]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    nodes = shred(df, "id", "body", shape)
    got = sorted(tuple(r) for r in element_listing(nodes, {"a": Child("a", "n"), "t": Child("a[].t", "", "a")}).collect())
    assert got == [(0, "a", -1, 0, "x"), (0, "a", -1, 2, None), (0, "t", 0, 0, "one"), (0, "t", 2, 0, "p"), (0, "t", 2, 2, "q"), (1, "a", -1, 0, "5"), (2, "a", -1, 0, "solo")] or sorted(got, key=str) == sorted(
        [(0, "a", -1, 0, "x"), (0, "a", -1, 2, None), (0, "t", 0, 0, "one"), (0, "t", 2, 0, "p"), (0, "t", 2, 2, "q"), (1, "a", -1, 0, "5"), (2, "a", -1, 0, "solo")], key=str
    )
    flat = {(r.record, r.ord): r.n for r in entity_table(nodes, "a", {"n": "n"}).collect()}
    assert flat == {(0, 0): "x", (0, 2): None, (1, 0): "5", (2, 0): "solo"}
    assert shred(df.where("id < 0"), "id", "body", shape).count() == 0


def test_long_and_deep(spark):
    deep = "[" * 3000 + "]" * 3000
    df = spark.createDataFrame([(1, json.dumps({"a": ["x" * 200_000]})), (2, deep)], "id long, body string")
    rows = shred(df, "id", "body", Shape(frozenset(), frozenset())).collect()
    assert max(len(r.scalar or "") for r in rows) == 200_000
