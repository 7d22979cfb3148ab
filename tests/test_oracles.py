"""Every core query against its SQL on the smallest tables; for some, and all without SQL, what must hold of their rows."""

from __future__ import annotations

import os

import pytest

from lanternfish.plans import registry
from tests.compare import connection, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


INVARIANTS = {}


def invariant(f):
    INVARIANTS[f.__name__] = f
    return f


@invariant
def p1_found(spark, df):
    rows = df.collect()
    assert rows and len(rows) == len(set(rows)) and {r.change_kind for r in rows} <= {"added", "removed", "renamed", "retyped"}
    assert all((r.new_path != "") == (r.change_kind == "renamed") for r in rows)
    used = [(r.producer_id, r.artifact, r.file_seq, r.field_path) for r in rows]
    assert len(used) == len(set(used))


@invariant
def p1_records(spark, df):
    assert df.count() == spark.read.parquet(f"{FOLDER}/artifact_records.parquet").count()
    assert df.select("record_id").distinct().count() == df.count()


@invariant
def p1_failed_casts(spark, df):
    assert all(r.n_failed > 0 and r.type != r.target for r in df.collect())


@invariant
def p4_found(spark, df):
    rows = df.collect()
    assert rows and len(rows) == len(set(rows)) and all(r.ord >= 0 and r.parent_ord >= -1 for r in rows)


@invariant
def p4_nodes(spark, df):
    assert df.count() > 0


@invariant
def p4_findings(spark, df):
    held = {(r.report_id, r.ord) for r in registry.queries()["p4_found"](spark, FOLDER).where("child LIKE '%_finding'").collect()}
    assert {(r.report_id, r.ord) for r in df.select("report_id", "ord").collect()} == held


@invariant
def p4_leaves(spark, df):
    listed = registry.queries()["p4_found"](spark, FOLDER).where("child = 'merkle_leaf'").count()
    assert df.count() >= listed > 0


@invariant
def p4_risks(spark, df):
    assert df.count() == df.distinct().count() > 0


@invariant
def persuasion(spark, df):
    rows = df.collect()
    for key in ({(r.file_id, r.rule_id) for r in rows}, {(r.file_id, r.line) for r in rows}):
        assert len(key) == len(rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    sql = registry.oracle_sql().get(name)
    assert sql or name in INVARIANTS
    if name in INVARIANTS:
        INVARIANTS[name](spark, df)
    if sql is None:
        return
    _, only_spark, only_sql = difference(df, connection(FOLDER), sql)
    assert not only_spark and not only_sql, (only_spark[:3], only_sql[:3])
