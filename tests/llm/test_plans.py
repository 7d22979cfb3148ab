"""Every text query on the smallest tables: its columns, and what must hold of its rows."""

from __future__ import annotations

import os

import pytest

from lanternfish.llm import plans

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def rows(spark, name):
    return plans.queries()[name](spark, FOLDER).collect()


def stored(spark, name, *columns):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").select(*columns).collect()


def test_every_query_is_tested():
    assert set(plans.queries()) == {"p2_found", "p2_redacted", "p2_by_context", "p5_found", "p5_rates", "p5_wrong_pairs", "p6_packs", "p6_fill", "p7_mix", "p7_shares", "p8_found", "p8_rates"}


def test_credentials(spark):
    found = plans.queries()["p2_found"](spark, FOLDER)
    assert found.columns == ["file_id", "start_pos", "end_pos"]
    spans = {}
    for r in found.collect():
        spans.setdefault(r.file_id, []).append((r.start_pos, r.end_pos))
    texts = {r.file_id: r.text for r in stored(spark, "source_files", "file_id", "text")}
    blank = {r.file_id: r.text for r in rows(spark, "p2_redacted")}
    assert spans and set(blank) == set(texts)
    for i, t in texts.items():
        if t is None:
            assert blank[i] is None
            continue
        assert len(blank[i]) == len(t)
        inside = {k for s, e in spans.get(i, []) for k in range(s, e)}
        assert all((a == b) if k not in inside else (b == "*" or a in "\r\n" and a == b) for k, (a, b) in enumerate(zip(t, blank[i])))
    by = rows(spark, "p2_by_context")
    assert sum(r.n for r in by if r.decision == "credential") == sum(map(len, spans.values()))


def test_files_that_do_not_parse(spark):
    found = plans.queries()["p5_found"](spark, FOLDER)
    assert found.columns == ["file_id"]
    ids = [r.file_id for r in found.collect()]
    rates = rows(spark, "p5_rates")
    assert ids and len(ids) == len(set(ids)) == sum(r.n_invalid for r in rates) and all(0 <= r.rate == r.n_invalid / r.n_files for r in rates)
    assert all(r.n_files > 0 for r in rows(spark, "p5_wrong_pairs"))


def test_packs_hold_every_token_once(spark):
    packs, fill = rows(spark, "p6_packs"), {r.pack_id: r for r in rows(spark, "p6_fill")}
    capacity = {r.pack_id: r.capacity_tokens for r in stored(spark, "pack_sizes", "pack_id", "capacity_tokens")}
    totals = {}
    for p, most in capacity.items():
        load, parts = {}, {}
        for r in packs:
            if r.pack_id == p:
                load[r.container] = load.get(r.container, 0) + r.n_tokens
                parts.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert max(load.values()) <= most and len(load) == fill[p].n_containers
        for d, pieces in parts.items():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
            assert len(pieces) == -(-at // most)
            assert totals.setdefault(d, at) == at
        assert 0 <= fill[p].unused_share < 0.2
    assert {d for d in totals} == {r.doc_id for r in packs}


def test_mix_keeps_its_limits(spark):
    mixed, shares = rows(spark, "p7_mix"), rows(spark, "p7_shares")
    limit = {r.source: r.max_repeats for r in shares}
    assert mixed and len({r.doc_id for r in mixed}) == len(mixed)
    assert all(1 <= r.copies <= limit[r.source] for r in mixed)
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9 and abs(sum(r.target_share for r in shares) - 1) < 1e-9
    assert {r.source: r.n_tokens for r in shares if r.n_tokens} == {s: sum(r.tokens * r.copies for r in mixed if r.source == s) for s in {r.source for r in mixed}}


def test_cut_documents(spark):
    found = plans.queries()["p8_found"](spark, FOLDER)
    assert found.columns == ["doc_id"]
    ids = [r.doc_id for r in found.collect()]
    texts = {r.doc_id: r.text for r in stored(spark, "documents", "doc_id", "text")}
    assert len(ids) == len(set(ids)) and all(texts[i] and texts[i].strip() for i in ids)
    rates = rows(spark, "p8_rates")
    assert sum(r.n_docs for r in rates) == len(texts) and sum(r.n_cut for r in rates) == len(ids)
