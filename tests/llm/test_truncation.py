"""Cut-off texts: held-out accuracy on a made corpus, and the defined cases."""

from __future__ import annotations

import random

from lanternfish.llm import truncation as T

NOUNS = "lock report proof scanner policy manifest registry branch verifier archive template digest".split()
VERBS = "checks rejects signs compares repairs lists hides repeats".split()


def sentence(r):
    return f"The {r.choice(NOUNS)} {r.choice(VERBS)} every {r.choice(NOUNS)} before the {r.choice(NOUNS)} of {r.choice(NOUNS)} {r.randrange(90)} is read."


def document(r):
    parts = [" ".join(sentence(r) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(1, 4))]
    if r.random() < 0.4:
        parts.append("\n".join(f"- {r.choice(VERBS)} the {r.choice(NOUNS)}" for _ in range(r.randrange(2, 5))))
    return "\n\n".join(parts)


def test_held_out_accuracy(spark):
    r = random.Random(11)
    rows, cut = [], set()
    for i in range(900):
        t = document(r)
        if i % 8 == 0:
            at = r.randrange(20, len(t) - 6)
            while t[at - 1] in ".\n " or t[at] in ".\n ":
                at = r.randrange(20, len(t) - 6)
            t = t[:at] + r.choice(["", "", "…", "..."])
            cut.add(i)
        rows.append((i, r.choice(["A b", "a_b", "c", None]), t, "en"))
    rows += [(9000, "c", None, "en"), (9001, "c", "", "en"), (9002, None, "   ", "en")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tok string")
    got = {x.doc_id for x in T.truncated(T.truncation_scores(df)).collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.9 and hit / max(1, len(got)) > 0.9
    ids = spark.createDataFrame([(i,) for i in got], "doc_id long")
    rates = {x.source: x for x in T.truncation_rates(df, ids).collect()}
    assert set(rates) == {"a-b", "c", ""} and sum(x.n_docs for x in rates.values()) == len(rows) and sum(x.n_cut for x in rates.values()) == len(got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert T.truncation_scores(df).count() == 0


def test_made_rows_have_the_bucket_of_their_length(spark):
    r = random.Random(5)
    texts = [document(r) for _ in range(300)]
    rows = [(i, "feed", t[:80] if i % 10 < 3 else t[:120] if i % 10 == 3 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    lim = spark.createDataFrame([("feed", 80, 5), ("feed", 120, 3)], "source string, n int, limit int")
    made = df.mapInArrow(T._cutter(2, [("feed", 80), ("feed", 120)]), T._FEATURED)
    none = [spark.createDataFrame([], c) for c in ("tok string, n1 long, e1 long", "tok string, tok2 string, n2 long, e2 long")]
    places = [(x.label, x.n, [f - 160 for f in x.features if 160 <= f < 170]) for x in T._indexed(made, *none, lim).collect()]
    assert all(bucket == [{80: 5, 120: 3}.get(n, 0)] for _, n, bucket in places)
    assert {b[0] for label, _, b in places if label == 1} == {0, 3, 5} and {label for label, *_ in places} == {0, 1}


def test_counts_of_line_ends(spark):
    df = spark.createDataFrame([(1, "A b, c\nb c\n\nx 12\nlast C"), (2, None), (3, "")], "doc_id long, text string")
    got = {(x.tok2, x.tok): (x.n, x.e) for x in T.line_end_counts(df).collect()}
    assert got == {("", "a"): (1, 0), ("a", "b"): (1, 0), ("b", "c"): (2, 2), ("", "b"): (1, 0), ("", "x"): (1, 0), ("x", "0"): (1, 1), ("", "last"): (1, 0)}


def test_counts_take_every_kind_of_line_end_and_blank(spark):
    df = spark.createDataFrame([(1, "a b\r\nc\td\r\n \t\r\ne\rf  g\n"), (2, "  \na b")], "doc_id long, text string")
    got = {(x.tok2, x.tok): (x.n, x.e) for x in T.line_end_counts(df).collect()}
    assert got == {("", "a"): (2, 0), ("a", "b"): (1, 1), ("", "c"): (1, 0), ("c", "d"): (1, 1), ("", "e"): (1, 1), ("", "f"): (1, 0), ("f", "g"): (1, 1)}


def test_long_lines_keep_all_their_features():
    one, two = ("word " * 40 + x + " the end of the lin" for x in ("alpha", "beta"))
    assert T.describe(one)[0] != T.describe(two)[0]
