"""Files that don't parse: the token method against full parsers and written cases."""

from __future__ import annotations

import ast
import json
import os
import tomllib
import warnings

import pytest

from lanternfish.llm import grammar, syntax
from lanternfish.llm.lexers import LEXERS

CASES = {
    "py": (["", "x = 1\n", "if a:\n    b\nelse:\n    c\n", "f(a, *b, **c)", "@d\ndef f(a, /, *, b=1) -> int: ...", "x = [i for i in y if i]", "match x:\n    case [1, *r]:\n        pass\n", "try:\n  a\nexcept* E as e:\n  b\nfinally:\n  c", 'print(f"{a!r}")', "lambda: (yield)", "x = br'a' rb\"b\"", "try:\n  a\nexcept (A, B):\n  b", "{a if b else c: lambda: 1}", "if a:\n  b\n  if c:\n    d\ne"],
           ["def f(:", "if a\n    b", "print 'x'", "x = (1", "a b", "<<<<<<< HEAD\nx\n", "class A:\n", "    x = 1", "try:\n    a\n", "x = 6abc", "else:\n    a", "x = 'a", "@d\n", "x = a if b", "try:\n  a\nexcept A, B:\n  b", "if a:\n    b\n  c\n", "f(a if b)", "x:\n  y", "[lambda x]", "x = 012", "x = 'a\n'"]),
    "js": (["", "const a = {b: 1, 'c': [1, 2], d() { return 1; }};", "import x from 'y';\nexport default class { get a() { return 1 } }", "for (const x of y) { z(x) }", "a = b ? c : d", "x = `a${b}c`", "if (a) b(); else c()", "let f = async (x) => { await x; }", "lbl: for (;;) { break lbl; }", "a = /re[/]x/g.test(b)", "switch (a) { case 1: b(); break; default: c() }", "try { a() } catch { b() }", "class A extends B { constructor() { super(); super.f(); } }", "a?.[0]?.b?.(c)", "export { a as default, b as enum };"],
           ["{\n \"name\": \"x\",\n \"y\": {}\n}", "const a: number = 1;", "interface A { b: string }", "if (x {", "function f() {", "});", "const x = 'a", "a b c", "<<<<<<< HEAD\nx();\n", "try { a() }", "return 1;", "let x = `a", "class A { b: 1 }", "f(a; b)", "case 1: x()"]),
    "sh": (["", "if a; then b; fi", "for x in a b; do c; done\n", "case $x in a|b) c ;; *) d ;; esac", "f() {\n  a\n}\n", "cat <<EOT\n'x\nEOT\n", "a | b && c || d &", "x=\"$(a \"$b\")\"", "while read -r l; do echo \"$l\"; done < f", "[[ -n $x ]] && y", "(a; b)", "if ! a; then b; elif c; then d; else e; fi", "x=$(case y in a) b ;; esac)", "if (a) then b; fi", "case x in\n 'a' | \\\n 'b') c ;;\nesac", "a=(b \"c)\" # d)\n e)"],
           ["if a; then b", "fi", "echo 'x", "for x in a; do b", "case x in a) b", "f() {", "<<<<<<< HEAD\na\n>>>>>>> b\n", "a && ", "if a; fi", "done", "echo \"a $(b\"", "x=$(for f in a; do b)", "x=$(\n<<<<<<< HEAD\na\n)", "echo `a"]),
    "json": (["{}", "[1, 2.5e3, \"a\", null, true]", '{"a": {"b": []}}', " 1 "], ["", "{", "[1,]", "{'a': 1}", '{"a": 1,}', "// c\n{}", "NaN", "01", '{"a" 1}', "[1] [2]", '"a\nb"']),
    "toml": (["", "a = 1\n[t]\nb = [1, 2,\n 3]\n", "x.y = 'z' # c\n[[t]]\na = {b = 1}\n[[t]]\n", 'd = 1979-05-27T07:32:00Z\n"q r" = """m\nn"""\n'],
             ["a", "a = ", "[t", "a = 1\na = 2", "a: 1", "x = 'y", "a = {b = 1", "= 3", "a = [1", "a = 1 b = 2", "[a]\n[a]", "a = 01", "a = '''x", "a = \"\\q\"", "a = 1\n[a]"]),
    "yaml": (["", "a: 1\nb:\n  - c\n  - d: e\n", "---\na: |\n  x: [\n b\n...\n", "- a\n- 'b: c'\n", "a: {b: [c, d]}\n", "a: # c\n  b: \"x\n    y\"\n", "# only\n", "a: b\n  - c\n  'd\nb: 1\n", "a: 'x''\n  y'\n", "? a\n: b\n", "a: &b [c, {d: e}, f: g,]\n"], ["a: [b, , c]", "a: b: c", "a: [b", "a:\n\t- b", "a: 'x", "a: b\n c: d\n", "<<<<<<< HEAD\na: 1\n=======\na: 2\n>>>>>>> x\n", "a: 1\n- b\n", "a: \"x\" y\n"]),
}


PERMITTED = syntax.permitted_pairs()


def flagged(spark, rows):
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    return {r.file_id for r in syntax.invalid_files(spark, syntax.lexed(df)).collect()}


def test_written_cases(spark):
    rows, bad = [], set()
    for lang, (good, wrong) in CASES.items():
        for t in [*good, *wrong]:
            if t in wrong:
                bad.add(len(rows))
            rows.append((len(rows), f"a/b.{lang.upper() if len(rows) % 2 else lang}", t))
    rows += [(900, "a.py", None), (901, "a.md", "def ("), (902, "noext", "x")]
    got = flagged(spark, rows)
    assert got == bad, ([rows[i] for i in got - bad], [rows[i] for i in bad - got])


def own_verdict(lang, text):
    """What tokens and nesting say, without the full parser."""
    pairs, nest, keys = LEXERS[lang](text)
    stack = []
    for e in nest:
        if e > 0:
            stack.append(e)
        elif not stack or stack.pop() != -e:
            return False
    return not stack and len(set(keys)) == len(keys) and not pairs - PERMITTED[lang]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_tokens_find_all_that_parsers_reject(spark):
    warnings.simplefilter("ignore")
    parsers = {"py": ast.parse, "json": json.loads, "toml": tomllib.loads}
    missed = wrong = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/source_files.parquet").select("path", "text").collect():
        lang = syntax.LANGUAGES.get(r.path.rsplit(".", 1)[-1].lower())
        if lang not in parsers or r.text is None:
            continue
        try:
            parsers[lang](r.text)
            valid = True
        except (ValueError, SyntaxError):
            valid = False
        ours = own_verdict(lang, r.text)
        missed += ours and not valid
        wrong += valid and not ours
    assert missed == 0 and wrong == 0


def test_truncations_of_valid_files_are_judged_as_by_the_parser():
    source = "import os\n\n\ndef f(a, b=1):\n    if a:\n        return [x for x in (a, b) if x]\n    try:\n        b = {'k': a}\n    except ValueError as e:\n        raise\n    return lambda: b\n"
    for n in range(len(source)):
        try:
            ast.parse(source[:n])
            valid = True
        except SyntaxError:
            valid = False
        if not valid:
            assert not own_verdict("py", source[:n]), source[:n]


def test_grammar_pairs():
    pairs = grammar.permitted("s: A (',' A)* END?", "s")
    assert pairs == {("^", "A"), ("A", ","), (",", "A"), ("A", "END"), ("A", "$"), ("END", "$")}


def test_rates(spark):
    files = spark.createDataFrame([(1, "p", "a.py", "x"), (2, "p", "b.py", "("), (3, "q", "c.sh", "a")], "file_id long, package_id string, path string, text string")
    packages = spark.createDataFrame([("p", "r1"), ("q", None), ("p", "r1")], "package_id string, repository string")
    bad = spark.createDataFrame([(2, "py")], "file_id long, lang string")
    assert sorted(((r.repository, r.lang, r.n_files, r.n_invalid, r.rate) for r in syntax.invalid_rates(files, packages, bad).collect()), key=str) == [("r1", "py", 2, 1, 0.5), (None, "sh", 1, 0, 0.0)]
