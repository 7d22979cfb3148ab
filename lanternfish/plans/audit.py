"""Queries over source files, findings, settings, locks and documents: the audit of packages."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions import rules as R
from lanternfish.functions.normalize import clean_hash, clean_path
from lanternfish.operators import capabilities as C
from lanternfish.operators import integrity as I
from lanternfish.operators import lines as L
from lanternfish.sources.storage import cut, spread, table
from lanternfish.streaming.sessions import session_envelopes

#: Modules of the standard library, by the interpreter that runs the driver.
STDLIB = sorted(m for m in sys.stdlib_module_names if not m.startswith("_"))
# Library modules that are dangerous to shadow.
SENSITIVE_STDLIB = (
    "os sys subprocess signal shutil platform posix pty runpy socket http urllib ftplib smtplib telnetlib xmlrpc socketserver ssl imaplib poplib pickle marshal shelve json xml "
    "plistlib csv configparser sqlite3 hashlib hmac secrets random inspect code codeop gc dis ast compileall threading multiprocessing concurrent asyncio io tempfile glob zipfile tarfile "
    "pathlib ctypes importlib builtins abc email logging re string base64 binascii struct collections functools operator itertools copy types traceback warnings atexit"
).split()
CLAIM = "([a-z]+:[a-z]+)"
QUIET = ["system", "crypto", "concurrency"]
#: (text, advice): the first text found in a finding's pattern or message, in lower case, gives its advice.
ADVICE = [("pipe-to-shell", "download, verify, then run"), ("eval", "call the function itself"), ("exec", "pass arguments as a list"), ("pickle", "use a data-only format"), ("secret", "read it from a vault"), ("url", "pin the host"), ("open", "name the path"), ("fetch", "pin the host"), ("curl", "pin the host")]
FALLBACK = [("network", "list the hosts"), ("fs", "list the paths"), ("subprocess", "list the programs"), ("secret", "list the secrets")]
# Public weakness numbers.
WEAKNESS = [("eval", "CWE-95"), ("exec", "CWE-78"), ("subprocess.run", "CWE-78"), ("pickle.loads", "CWE-502"), ("config", "CWE-798"), ("pipe-to-shell", "CWE-494"), ("open", "CWE-73")]
WEAKNESS_DEFAULT = [("network", "connect", "CWE-918"), ("fs", "write", "CWE-73"), ("env", "read", "CWE-526"), ("subprocess", "exec", "CWE-78")]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return L.with_suffix(table(spark, d, "source_files"))


def _lines(spark: SparkSession, d: str, *suffixes: str) -> DataFrame:
    files = _files(spark, d)
    if suffixes:
        files = files.where(F.col("suffix").isin(*suffixes))
    return L.lines_of(files, "file_id")


def _findings(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return C.latest_findings(table(spark, d, "findings"), *keep)


def _caps(spark: SparkSession, d: str) -> DataFrame:
    return C.capability_rows(_findings(spark, d, "package_id", "file", "line", "ord", "capability"))


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines, blank lines and longest line of each file."""
    rows = _lines(spark, d)
    blank = F.count_if(F.trim("text") == "")
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"), blank.alias("n_blank"), F.max(F.length("text")).alias("longest"))


def file_routes(spark: SparkSession, d: str) -> DataFrame:
    """Files and texts per scanner that takes them."""
    each = _files(spark, d).select("file_id", F.explode(L.routes(F.col("path"), F.col("suffix"))).alias("route"), F.length("text").alias("n"))
    return each.groupBy("route").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").cast("bigint").alias("n_chars"))


def files_kept(spark: SparkSession, d: str) -> DataFrame:
    """Files per package that no ignore pattern hides."""
    kept = L.not_ignored(table(spark, d, "source_files").select("package_id", "path"), R.IGNORED)
    return kept.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"))


def main_file(spark: SparkSession, d: str) -> DataFrame:
    """The first existing of several candidate files of each package."""
    order = {n: i for i, n in enumerate(["settings.json", "settings.yaml", "config.toml", "index.py", "main.py", "main.sh"])}
    name = F.element_at(F.split("path", "/"), -1)
    rank = None
    for n, i in order.items():
        rank = F.when(name == n, i) if rank is None else rank.when(name == n, i)
    ranked = table(spark, d, "source_files").select("package_id", "path", rank.alias("rank")).where("rank IS NOT NULL")
    return ranked.groupBy("package_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    """Texts for the scanners, a small table spread over all cores."""
    return spread(_files(spark, d).select("file_id", "package_id", "suffix", "text"))


def _code(spark: SparkSession, d: str, language: str) -> DataFrame:
    """Lines of the files of one language without comments."""
    return L.code_lines(_scanned(spark, d).where(L.language(F.col("suffix")) == language), "file_id")


def _prohibited(spark: SparkSession, d: str, language: str) -> DataFrame:
    return L.every_match(_code(spark, d, language), R.PROHIBITED[language]).select("file_id", "line", "rule_id", "severity", "category", "action")


def _capabilities(spark: SparkSession, d: str, language: str) -> DataFrame:
    found = L.once_per_file(L.first_matches(_code(spark, d, language), R.SCANS[language]), "file_id")
    return found.select("file_id", "claim", "line", "rule_id", "severity", "category", "action", "scope")


def shell_prohibited(spark: SparkSession, d: str) -> DataFrame:
    """Every match of a prohibited pattern in shell code."""
    return _prohibited(spark, d, "shell")


def shell_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """First match of each table per line, then one finding per file and capability or command."""
    return _capabilities(spark, d, "shell")


def js_prohibited(spark: SparkSession, d: str) -> DataFrame:
    """Every match of a prohibited pattern in JavaScript."""
    return _prohibited(spark, d, "javascript")


def js_capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities of JavaScript files with the address or path they name."""
    return _capabilities(spark, d, "javascript")


def python_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Pattern rules on Python lines: one per rule and line."""
    return L.every_match(_code(spark, d, "python"), R.PY_RULES).select("file_id", "line", "rule_id", "severity", "category", "action")


def pattern_totals(spark: SparkSession, d: str) -> DataFrame:
    """All scanners put together in one pass over the texts: findings, files and packages per rule."""
    rules = {k: [r for t in [*tables, R.PROHIBITED.get(k, [])] for r in t] for k, tables in R.SCANS.items()}
    every = L.every_match_by_language(L.code_lines(_scanned(spark, d), "file_id", "package_id"), rules).select("file_id", "package_id", "rule_id")
    return every.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("file_id").alias("n_files"), F.countDistinct("package_id").alias("n_packages"))


def _detectors() -> dict[str, object]:
    key, v = F.lower("key"), F.col("value")
    text = F.col("value_type") == "str"
    return {
        "url": text & v.rlike("^https?://"),
        "secret": text & key.rlike("(pass|secret|token|api.?key)") & (F.length(v) > 0),
        "base64": text & v.rlike("^[A-Za-z0-9+/]{40,}={0,2}$"),
        "jwt": text & v.rlike(r"^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\."),
        "sensitive_path": text & v.rlike(r"(\.ssh/|\.pem$|/etc/)"),
        "connection": text & v.rlike("^[a-z+]+://[^/@: ]+:[^/@ ]+@"),
        "command": text & key.rlike("(command|cmd|exec)"),
    }


def config_detections(spark: SparkSession, d: str) -> DataFrame:
    """Seven detectors on settings: urls and commands once per value, the others once per file."""
    rows = table(spark, d, "config_entries").distinct()
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _detectors().items()]))
    each = rows.select("package_id", "path", "key_path", "value", F.explode(hits).alias("detector"))
    claim = F.when(F.col("detector").isin("url", "command"), F.col("value")).otherwise("")
    return each.groupBy("package_id", "path", "detector", claim.alias("claim")).agg(F.min("key_path").alias("key_path"), F.count(F.lit(1)).alias("n"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return L.text_files(_scanned(spark, d), R.BINARY_SUFFIXES)


def hidden_characters(spark: SparkSession, d: str) -> DataFrame:
    """Documents and text files with characters of no width."""
    both = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    both = both.unionByName(_texts(spark, d).select(F.lit("file").alias("kind"), F.col("file_id").alias("id"), "text"))
    return L.hidden_characters(both, ["kind", "id"]).withColumn("codes", F.concat_ws(",", "codes"))


def foreign_letters(spark: SparkSession, d: str) -> DataFrame:
    """Source files with letters of other scripts that look like Latin ones: how many, and the line of the first."""
    return L.foreign_letters(_files(spark, d).where(F.lower("suffix").isin(*R.SOURCE_SUFFIXES)), ["file_id"], R.LOOK_ALIKES)


def persuasion(spark: SparkSession, d: str) -> DataFrame:
    """Persuasive lines of text files: a rule once a file, a line for one rule."""
    return L.greedy_once(L.lines_of(_texts(spark, d), "file_id"), R.PERSUASION, "file_id").select("file_id", "line", "rule_id", "severity")


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Files and characters that text scanners see, by suffix in lower case."""
    kept = _texts(spark, d).select(F.lower("suffix").alias("suffix"), F.length("text").alias("n"))
    return kept.groupBy("suffix").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_chars"))


def shadowing_modules(spark: SparkSession, d: str) -> DataFrame:
    """Root-level modules named like library modules."""
    return L.shadowing_modules(table(spark, d, "source_files"), STDLIB, SENSITIVE_STDLIB)


def deduplicated_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the settings scanner on places without another finding."""
    rows = _findings(spark, d, "package_id", "file", "line", "pattern")
    added = rows.where(F.startswith("pattern", F.lit("config:")))
    native = rows.where(~F.startswith("pattern", F.lit("config:")))
    return L.without_native(added, native, "package_id", "file", "line").groupBy("package_id", "pattern").agg(F.count(F.lit(1)).alias("n"))


def capability_set(spark: SparkSession, d: str) -> DataFrame:
    """Distinct scoped capabilities of each package."""
    return C.capability_set(_caps(spark, d)).withColumn("scope", F.concat_ws("|", "scope"))


def capability_map(spark: SparkSession, d: str) -> DataFrame:
    """Ordered distinct scopes of each capability of a package."""
    return C.capability_map(_caps(spark, d)).withColumn("scopes", F.concat_ws("|", "scopes"))


def visible_map(spark: SparkSession, d: str) -> DataFrame:
    """The capability map without quiet categories that no restricted finding carries."""
    caps = cut(_caps(spark, d), "caps")
    rest = _findings(spark, d, "package_id", "severity", "capability").where("severity = 'restricted' AND capability IS NOT NULL").select("package_id", "capability.category")
    return C.low_risk_hidden(C.capability_map(caps), rest, QUIET).withColumn("scopes", F.concat_ws("|", "scopes"))


def binary_classes(spark: SparkSession, d: str) -> DataFrame:
    """Binaries of each package as denied, allowed or unrecognized."""
    return C.classified_binaries(spark, C.binaries(_caps(spark, d)), R.DENIED_BINARIES, R.ALLOWED_BINARIES)


def combinations(spark: SparkSession, d: str) -> DataFrame:
    """Risky combinations of capabilities that a package has in full."""
    caps = _caps(spark, d)
    return C.fired_combinations(spark, caps, C.binaries(caps), R.ALLOWED_BINARIES, R.COMBINATIONS).withColumn("matched", F.concat_ws("|", "matched"))


def path_violations(spark: SparkSession, d: str) -> DataFrame:
    """File scopes that denied patterns match, a row for each pattern."""
    return C.path_violations(spark, _caps(spark, d), R.DENIED_PATHS)


def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decision of the policy on every scope of every capability."""
    return C.policy_decisions(_caps(spark, d), R.POLICY)


def static_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk of each package from capabilities, combinations, paths and binaries."""
    caps = cut(_caps(spark, d), "caps")
    used = C.binaries(caps)
    fired = C.fired_combinations(spark, caps, used, R.ALLOWED_BINARIES, R.COMBINATIONS)
    return C.static_risk(caps, fired, C.path_violations(spark, caps, R.DENIED_PATHS), C.classified_binaries(spark, used, R.DENIED_BINARIES, R.ALLOWED_BINARIES))


def plain_risk(spark: SparkSession, d: str) -> DataFrame:
    """Risk summed over all capability rows, repeats included."""
    return C.plain_risk(_caps(spark, d))


def unresolved_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Share of unresolved scopes of each package."""
    return C.unresolved(_caps(spark, d))


def quality_score(spark: SparkSession, d: str) -> DataFrame:
    """Score of each package from unresolved scopes, risk and prohibited findings."""
    caps = cut(_caps(spark, d), "caps")
    return C.quality_score(C.plain_risk(caps).withColumnRenamed("plain_risk", "static_risk"), C.unresolved(caps), _findings(spark, d, "package_id", "severity"))


def unexpected_categories(spark: SparkSession, d: str) -> DataFrame:
    """Capability categories that look out of place for a package's category."""
    return C.category_overlap(spark, table(spark, d, "packages"), _caps(spark, d), R.UNEXPECTED)


def claimed_and_used(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities that a package's documents name against those its findings show."""
    docs = table(spark, d, "documents").where("package_id IS NOT NULL")
    claimed = docs.select("package_id", F.explode(F.regexp_extract_all("text", F.lit(CLAIM), F.lit(1))).alias("cap"))
    claimed = C.known_capabilities(claimed, "cap", R.CATEGORIES, R.ACTIONS)
    used = _caps(spark, d).select("package_id", C.cap().alias("cap"))
    return C.set_difference(claimed, used, ["package_id", "cap"])


# Names of common tools and technologies that texts speak of.
TOOLS = "docker kubernetes terraform ansible git curl wget ssh rsync jq npm pip cargo make bash python node java postgres mysql redis kafka spark airflow nginx"
#: What texts name, by the first group of a pattern.
MENTIONS = {
    "path": r"((?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_-]+[.](?:py|js|ts|sh|json|yaml|yml|toml|md|txt|cfg|ini))\b",
    "version": r"\b(\d+[.]\d+[.]\d+)\b",
    "variable": r"\$\{?([A-Z][A-Z0-9_]{2,})",
    "tool": r"\b(" + "|".join(TOOLS.split()) + r")\b",
    "url": r"(https?://[A-Za-z0-9./_-]+)",
    "head": r"(?m)^#{1,6} (\S[^\r\n]*)$",
}


def document_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Paths, rules and versions that documents name."""
    return L.document_mentions(table(spark, d, "documents"), "doc_id", MENTIONS)


def documentation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of each package's documents: capabilities used but not named warn, severe ones are a danger."""
    sides = claimed_and_used(spark, d).where("side = 'right'")
    severe = F.split("cap", ":")[0].isin("subprocess", "secret")
    return L.documentation_score(sides.select("package_id", F.when(severe, "danger").otherwise("warning").alias("verdict")), "package_id")


def ghost_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that findings name and that exist neither by path nor by name in the package."""
    have = table(spark, d, "source_files").select("package_id", clean_path(F.col("path")).alias("path"))
    named = _findings(spark, d, "package_id", "file").where("package_id IS NOT NULL AND file IS NOT NULL").select("package_id", clean_path(F.col("file")).alias("path")).distinct()
    return C.absent_paths(named, have.distinct())


def ghost_references(spark: SparkSession, d: str) -> DataFrame:
    """Paths that a package's documents name and that its files have neither by path nor by name."""
    docs = table(spark, d, "documents").where("package_id IS NOT NULL AND text IS NOT NULL")
    named = docs.select("package_id", F.explode(F.regexp_extract_all("text", F.lit(MENTIONS["path"]), F.lit(1))).alias("path"))
    named = named.select("package_id", F.ltrim("path", F.lit("./")).alias("path")).where("path <> ''").distinct()
    have = table(spark, d, "source_files").select("package_id", F.ltrim(clean_path(F.col("path")), F.lit("./")).alias("path")).distinct()
    return C.absent_paths(named, have)


def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class of each document by capped keyword counts."""
    return C.keyword_classes(spark, spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")), "doc_id", R.KEYWORDS)


def top_findings(spark: SparkSession, d: str) -> DataFrame:
    """The twelve findings of each package to mend first."""
    rows = _findings(spark, d, "package_id", "severity", "file", "line", "col", "pattern").where("package_id IS NOT NULL")
    order = [F.when(F.col("severity") == "prohibited", 0).otherwise(1), F.col("file"), F.col("line"), F.col("col"), F.col("pattern"), F.col("finding_id")]
    return C.top_per_group(rows, "package_id", 12, *order).select("package_id", "rank", "finding_id", "severity", "file", "line")


def top_files(spark: SparkSession, d: str) -> DataFrame:
    """The five files of each package with most findings."""
    n = _findings(spark, d, "package_id", "file").where("package_id IS NOT NULL").groupBy("package_id", "file").agg(F.count(F.lit(1)).alias("n"))
    return C.top_per_group(n, "package_id", 5, F.desc("n"), F.col("file"))


def advice(spark: SparkSession, d: str) -> DataFrame:
    """Advice for each finding: first text in its pattern or message, else by capability; counted."""
    low = [F.lower("pattern"), F.lower("message")]
    first = [F.when(F.contains(low[0], F.lit(t)) | F.contains(low[1], F.lit(t)), F.lit(a)) for t, a in ADVICE]
    rest = [F.when(F.col("capability.category") == c, F.lit(a)) for c, a in FALLBACK]
    return _findings(spark, d, "pattern", "message", "capability").withColumn("advice", F.coalesce(*first, *rest)).groupBy("pattern", "advice").agg(F.count(F.lit(1)).alias("n"))


def weaknesses(spark: SparkSession, d: str) -> DataFrame:
    """Weakness numbers by pattern, by what stands before its colon, or by capability; counted."""
    by_pattern = F.broadcast(R.frame(spark, WEAKNESS, "p string, cwe string"))
    by_cap = F.broadcast(R.frame(spark, WEAKNESS_DEFAULT, "category string, action string, cwe3 string"))
    rows = _findings(spark, d, "pattern", "capability").select("pattern", "capability.category", "capability.action")
    j = rows.join(by_pattern.select(F.col("p").alias("pattern"), F.col("cwe").alias("cwe1")), "pattern", "left").withColumn("p", F.split("pattern", ":")[0])
    j = j.join(by_pattern, "p", "left").join(by_cap, ["category", "action"], "left")
    return j.select("pattern", F.coalesce("cwe1", "cwe", "cwe3").alias("cwe")).groupBy("pattern", "cwe").agg(F.count(F.lit(1)).alias("n"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether a package may be reported on and locked: no prohibited finding; no critical combination."""
    f = _findings(spark, d, "package_id", "severity").where("package_id IS NOT NULL")
    hard = f.groupBy("package_id").agg(F.bool_or(F.col("severity") == "prohibited").alias("hard_fail"))
    caps = _caps(spark, d)
    fired = C.fired_combinations(spark, caps, C.binaries(caps), R.ALLOWED_BINARIES, R.COMBINATIONS).where("severity = 'critical'").select("package_id").distinct()
    return hard.join(fired.withColumn("critical", F.lit(True)), "package_id", "left").select("package_id", "hard_fail", (~F.coalesce("critical", F.lit(False))).alias("lock_allowed"))


def badges(spark: SparkSession, d: str) -> DataFrame:
    """Badge colour and link of the latest lock of each package."""
    latest = table(spark, d, "lock_snapshots").groupBy("package_id").agg(F.max_by("risk_static", F.struct("snapshot_no", "locked_at", "risk_static")).alias("risk"))
    tier = F.when(F.col("risk") <= 25, "green").when(F.col("risk") <= 50, "yellow").when(F.col("risk") <= 75, "orange").otherwise("red")
    return latest.select("package_id", "risk", tier.alias("tier"), F.concat(F.lit("badge/"), F.replace(F.col("package_id"), F.lit("-"), F.lit("--")), F.lit("-"), F.col("risk").cast("string"), F.lit("-"), tier).alias("link"))


def first_paths(spark: SparkSession, d: str) -> DataFrame:
    """First and last path of each package in the order of path parts."""
    parts = F.split("path", "/")
    return table(spark, d, "source_files").groupBy("package_id").agg(F.min_by("path", parts).alias("first_path"), F.max_by("path", parts).alias("last_path"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "source_files").where("text IS NOT NULL")
    rows = files.select("package_id", "path", F.substring(I.text_hash(F.col("text")), 8, 64).alias("hash"))
    return I.merkle_levels(I.numbered(rows, ["package_id"], F.split("path", "/")), ["package_id"])


def merkle_roots(spark: SparkSession, d: str) -> DataFrame:
    """Merkle root over the normalised texts of each package."""
    return I.roots(_tree(spark, d), ["package_id"])


def merkle_proofs(spark: SparkSession, d: str) -> DataFrame:
    """Proof of every file: the sibling of each level."""
    return I.proofs(_tree(spark, d), ["package_id"])


def merkle_verified(spark: SparkSession, d: str) -> DataFrame:
    """Whether every file's proof leads to its package's root."""
    levels = _tree(spark, d)
    return I.verified(levels, I.proofs(levels, ["package_id"]), ["package_id"])


def _locked(spark: SparkSession, d: str) -> DataFrame:
    """``package_id, path, hash`` of the last snapshot of each package; of several deliveries of a path the latest counts."""
    leaves = table(spark, d, "merkle_leaves").where("path IS NOT NULL AND hash IS NOT NULL")
    last = leaves.groupBy("package_id").agg(F.max("snapshot_no").alias("snapshot_no"))
    # Only the rows of a last snapshot are brought to one spelling.
    rows = leaves.select("package_id", "snapshot_no", "path", "hash", "received_at", "idx").join(last, ["package_id", "snapshot_no"], "left_semi")
    rows = rows.select("package_id", clean_path(F.col("path")).alias("path"), clean_hash(F.col("hash")).alias("hash"), "received_at", "idx")
    return rows.groupBy("package_id", "path").agg(F.max_by("hash", F.struct("received_at", "idx", "hash")).alias("hash"))


def _now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("text IS NOT NULL").select("package_id", clean_path(F.col("path")).alias("path"), F.substring(I.text_hash(F.col("text")), 8, 64).alias("hash"))


def lock_verified(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the last lock of each package against the texts there now, by status, and whether the roots agree."""
    compared = cut(I.compared_files(_locked(spark, d), _now(spark, d)), "compared")
    counts = compared.groupBy("package_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(I.root_matches(compared).select("package_id", "root_ok"), "package_id")


def locks(spark: SparkSession, d: str) -> DataFrame:
    """The lock of each package as canonical JSON: number of files and root over their normalised texts."""
    tops = I.roots(_tree(spark, d), ["package_id"])
    return tops.select("package_id", I.lock_text(F.col("package_id"), F.col("n_leaves"), F.col("root")).alias("lock"))


def file_verified(spark: SparkSession, d: str) -> DataFrame:
    """Single files against their package's lock: the main file of each, by its leaf and its proof."""
    leaves = cut(I.numbered(_locked(spark, d), ["package_id"], F.split("path", "/")), "leaves")
    wanted = main_file(spark, d).select("package_id", clean_path(F.col("path")).alias("path"))
    return I.verified_files(leaves, _now(spark, d), wanted)


def escaping_scopes(spark: SparkSession, d: str) -> DataFrame:
    """File scopes that leave the package."""
    values = C.scope_elements(_caps(spark, d).where("category = 'fs'")).select("package_id", "value").distinct()
    return values.select("package_id", "value", I.path_escapes(F.col("value")).alias("escapes"))


def package_reports(spark: SparkSession, d: str) -> DataFrame:
    """One canonical JSON text per package, keys in order: counts, and its five files with most findings."""
    f = _findings(spark, d, "package_id", "severity", "file").where("package_id IS NOT NULL")
    n = f.groupBy("package_id").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "prohibited").alias("prohibited"), F.count_if(F.col("severity") == "restricted").alias("restricted"))
    top = top_files(spark, d).where("file IS NOT NULL").groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("rank", "file", "n"))).alias("top"))
    listed = F.transform(F.coalesce("top", F.array().cast("array<struct<rank:int,file:string,n:bigint>>")), lambda x: F.struct(x["file"].alias("file"), x["n"].alias("findings")))
    counts = F.struct("files", "findings", "prohibited", "restricted").alias("counts")
    return n.join(top, "package_id", "left").select("package_id", F.to_json(F.struct(counts, "package_id", listed.alias("top_files"))).alias("report"))


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with the kinds of events in them."""
    return session_envelopes(table(spark, d, "events")).withColumn("kinds", F.concat_ws("|", "kinds"))


def severity_cube(spark: SparkSession, d: str) -> DataFrame:
    """Findings by severity and confidence with all totals."""
    f = _findings(spark, d, "severity", "confidence").select(F.coalesce("severity", F.lit("none")).alias("severity"), F.coalesce("confidence", F.lit("none")).alias("confidence"))
    return f.cube("severity", "confidence").agg(F.count(F.lit(1)).alias("n"))


NAMES = [
    "line_counts", "file_routes", "files_kept", "main_file", "shell_prohibited", "shell_capabilities", "js_prohibited", "js_capabilities", "python_patterns", "pattern_totals",
    "config_detections", "hidden_characters", "text_files", "foreign_letters", "persuasion", "shadowing_modules", "deduplicated_findings", "capability_set", "capability_map",
    "visible_map", "binary_classes", "combinations", "path_violations", "policy_decisions", "static_risk", "plain_risk", "unresolved_scopes", "quality_score", "unexpected_categories",
    "claimed_and_used", "document_mentions", "documentation_scores", "ghost_files", "keyword_classes", "top_findings", "top_files", "advice", "weaknesses", "gates", "badges", "first_paths", "merkle_roots", "merkle_proofs",
    "merkle_verified", "lock_verified", "locks", "file_verified", "ghost_references", "escaping_scopes", "package_reports", "sessions", "severity_cube",
]
