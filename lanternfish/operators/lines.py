"""Files as lines, and scans of lines by rule tables.

Null texts have no lines and an empty text none either; a very long line is one row. Suffixes are compared exactly as
written (upper case is another suffix). Equal lines are separate rows. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.functions.rules import NO_WIDTH, LineRule
from lanternfish.sources.storage import cut

#: Every line end that Python's splitlines knows.
LINE_END = "\r\n|[\n\x0b\f\r\x1c-\x1e\u0085\u2028\u2029]"
#: Quoted runs and escapes, which are kept, or a comment; an open quote keeps the rest of the line.
SHELL_PIECES = r"""('[^']*+(?:'|$)|"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?$)|\\.)|#.*"""
#: Strings, templates, comments and what lies between them in JavaScript.
JS_PIECES = (
    r"""(?s)"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`"""
    r"""|//[^\r\n]*+|/\*.*?(?:\*/|\z)|[^"'`/]++|."""
)
LANGUAGES = {
    "python": [".py"],
    "shell": [".sh", ".bat", ".ps1", ".bash", ".zsh", ".fish"],
    "javascript": [".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx"],
    "config": [".json", ".yaml", ".yml", ".toml", ".cfg", ".ini"],
}


def with_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds ``suffix``: from the last dot of the last path part on, '' without one."""
    return files.withColumn("suffix", F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def language(suffix: Column) -> Column:
    """The language of a suffix, null for others."""
    return F.coalesce(*[F.when(suffix.isin(*s), F.lit(k)) for k, s in LANGUAGES.items()])


def routes(path: Column, suffix: Column) -> Column:
    """All scanners that take a file, as an array: by exact suffix, Dockerfiles by their name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    docker = F.when(name.isin("dockerfile", "containerfile") | name.startswith("dockerfile.") | name.endswith(".dockerfile"), F.lit("docker"))
    return F.array_compact(F.array(language(suffix), docker))


def text_files(files: DataFrame, binary: list[str]) -> DataFrame:
    """Files whose suffix, in whatever case, isn't one of files that hold no text; needs ``suffix``."""
    return files.where(~F.lower("suffix").isin(*binary))


def not_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Files whose path no pattern ignores: ``*x`` by ending, others by name or any part of the path."""
    parts = F.split("path", "/")
    out = files
    for p in patterns:
        hit = F.col("path").endswith(p[1:]) if p.startswith("*") else F.array_contains(parts, p.rstrip("/"))
        out = out.where(~F.coalesce(hit, F.lit(False)))
    return out


def ignore_files(files: DataFrame, name: str) -> DataFrame:
    """``package_id, patterns`` from root-level ignore files (``package_id, path, text``): a pattern a line, blank lines and
    comments aside. Several such files of a package count together."""
    lines = lines_of(files.where(F.col("path") == name), "package_id").select("package_id", F.trim("text").alias("p"))
    return lines.where("p <> '' AND NOT startswith(p, '#')").groupBy("package_id").agg(F.collect_set("p").alias("patterns"))


def not_ignored_by_package(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """Files of ``package_id, path`` that no pattern of their own package ignores; packages without patterns keep all."""
    parts = F.split("path", "/")
    hit = F.exists("patterns", lambda p: F.when(p.startswith("*"), F.endswith(F.col("path"), F.substring(p, 2, 2**31 - 1))).otherwise(F.array_contains(parts, F.rtrim(p, F.lit("/")))))
    joined = files.join(ignores.select("package_id", "patterns"), "package_id", "left")
    return joined.where(F.col("patterns").isNull() | ~F.coalesce(hit, F.lit(False))).drop("patterns")


def lines_of(files: DataFrame, *keys: str) -> DataFrame:
    """``keys, line, text`` with lines counted from 1, without line ends; the empty rest after the last end is no line."""
    pieces = F.split(F.col("text"), LINE_END, -1)
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    rows = files.where(F.col("text").isNotNull()).select(*keys, F.posexplode(kept).alias("at", "text"))
    return rows.select(*keys, (F.col("at") + 1).alias("line"), "text")


def shell_code(text: Column) -> Column:
    """A shell line without its comment, which begins at the first # outside quotes."""
    return F.when(F.contains(text, F.lit("#")), F.regexp_replace(text, SHELL_PIECES, "$1")).otherwise(text)


def js_code(text: Column) -> Column:
    """A JavaScript text without its comments, whose line ends stay, so that lines keep their numbers."""
    piece = lambda p: F.when(p.startswith("//") | p.startswith("/*"), F.regexp_replace(p, r"[^\r\n\u2028\u2029]", "")).otherwise(p)
    bare = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(JS_PIECES), F.lit(0)), piece), "")
    return F.when(F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*")), bare).otherwise(text)


def code_lines(files: DataFrame, *keys: str) -> DataFrame:
    """``keys, language, line, text`` of files with ``suffix, text`` in a known language, without comments of shell and
    JavaScript."""
    known = files.withColumn("language", language(F.col("suffix"))).where("language IS NOT NULL")
    text = F.when(F.col("language") == "javascript", js_code(F.col("text"))).otherwise(F.col("text"))
    rows = lines_of(known.withColumn("text", text), *keys, "language")
    return rows.withColumn("text", F.when(F.col("language") == "shell", shell_code(F.col("text"))).otherwise(F.col("text")))


def hit(text: Column, rule: LineRule) -> Column:
    """Whether a line matches; the substring test comes first."""
    found = text.rlike(rule.pattern)
    held = F.lower(text) if rule.pattern.startswith("(?i)") else text
    return F.contains(held, F.lit(rule.literal)) & found if rule.literal else found


def _found(rule: LineRule) -> Column:
    # No capturing group in a rule, so that the quoted text is the first one.
    quoted = F.regexp_extract("text", f"(?:{rule.pattern})" + r"""[^'"]*['"]([^'"]+)['"]""", 1) if rule.scoped else None
    scope = F.when(quoted.startswith("http") | quoted.startswith("/"), quoted).otherwise("*") if rule.scoped else F.lit("*")
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.ord).alias("rule_ord"), F.lit(rule.severity).alias("severity"),
        F.lit(rule.category).alias("category"), F.lit(rule.action).alias("action"), F.lit(rule.once).alias("once"), scope.alias("scope"),
    )


def _matches(rules: list[LineRule]) -> Column:
    return F.array_compact(F.array(*[F.when(hit(F.col("text"), r), _found(r)) for r in rules]))


def every_match(lines: DataFrame, rules: list[LineRule]) -> DataFrame:
    """A row for every line and rule that match."""
    return lines.withColumn("f", F.explode(_matches(rules))).select("*", "f.*").drop("f", "once", "scope")


def every_match_by_language(lines: DataFrame, rules: dict[str, list[LineRule]]) -> DataFrame:
    """:func:`every_match` with the rules of each line's ``language``, in one pass over the lines."""
    of = F.coalesce(*[F.when(F.col("language") == k, _matches(r)) for k, r in rules.items()])
    return lines.withColumn("f", F.explode(of)).select("*", "f.*").drop("f", "once", "scope")


def first_matches(lines: DataFrame, tables: list[list[LineRule]]) -> DataFrame:
    """A row for every line and table: the table's first rule that matches the line; where that is an "info" rule, none."""
    firsts = []
    for rules in tables:
        firsts.append(F.coalesce(*[F.when(hit(F.col("text"), r), _found(r)) for r in rules]))
    rows = lines.withColumn("f", F.explode(F.array_compact(F.array(*firsts))))
    return rows.where("f.severity <> 'info'").select("*", "f.*").drop("f")


def once_per_file(matches: DataFrame, *keys: str) -> DataFrame:
    """Of the matches of one file and capability (or file and rule) the earliest; a line's first match has been chosen
    before, so a later rule on a claimed line is lost. Combines before the shuffle."""
    key = F.concat_ws(":", "category", "action", F.when(F.col("once") == "rule", F.col("rule_id")))
    best = F.min(F.struct("line", "rule_ord", "rule_id", "severity", "category", "action", "scope")).alias("b")
    return matches.groupBy(*keys, key.alias("claim")).agg(best).select(*keys, "claim", "b.*")


def greedy_once(lines: DataFrame, rules: list[LineRule], *keys: str) -> DataFrame:
    """A rule once per document and a line for one rule, in order of lines: a line is claimed by its first matching rule
    that no earlier line has claimed. One round per rule, each a window over the matching lines that are left; the
    matches are written once, so that no round scans the texts again."""
    left = cut(every_match(lines, rules).select(*keys, "line", "rule_id", "rule_ord", "severity"), "matches")
    out = None
    for rule in rules:
        own = Window.partitionBy(*keys)
        first = left.withColumn("first", F.min(F.struct("line", "rule_ord")).over(own))
        taken = first.where((F.col("line") == F.col("first.line")) & (F.col("rule_ord") == F.col("first.rule_ord"))).drop("first")
        out = taken if out is None else out.unionByName(taken)
        left = first.where((F.col("line") != F.col("first.line")) & (F.col("rule_ord") != F.col("first.rule_ord"))).drop("first")
    return out


def without_native(added: DataFrame, native: DataFrame, *keys: str) -> DataFrame:
    """Findings of an added scanner on places where no native one has a finding; they don't displace each other."""
    return added.join(native.select(*keys).distinct(), list(keys), "left_anti")


def hidden_characters(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Documents with zero-width characters (a BOM at the start aside): how many, which, and the line of the first."""
    inner = F.when(F.startswith(F.col(text), F.lit("\ufeff")), F.substring(text, 2, 2**31 - 1)).otherwise(F.col(text))
    marks = F.lit(NO_WIDTH)
    rows = docs.select(*keys, inner.alias("t")).withColumn("hits", F.regexp_extract_all("t", marks, F.lit(0))).where(F.size("hits") > 0)
    first = F.regexp_instr("t", marks)
    before = F.substring(F.col("t"), F.lit(1), first - 1)
    return rows.select(*keys, F.size("hits").alias("n_hidden"), F.array_sort(F.array_distinct(F.transform("hits", lambda c: F.hex(F.encode(c, "UTF-16BE"))))).alias("codes"), (F.regexp_count(before, F.lit("\n")) + 1).alias("first_line"))


def foreign_letters(docs: DataFrame, keys: list[str], pattern: str, text: str = "text") -> DataFrame:
    """``keys, n_foreign, first_line`` of texts with letters of a class (look-alikes of other scripts, say)."""
    rows = docs.select(*keys, F.col(text).alias("t"), F.regexp_count(text, F.lit(pattern)).alias("n_foreign")).where("n_foreign > 0")
    before = F.substring(F.col("t"), F.lit(1), F.regexp_instr("t", F.lit(pattern)) - 1)
    return rows.select(*keys, "n_foreign", (F.regexp_count(before, F.lit("\n")) + 1).alias("first_line"))


def shadowing_modules(files: DataFrame, modules: list[str], sensitive: list[str]) -> DataFrame:
    """Root-level ``X.py`` or ``X/__init__.py`` with X a library module, once per package and module."""
    parts = F.split("path", "/")
    name = F.when((F.size(parts) == 1) & F.col("path").endswith(".py"), F.expr("substring(path, 1, length(path) - 3)")).when((F.size(parts) == 2) & (parts[1] == "__init__.py"), parts[0])
    hits = files.select("package_id", "path", name.alias("module")).where(F.col("module").isin(*modules))
    return hits.groupBy("package_id", "module").agg(F.min("path").alias("path")).withColumn("severity", F.when(F.col("module").isin(*sensitive), "prohibited").otherwise("restricted"))


def dockerfile_findings(files: DataFrame, rules: list[LineRule], *keys: str) -> DataFrame:
    """``keys, line, rule_id, severity`` of Dockerfiles: every match of the rules, and line 0 where no line sets a user.

    files: ``keys, text``, chosen by :func:`routes`. Files of null or empty text lack a user as well.
    """
    rows = lines_of(files, *keys)
    found = every_match(rows, rules).select(*keys, "line", "rule_id", "severity")
    named = rows.where(F.col("text").rlike(r"^\s*USER\s")).select(*keys).distinct()
    bare = files.select(*keys).distinct().join(named, list(keys), "left_anti")
    return found.unionByName(bare.select(*keys, F.lit(0).alias("line"), F.lit("docker-no-user").alias("rule_id"), F.lit("restricted").alias("severity")))


def document_mentions(docs: DataFrame, key: str, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """``key, kind, value``: what each pattern's first group finds in a text, each once (paths, commands, names)."""

    def named(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    every = F.concat(*[named(k, p) for k, p in patterns.items()])
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(every)).alias("m")).select(key, "m.*")


def documentation_score(checks: DataFrame, key: str) -> DataFrame:
    """``key, score, adjustment`` from ``key, verdict`` rows: 20 less for each danger, 10 for each warning, at least 0; the
    adjustment is 20, 12 or 5 below 30, 50 or 70. Verdicts that are null or others cost nothing."""
    n = checks.groupBy(key).agg(F.count_if(F.col("verdict") == "danger").alias("d"), F.count_if(F.col("verdict") == "warning").alias("w"))
    score = F.greatest(F.lit(0), 100 - 20 * F.col("d") - 10 * F.col("w")).cast("int")
    out = n.select(key, score.alias("score"))
    return out.withColumn("adjustment", F.when(F.col("score") < 30, 20).when(F.col("score") < 50, 12).when(F.col("score") < 70, 5).otherwise(0))
