"""Scoped capabilities of packages: sets, combinations, binaries, paths, policies and scores.

A capability row is ``package_id, ord, category, action, scope array<string>, scope_resolved``. Rows without a capability
are left out by :func:`capability_rows`; null or empty scopes have no element. Repeated rows are kept where a bag is
meant (paths, sums) and count once where a set is. Empty tables give empty results, and packages without a row don't
show up. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions.rules import frame, glob_regex


def cap() -> Column:
    """``category:action``."""
    return F.concat_ws(":", "category", "action")


def latest_findings(findings: DataFrame, *keep: str) -> DataFrame:
    """One row per finding_id: the one received last; deliveries of equal time are equal rows. keep names the columns to
    go on with (all without it): what isn't named is neither read nor shuffled."""
    rest = [c for c in findings.columns if c != "finding_id" and (not keep or c in keep)]
    best = F.max_by(F.struct(*rest), F.struct("received_at", "ord")).alias("b")
    return findings.where(F.col("finding_id").isNotNull()).groupBy("finding_id").agg(best).select("finding_id", "b.*")


def capability_rows(findings: DataFrame) -> DataFrame:
    """``package_id, ord, category, action, scope, scope_resolved``; ord is the order of encounter (file, then ord)."""
    have = findings.where(F.col("capability").isNotNull() & F.col("package_id").isNotNull())
    at = F.struct(F.split("file", "/").alias("parts"), F.col("line").alias("line"), F.col("ord").alias("n"), F.col("finding_id").alias("id"))
    return have.select("package_id", at.alias("ord"), "capability.category", "capability.action", "capability.scope", "capability.scope_resolved")


def capability_set(rows: DataFrame) -> DataFrame:
    """Distinct (category, action, scope) of each package; whether a scope is resolved makes no difference."""
    return rows.select("package_id", "category", "action", "scope").distinct()


def known_capabilities(named: DataFrame, column: str, categories: list[str], actions: list[str]) -> DataFrame:
    """The rows whose ``category:action`` text names a known category and action."""
    parts = F.split(column, ":")
    return named.where((F.size(parts) == 2) & parts[0].isin(*categories) & parts[1].isin(*actions))


def scope_elements(rows: DataFrame) -> DataFrame:
    """``package_id, category, action, value``: one row per scope element, repeated ones included."""
    return rows.select("package_id", "category", "action", F.explode("scope").alias("value"))


def capability_map(rows: DataFrame) -> DataFrame:
    """Scopes of each (package, category, action), each once, in order of first encounter.

    First encounters are reduced before they are collected, so a list holds each scope once.
    """
    flat = rows.select("package_id", "category", "action", "ord", F.posexplode("scope").alias("at", "value"))
    first = flat.groupBy("package_id", "category", "action", "value").agg(F.min(F.struct("ord", "at")).alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", "value")))
    return first.groupBy("package_id", "category", "action").agg(F.transform(listed, lambda x: x["value"]).alias("scopes"))


def low_risk_hidden(cap_map: DataFrame, restricted: DataFrame, quiet: list[str]) -> DataFrame:
    """The map without quiet categories that no restricted finding carries."""
    kept = restricted.select("package_id", "category").distinct()
    hidden = cap_map.where(F.col("category").isin(*quiet)).join(kept, ["package_id", "category"], "left_anti")
    return cap_map.join(hidden.select("package_id", "category", "action"), ["package_id", "category", "action"], "left_anti")


def binaries(rows: DataFrame) -> DataFrame:
    """``package_id, name``: base names of all scope elements of subprocess:exec but ``*``, each once."""
    used = scope_elements(rows.where("category = 'subprocess' AND action = 'exec'")).where("value <> '*'")
    return used.select("package_id", F.element_at(F.split("value", "/"), -1).alias("name")).distinct()


def classified_binaries(spark: SparkSession, used: DataFrame, denied: list[str], allowed: list[str]) -> DataFrame:
    """``package_id, name, class``: deny wins over allow, others are unrecognized."""
    rows = [(b, "allow") for b in allowed if b not in denied] + [(b, "deny") for b in denied]
    known = F.broadcast(frame(spark, rows, "name string, class string"))
    return used.join(known, "name", "left").select("package_id", "name", F.coalesce("class", F.lit("unrecognized")).alias("class"))


def fired_combinations(spark: SparkSession, rows: DataFrame, used: DataFrame, allowed: list[str], combinations: list[tuple]) -> DataFrame:
    """``package_id, rule_id, severity, risk, matched``: rules all of whose capabilities a package has (relational
    division by counting) and whose condition holds; denied binaries count as not allowed there."""
    parts = [(r, s, c, n, k, len(set(caps))) for r, s, caps, n, k in combinations for c in sorted(set(caps))]
    need = F.broadcast(frame(spark, parts, "rule_id string, severity string, cap string, needs boolean, risk int, n_caps int"))
    have = rows.select("package_id", cap().alias("cap")).distinct()
    met = have.join(need, "cap").groupBy("package_id", "rule_id", "severity", "needs", "risk", "n_caps").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("cap")).alias("matched"))
    strange = used.where(~F.col("name").isin(*allowed)).select("package_id").distinct().withColumn("strange", F.lit(True))
    full = met.where("n = n_caps").join(strange, "package_id", "left")
    return full.where(~F.col("needs") | F.coalesce("strange", F.lit(False))).select("package_id", "rule_id", "severity", "risk", "matched")


def path_violations(spark: SparkSession, rows: DataFrame, globs: list[str]) -> DataFrame:
    """``package_id, value, glob``: a row for every scope that is written or deleted and denied glob that matches."""
    values = scope_elements(rows.where("category = 'fs' AND action IN ('write', 'delete')")).where("value <> '*'")
    clean = F.translate(F.when(F.startswith("value", F.lit("~")), F.concat(F.lit("/home/user"), F.substring("value", 2, 2**31 - 1))).otherwise(F.col("value")), "\\", "/")
    hits = F.array_compact(F.array(*[F.when(clean.rlike(glob_regex(g)), F.lit(g)) for g in globs]))
    return values.select("package_id", "value", F.explode(hits).alias("glob"))


def policy_decisions(rows: DataFrame, policy: list[tuple], default: str = "deny") -> DataFrame:
    """``package_id, cap, value, decision, rule_id``: of the deny rules that match, the one of highest priority (then
    first in order), else of the allow rules, else the default; flag rules decide nothing."""
    values = rows.select("package_id", cap().alias("cap"), F.explode("scope").alias("value")).distinct()
    ranked = sorted((("deny", "allow").index(a), -p, i, r, a, of, globs) for i, (r, a, of, globs, p) in enumerate(policy) if a in ("deny", "allow"))
    chosen = []
    for _, _, _, rule, action, of, globs in ranked:
        any_glob = None
        for g in globs:
            m = F.col("value").rlike(glob_regex(g))
            any_glob = m if any_glob is None else any_glob | m
        chosen.append(F.when((F.col("cap") == of) & any_glob, F.struct(F.lit(action).alias("decision"), F.lit(rule).alias("rule_id"))))
    rest = F.struct(F.lit(default).alias("decision"), F.lit("default").alias("rule_id"))
    return values.withColumn("d", F.coalesce(*chosen, rest)).select("package_id", "cap", "value", "d.*")


def first_capabilities(rows: DataFrame) -> DataFrame:
    """The first row met of each (package, category, action)."""
    best = F.min_by(F.struct("scope", "scope_resolved"), "ord").alias("b")
    return rows.groupBy("package_id", "category", "action").agg(best).select("package_id", "category", "action", "b.*")


def points(category: Column) -> Column:
    """Points of a category."""
    return F.when(category.isin("subprocess", "browser", "secret"), 15).when(category.isin("network", "fs"), 10).when(category == "serial", 12).when(category.isin("crypto", "system", "concurrency"), 2).otherwise(5)


def static_risk(rows: DataFrame, fired: DataFrame, violations: DataFrame, classes: DataFrame) -> DataFrame:
    """``package_id, static_risk`` in 0..100: points of each capability once, more where its first scope is ``*``; at
    least the greatest risk of a fired combination; then 10 per path violation and denied binary, 5 per unrecognized."""
    wild = F.when(F.array_contains("scope", "*") & F.col("category").isin("subprocess", "browser", "secret", "network", "fs"), 5).otherwise(0)
    base = first_capabilities(rows).groupBy("package_id").agg(F.sum(points(F.col("category")) + wild).alias("base"))
    least = fired.groupBy("package_id").agg(F.max("risk").alias("least"))
    paths = violations.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_paths"))
    bins = classes.groupBy("package_id").agg(F.count_if(F.col("class") == "deny").alias("n_deny"), F.count_if(F.col("class") == "unrecognized").alias("n_other"))
    j = base.join(least, "package_id", "left").join(paths, "package_id", "left").join(bins, "package_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = F.greatest(F.col("base"), zero("least")) + 10 * zero("n_paths") + 10 * zero("n_deny") + 5 * zero("n_other")
    return j.select("package_id", F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int").alias("static_risk"))


def plain_risk(rows: DataFrame) -> DataFrame:
    """``package_id, plain_risk``: the sum over all rows without taking repeats out, 5 more for any ``*``, at most 100."""
    each = points(F.col("category")) + F.when(F.array_contains("scope", "*"), 5).otherwise(0)
    return rows.groupBy("package_id").agg(F.least(F.sum(each), F.lit(100)).cast("int").alias("plain_risk"))


def unresolved(rows: DataFrame) -> DataFrame:
    """``package_id, n_capabilities, n_unresolved, ratio`` of capability rows whose scope isn't resolved."""
    out = rows.groupBy("package_id").agg(F.count(F.lit(1)).alias("n_capabilities"), F.count_if(~F.col("scope_resolved")).alias("n_unresolved"))
    return out.withColumn("ratio", F.col("n_unresolved") / F.greatest("n_capabilities", F.lit(1)))


def quality_score(risk: DataFrame, scopes: DataFrame, findings: DataFrame) -> DataFrame:
    """``package_id, score`` in 0..100: less for unresolved scopes (whole points), risk thirds and prohibited findings."""
    bad = findings.groupBy("package_id").agg(F.count_if(F.col("severity") == "prohibited").alias("p"))
    j = risk.join(scopes, "package_id").join(bad, "package_id", "left")
    score = 100 - (F.col("ratio") * 40).cast("int") - F.least(F.lit(30), F.expr("static_risk div 3")) - F.least(F.lit(20), 10 * F.coalesce("p", F.lit(0)))
    return j.select("package_id", F.greatest(score, F.lit(0)).cast("int").alias("score"))


def category_overlap(spark: SparkSession, packages: DataFrame, rows: DataFrame, unexpected: dict[str, list[str]]) -> DataFrame:
    """``package_id, category``: capability categories that are unexpected for a package's declared category."""
    table = F.broadcast(frame(spark, [(k, c) for k, v in unexpected.items() for c in v], "skill_category string, category string"))
    have = rows.select("package_id", "category").distinct()
    return packages.select("package_id", "skill_category").distinct().join(table, "skill_category").join(have, ["package_id", "category"]).select("package_id", "category")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with the side they are only on (``left`` or ``right``) or ``both``."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both")
    return a.join(b, keys, "full").select(*keys, side.alias("side"))


def absent_paths(named: DataFrame, have: DataFrame) -> DataFrame:
    """``package_id, path`` of named paths that a package has neither by path nor by the name of a file."""
    base = F.element_at(F.split("path", "/"), -1).alias("name")
    rest = named.join(have, ["package_id", "path"], "left_anti").select("package_id", "path", base)
    return rest.join(have.select("package_id", base).distinct(), ["package_id", "name"], "left_anti").select("package_id", "path")


def top_per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group, with ``rank``; partial results are cut to n before the shuffle by Spark."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def keyword_classes(spark: SparkSession, docs: DataFrame, key: str, keywords: dict[str, list[str]]) -> DataFrame:
    """``key, class, score, confidence``: per class the sum over its keywords of their hits in the lower-cased text, at
    most three each; the highest score wins, of equal ones the first class; below three none does."""
    low = F.lower("text")
    scores = []
    for i, (name, words) in enumerate(keywords.items()):
        total = F.lit(0)
        for w in words:
            hits = F.expr("0") + F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
            total = total + F.least(F.lit(3), hits)
        scores.append(F.struct((-total).alias("neg"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    best = docs.select(key, F.array_sort(F.array(*scores)).alias("s"))
    top = F.element_at("s", 1)
    tied = F.size(F.filter("s", lambda x: x["neg"] == F.element_at("s", 1)["neg"]))
    score = (-top["neg"]).alias("score")
    named = F.when(-top["neg"] < 3, F.lit("general")).otherwise(top["name"]).alias("class")
    sure = F.when(-top["neg"] < 3, "none").when((tied > 1) | (-top["neg"] <= 4), "low").otherwise("high").alias("confidence")
    return best.select(key, named, score, sure)
