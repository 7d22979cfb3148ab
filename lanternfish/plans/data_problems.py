"""The pN_ queries of the general problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.normalize import clean_hash, clean_path
from lanternfish.operators import drift
from lanternfish.operators.shredding import Child, Shape, element_listing, entity_table, shred
from lanternfish.operators.snapshots import snapshot_changes
from lanternfish.sources.storage import cut, table


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(drift.load_fields(table(spark, sf_dir, "artifact_records")), "artifact-fields")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields added, removed, renamed and retyped between consecutive files of a producer."""
    return drift.field_changes(_artifacts(spark, sf_dir))


def _cast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    loaded = _artifacts(spark, sf_dir)
    values = cut(drift.unified_values(loaded, drift.field_changes(loaded)), "values")
    targets = cut(drift.target_types(values), "targets")
    return loaded, drift.cast_values(values, targets), targets


def p1_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that don't fit their field's type, by field and raw type."""
    return drift.failed_casts(_cast(spark, sf_dir)[1])


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of all files in one table of typed columns."""
    loaded, cast, targets = _cast(spark, sf_dir)
    return drift.consistent_table(loaded, cast, targets)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths added, removed and changed between consecutive locks of a package."""
    out = snapshot_changes(
        table(spark, sf_dir, "merkle_leaves"),
        table(spark, sf_dir, "lock_snapshots"),
        group="package_id",
        number="snapshot_no",
        key=clean_path(F.col("path")),
        value=clean_hash(F.col("hash")),
        at="received_at",
        idx="idx",
    )
    return out.select("package_id", "snapshot_no", F.col("key").alias("path"), "change_kind")


_FINDINGS = ("deterministic.prohibited_findings", "deterministic.restricted_findings")
_RISKS = "deterministic.combination_risks"
_INSIGHTS = "deterministic.meta_insights"
REPORT_CHILDREN = {
    "merkle_leaf": Child("deterministic.merkle_tree.leaves", "path"),
    "merkle_node": Child("deterministic.merkle_tree.nodes"),
    "prohibited_finding": Child(_FINDINGS[0], "file"),
    "restricted_finding": Child(_FINDINGS[1], "file"),
    "prohibited_scope": Child(f"{_FINDINGS[0]}[].capability.scope", "", _FINDINGS[0]),
    "restricted_scope": Child(f"{_FINDINGS[1]}[].capability.scope", "", _FINDINGS[1]),
    "prohibited_tag": Child(f"{_FINDINGS[0]}[].tags", "", _FINDINGS[0]),
    "restricted_tag": Child(f"{_FINDINGS[1]}[].tags", "", _FINDINGS[1]),
    "external_binary": Child("deterministic.external_binaries"),
    "combination_risk": Child(_RISKS, "rule_id"),
    "matched_capability": Child(f"{_RISKS}[].matched_capabilities", "", _RISKS),
    "meta_insight": Child(_INSIGHTS, "category"),
    "meta_evidence": Child(f"{_INSIGHTS}[].evidence", "", _INSIGHTS),
    "unresolved_scope": Child("ephemeral.unresolved_scope_analysis", "file"),
    "permission_overreach": Child("ephemeral.taxonomy.permission_overreach"),
}
REPORT_SHAPE = Shape(
    arrays=frozenset(c.label for c in REPORT_CHILDREN.values()),
    objects=frozenset(["deterministic", "deterministic.merkle_tree", "deterministic.persona", "ephemeral", "ephemeral.taxonomy"])
    | {f"{c.label}[]" for c in REPORT_CHILDREN.values() if c.item}
    | {f"{f}[].capability" for f in _FINDINGS},
)


def latest_reports(reports: DataFrame) -> DataFrame:
    """``report_id, body`` of each report's latest delivery; of equally late ones the greatest body."""
    best = F.max(F.struct("received_at", "body")).alias("best")
    return reports.where(F.col("report_id").isNotNull()).groupBy("report_id").agg(best).select("report_id", "best.body")


def _report_nodes(spark: SparkSession, sf_dir: str, labels: list[str] | None = None) -> DataFrame:
    return shred(latest_reports(table(spark, sf_dir, "scan_reports")), "report_id", "body", REPORT_SHAPE, labels)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every array element of a report with its position, its parent's position and its item."""
    labels = [f"{c.label}[]" for c in REPORT_CHILDREN.values()] + [f"{c.label}[].{c.item}" for c in REPORT_CHILDREN.values() if c.item]
    nodes = cut(_report_nodes(spark, sf_dir, labels), "report-nodes")
    return element_listing(nodes, REPORT_CHILDREN).withColumnRenamed("record", "report_id")


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole adjacency table of all reports."""
    return _report_nodes(spark, sf_dir).withColumnRenamed("record", "report_id")


def _elements(spark: SparkSession, sf_dir: str, arrays: dict[str, str], fields: dict[str, str] | list[str], value: str = "value") -> DataFrame:
    """Rows of the elements of arrays (name of the list to its label): ``report_id, list, parent_ord, ord``, a column for each
    field (to its path below the element), and the element itself as ``value``. (report_id, list, ord) and, where another
    element holds the array, parent_ord are the key that tables are linked by. Of all nodes only theirs and those of the
    elements that hold them are read. An object has a null value, a scalar null fields; nulls give no row but keep their
    position."""
    fields = fields if isinstance(fields, dict) else {f: f for f in fields}
    held_by = {c.label: c.parents or None for c in REPORT_CHILDREN.values()}
    labels = {f"{a}[]{tail}" for a in arrays.values() for tail in ["", *(f".{f}" for f in fields.values())]} | {f"{held_by[a]}[]" for a in arrays.values() if held_by[a]}
    nodes = cut(_report_nodes(spark, sf_dir, sorted(labels)), "report-nodes")
    out = None
    for name, label in arrays.items():
        part = entity_table(nodes, label, fields, held_by[label]).select("record", F.lit(name).alias("list"), "parent_ord", "ord", *fields, F.col("value").alias(value))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("record", "report_id")


def _of_findings(below: str = "") -> dict[str, str]:
    return {f.rpartition(".")[2]: f + below for f in _FINDINGS}


def p4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per finding of a report."""
    fields = {n: n for n in ("file", "line", "col", "pattern", "severity", "message", "suggested_fix")} | {n: f"capability.{n}" for n in ("category", "action", "scope_resolved")}
    out = _elements(spark, sf_dir, _of_findings(), fields).drop("parent_ord", "value")
    return out.withColumn("line", F.col("line").try_cast("int")).withColumn("col", F.col("col").try_cast("int")).withColumn("scope_resolved", F.col("scope_resolved").try_cast("boolean"))


def p4_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per Merkle leaf of a report."""
    return _elements(spark, sf_dir, {"leaf": "deterministic.merkle_tree.leaves"}, ["path", "hash"]).drop("list", "parent_ord", "value")


def p4_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per combination risk of a report."""
    out = _elements(spark, sf_dir, {"risk": _RISKS}, ["rule_id", "severity", "risk_override"]).drop("list", "parent_ord", "value")
    return out.withColumn("risk_override", F.col("risk_override").try_cast("int"))


def p4_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per insight of a report."""
    return _elements(spark, sf_dir, {"insight": _INSIGHTS}, ["category", "severity", "title"]).drop("list", "parent_ord", "value")


def p4_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of evidence; parent_ord is the position of its insight."""
    return _elements(spark, sf_dir, {"evidence": f"{_INSIGHTS}[].evidence"}, [], "evidence").drop("list")


def p4_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flat row per unresolved scope that a report looks into."""
    out = _elements(spark, sf_dir, {"scope": "ephemeral.unresolved_scope_analysis"}, ["file", "line", "llm_opinion"]).drop("list", "parent_ord", "value")
    return out.withColumn("line", F.col("line").try_cast("int"))


def p4_overreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per permission beyond what the taxonomy of a report expects."""
    return _elements(spark, sf_dir, {"overreach": "ephemeral.taxonomy.permission_overreach"}, [], "permission").drop("list", "parent_ord")


def p4_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per scope of a finding; list and parent_ord name the finding."""
    return _elements(spark, sf_dir, _of_findings("[].capability.scope"), [], "scope")


def p4_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per tag of a finding; list and parent_ord name the finding."""
    return _elements(spark, sf_dir, _of_findings("[].tags"), [], "tag")


def p4_risk_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per capability that a combination risk was matched by; parent_ord is the position of the risk."""
    return _elements(spark, sf_dir, {"matched": f"{_RISKS}[].matched_capabilities"}, [], "capability").drop("list")
