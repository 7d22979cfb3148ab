"""DuckDB SQL for the pN_ queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}


def _valid(text: str) -> str:
    """Whether a text is JSON without extensions; DuckDB itself takes NaN, Infinity and commas before a closing bracket."""
    outside = f"""regexp_replace({text}, '"(\\\\.|[^"\\\\])*"', '""', 'g')"""
    return f"(json_valid({text}) AND NOT regexp_matches({outside}, 'NaN|Infinity|,\\s*[\\]}}]'))"


def _object(value: str) -> str:
    """A value, or the object or array that a string holds."""
    inner = f"({value} ->> '$')"
    return f"CASE WHEN json_type({value}) = 'VARCHAR' AND json_valid({inner}) AND json_type(CASE WHEN json_valid({inner}) THEN {inner}::JSON END) IN ('ARRAY', 'OBJECT') THEN {inner}::JSON ELSE {value} END"


def _array(value: str) -> str:
    """The elements of an array; a single value is its only element, null has none."""
    held = _object(value)
    return f"CASE json_type({held}) WHEN 'ARRAY' THEN CAST({held} AS JSON[]) WHEN 'NULL' THEN CAST([] AS JSON[]) ELSE CASE WHEN {held} IS NULL THEN CAST([] AS JSON[]) ELSE [{held}] END END"


def _elements(name: str, source: str, array: str, *, objects: bool, parent: str = "-1", keep: str = "") -> str:
    """A table ``report_id, parent_ord, ord, v`` of the elements of an array of each row of a source."""
    held = _object("v") if objects else "v"
    inner = f"SELECT report_id, {keep}{parent} AS parent_ord, {_array(array)} AS l FROM {source}"
    listed = f"SELECT report_id, {keep}parent_ord, unnest(range(len(l))) AS ord, unnest(l) AS v FROM ({inner})"
    return f"{name} AS (SELECT report_id, {keep}parent_ord, ord, {held} AS v FROM ({listed}) WHERE json_type(v) <> 'NULL')"


_SIDES = "list, "
_FINDINGS_OF = "(SELECT report_id, 'prohibited' AS list, d -> 'prohibited_findings' AS a FROM parts UNION ALL SELECT report_id, 'restricted', d -> 'restricted_findings' FROM parts)"
_REPORTS = ",\n".join(
    [
        f"""WITH latest AS (SELECT report_id, body FROM scan_reports WHERE report_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY received_at DESC NULLS LAST, body DESC NULLS LAST) = 1)""",
        f"docs AS (SELECT report_id, {_object('b')} AS b FROM (SELECT report_id, CASE WHEN {_valid('body')} THEN body::JSON END AS b FROM latest) WHERE b IS NOT NULL)",
        f"halves AS (SELECT report_id, {_object('d')} AS d, {_object('e')} AS e FROM (SELECT report_id, b -> 'deterministic' AS d, b -> 'ephemeral' AS e FROM docs))",
        f"parts AS (SELECT report_id, d, e, {_object('m')} AS m, {_object('t')} AS t FROM (SELECT *, d -> 'merkle_tree' AS m, e -> 'taxonomy' AS t FROM halves))",
        _elements("leaf", "parts", "(m -> 'leaves')", objects=True),
        _elements("node", "parts", "(m -> 'nodes')", objects=False),
        _elements("finding", _FINDINGS_OF, "a", objects=True, keep=_SIDES),
        f"capable AS (SELECT report_id, list, ord, {_object('c')} AS c, v -> 'tags' AS g FROM (SELECT *, v -> 'capability' AS c FROM finding))",
        _elements("scope", "(SELECT report_id, list, ord AS up, c -> 'scope' AS a FROM capable)", "a", objects=False, parent="up", keep=_SIDES),
        _elements("tag", "(SELECT report_id, list, ord AS up, g AS a FROM capable)", "a", objects=False, parent="up", keep=_SIDES),
        _elements("bin", "parts", "(d -> 'external_binaries')", objects=False),
        _elements("risk", "parts", "(d -> 'combination_risks')", objects=True),
        _elements("matched", "(SELECT report_id, ord AS up, v -> 'matched_capabilities' AS a FROM risk)", "a", objects=False, parent="up"),
        _elements("insight", "parts", "(d -> 'meta_insights')", objects=True),
        _elements("evidence", "(SELECT report_id, ord AS up, v -> 'evidence' AS a FROM insight)", "a", objects=False, parent="up"),
        _elements("unresolved", "parts", "(e -> 'unresolved_scope_analysis')", objects=True),
        _elements("overreach", "parts", "(t -> 'permission_overreach')", objects=False),
    ]
)


def _items(table: str, child: str, item: str = "") -> str:
    value = f"CASE WHEN json_type(v) = 'OBJECT' THEN v ->> '{item}' ELSE v ->> '$' END" if item else "v ->> '$'"
    return f"SELECT report_id, {child} AS child, parent_ord::INT AS parent_ord, ord::INT AS ord, {value} AS item FROM {table}"


SQL["p4_found"] = (
    _REPORTS
    + "\n"
    + "\nUNION ALL ".join(
        [
            _items("leaf", "'merkle_leaf'", "path"),
            _items("node", "'merkle_node'"),
            _items("finding", "list || '_finding'", "file"),
            _items("scope", "list || '_scope'"),
            _items("tag", "list || '_tag'"),
            _items("bin", "'external_binary'"),
            _items("risk", "'combination_risk'", "rule_id"),
            _items("matched", "'matched_capability'"),
            _items("insight", "'meta_insight'", "category"),
            _items("evidence", "'meta_evidence'"),
            _items("unresolved", "'unresolved_scope'", "file"),
            _items("overreach", "'permission_overreach'"),
        ]
    )
)


def _rows(table: str, *columns: str) -> str:
    return f"{_REPORTS}\nSELECT report_id, {', '.join(columns)}, ord::INT AS ord FROM {table}"


def _field(name: str, of: str = "v", kind: str = "VARCHAR") -> str:
    """A scalar field of an element; null where it holds an object or array."""
    return f"TRY_CAST(CASE WHEN json_type({of} -> '{name}') NOT IN ('OBJECT', 'ARRAY') THEN {of} ->> '{name}' END AS {kind}) AS \"{name}\""


def _own(name: str) -> str:
    return f"CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN v ->> '$' END AS {name}"


_LIST, _UP = "list || '_findings' AS list", "parent_ord::INT AS parent_ord"
SQL["p4_findings"] = _rows(
    "finding JOIN capable USING (report_id, list, ord)", _LIST, _field("file"), _field("line", kind="INT"), _field("col", kind="INT"),
    *map(_field, ("pattern", "severity", "message", "suggested_fix")), _field("category", "c"), _field("action", "c"), _field("scope_resolved", "c", "BOOLEAN"),
)
SQL["p4_leaves"] = _rows("leaf", _field("path"), _field("hash"))
SQL["p4_risks"] = _rows("risk", _field("rule_id"), _field("severity"), _field("risk_override", kind="INT"))
SQL["p4_insights"] = _rows("insight", *map(_field, ("category", "severity", "title")))
SQL["p4_unresolved"] = _rows("unresolved", _field("file"), _field("line", kind="INT"), _field("llm_opinion"))
SQL["p4_scopes"] = _rows("scope", _LIST, _UP, _own("scope"))
SQL["p4_tags"] = _rows("tag", _LIST, _UP, _own("tag"))
SQL["p4_evidence"] = _rows("evidence", _UP, _own("evidence"))
SQL["p4_risk_capabilities"] = _rows("matched", _UP, _own("capability"))
SQL["p4_overreach"] = _rows("overreach", _own("permission"))

_KIND = """CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array of' WHEN 'NULL' THEN 'null' ELSE 'number' END"""
_TYPE = f"""CASE json_type(v) WHEN 'ARRAY' THEN rtrim('array of ' || coalesce(nullif({_KIND.format(v="(v -> '$[0]')")}, 'null'), '')) ELSE {_KIND.format(v="v")} END"""
SQL["p1_found"] = f"""
WITH RECURSIVE records AS (
  SELECT record_id, producer_id, artifact, file_seq, package_id, CASE WHEN {_valid("body")} THEN body::JSON END AS b FROM artifact_records),
walk AS (
  SELECT r.record_id, e.key AS path, e.key AS k, e.value::JSON AS v FROM records r, json_each(CASE WHEN json_type(r.b) = 'OBJECT' THEN r.b END) e
  UNION ALL
  SELECT w.record_id, w.path || '.' || e.key, e.key, e.value::JSON FROM walk w, json_each(CASE WHEN json_type(w.v) = 'OBJECT' AND w.k <> 'capabilities' THEN w.v END) e),
vals AS (
  SELECT r.producer_id, r.artifact, r.file_seq, r.package_id, w.path, {_TYPE} AS type,
    CASE WHEN json_type(v) = 'DOUBLE' AND TRY_CAST(v ->> '$' AS DOUBLE) = round(TRY_CAST(v ->> '$' AS DOUBLE)) AND abs(TRY_CAST(v ->> '$' AS DOUBLE)) < 1e15
      THEN TRY_CAST(TRY_CAST(v ->> '$' AS DOUBLE) AS BIGINT)::VARCHAR ELSE v ->> '$' END AS value
  FROM walk w JOIN records r USING (record_id)
  WHERE json_type(v) <> 'NULL' AND (json_type(v) <> 'OBJECT' OR k = 'capabilities')),
n_rows AS (SELECT producer_id, artifact, file_seq, count(*) AS n FROM records GROUP BY ALL),
by_type AS (SELECT producer_id, artifact, file_seq, path, type, count(*) AS n FROM vals GROUP BY ALL),
fields AS (
  SELECT b.producer_id, b.artifact, b.file_seq, b.path, b.type
  FROM (SELECT *, sum(n) OVER (PARTITION BY producer_id, artifact, file_seq, path) AS carried,
          row_number() OVER (PARTITION BY producer_id, artifact, file_seq, path ORDER BY (type = 'array of')::INT, n DESC, type) AS place FROM by_type) b
  JOIN n_rows r USING (producer_id, artifact, file_seq) WHERE place = 1 AND carried * 2 > r.n),
pairs AS (
  SELECT * FROM (SELECT producer_id, artifact, file_seq, lag(file_seq) OVER (PARTITION BY producer_id, artifact ORDER BY file_seq) AS prev FROM n_rows) WHERE prev IS NOT NULL),
early AS (SELECT p.producer_id, p.artifact, p.file_seq, p.prev, f.path, f.type FROM pairs p JOIN fields f ON f.producer_id = p.producer_id AND f.artifact = p.artifact AND f.file_seq = p.prev),
late AS (SELECT p.producer_id, p.artifact, p.file_seq, p.prev, f.path, f.type FROM pairs p JOIN fields f USING (producer_id, artifact, file_seq)),
gone AS (SELECT * FROM early ANTI JOIN late USING (producer_id, artifact, file_seq, path)),
come AS (SELECT * FROM late ANTI JOIN early USING (producer_id, artifact, file_seq, path)),
before AS (SELECT DISTINCT g.producer_id, g.artifact, g.file_seq, g.path AS old, g.type, v.package_id, v.value
  FROM gone g JOIN vals v ON v.producer_id = g.producer_id AND v.artifact = g.artifact AND v.file_seq = g.prev AND v.path = g.path WHERE v.package_id IS NOT NULL),
after AS (SELECT DISTINCT c.producer_id, c.artifact, c.file_seq, c.path AS new, c.type, v.package_id, v.value
  FROM come c JOIN vals v USING (producer_id, artifact, file_seq, path) WHERE v.package_id IS NOT NULL),
shares AS (
  SELECT b.producer_id, b.artifact, b.file_seq, b.old, a.new, count(DISTINCT b.package_id) AS n_both,
    count(DISTINCT CASE WHEN a.value = b.value THEN b.package_id END) AS n_equal
  FROM before b JOIN after a USING (producer_id, artifact, file_seq, type, package_id) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY producer_id, artifact, file_seq ORDER BY n_equal / n_both DESC, old, new) AS place FROM shares WHERE n_equal > 0 AND n_equal * 2 >= n_both),
taken AS (
  SELECT producer_id, artifact, file_seq, place, old, new, true AS ok, [old] AS olds, [new] AS news FROM ranked WHERE place = 1
  UNION ALL
  SELECT r.producer_id, r.artifact, r.file_seq, r.place, r.old, r.new, NOT list_contains(t.olds, r.old) AND NOT list_contains(t.news, r.new),
    CASE WHEN list_contains(t.olds, r.old) OR list_contains(t.news, r.new) THEN t.olds ELSE list_append(t.olds, r.old) END,
    CASE WHEN list_contains(t.olds, r.old) OR list_contains(t.news, r.new) THEN t.news ELSE list_append(t.news, r.new) END
  FROM taken t JOIN ranked r ON r.producer_id = t.producer_id AND r.artifact = t.artifact AND r.file_seq = t.file_seq AND r.place = t.place + 1),
renamed AS (SELECT producer_id, artifact, file_seq, old, new FROM taken WHERE ok)
SELECT producer_id, artifact, file_seq, 'renamed' AS change_kind, old AS field_path, new AS new_path FROM renamed
UNION ALL
SELECT producer_id, artifact, file_seq, 'removed', path, '' FROM gone g
WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.producer_id = g.producer_id AND r.artifact = g.artifact AND r.file_seq = g.file_seq AND r.old = g.path)
UNION ALL
SELECT producer_id, artifact, file_seq, 'added', path, '' FROM come c
WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.producer_id = c.producer_id AND r.artifact = c.artifact AND r.file_seq = c.file_seq AND r.new = c.path)
UNION ALL
SELECT e.producer_id, e.artifact, e.file_seq, 'retyped', e.path, '' FROM early e JOIN late l USING (producer_id, artifact, file_seq, path)
WHERE e.type <> l.type AND NOT (e.type = 'array of' AND l.type LIKE 'array%') AND NOT (l.type = 'array of' AND e.type LIKE 'array%')
"""

SQL["p3_found"] = r"""
WITH leaves AS (
  SELECT package_id, snapshot_no, received_at, idx,
         regexp_replace(regexp_replace(path, '[/\\]+', '/', 'g'), '^(\./)+', '') AS p,
         regexp_replace(lower(regexp_replace(hash, '^\s+|\s+$', '', 'g')), '^sha256:\s*', '') AS h
  FROM merkle_leaves WHERE package_id IS NOT NULL AND snapshot_no IS NOT NULL),
snaps AS (
  SELECT package_id, snapshot_no, lag(snapshot_no) OVER (PARTITION BY package_id ORDER BY snapshot_no) AS prev
  FROM (SELECT package_id, snapshot_no FROM leaves UNION SELECT package_id, snapshot_no FROM lock_snapshots)),
cur AS (
  SELECT package_id, snapshot_no, p, h FROM leaves WHERE p IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY package_id, snapshot_no, p ORDER BY received_at DESC, idx DESC, h DESC) = 1),
late AS (SELECT s.package_id, s.snapshot_no, c.p, c.h FROM snaps s JOIN cur c ON c.package_id = s.package_id AND c.snapshot_no = s.snapshot_no WHERE s.prev IS NOT NULL),
early AS (SELECT s.package_id, s.snapshot_no, c.p, c.h FROM snaps s JOIN cur c ON c.package_id = s.package_id AND c.snapshot_no = s.prev)
SELECT coalesce(a.package_id, b.package_id) AS package_id, coalesce(a.snapshot_no, b.snapshot_no) AS snapshot_no,
       coalesce(a.p, b.p) AS path,
       CASE WHEN b.p IS NULL THEN 'added' WHEN a.p IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM late a FULL JOIN early b ON a.package_id = b.package_id AND a.snapshot_no = b.snapshot_no AND a.p = b.p
WHERE a.p IS NULL OR b.p IS NULL OR a.h <> b.h
"""
