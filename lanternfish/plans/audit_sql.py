"""DuckDB SQL of the audit queries, over the same rule data."""

from __future__ import annotations

from lanternfish.functions import rules as R
from lanternfish.plans import audit as Q


def _text(x: object) -> str:
    if isinstance(x, bool):
        return "true" if x else "false"
    return str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], name: str, columns: str) -> str:
    body = ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS v({columns}))"


def _list(items) -> str:
    return "(" + ", ".join(map(_text, items)) + ")"


_SUFFIX = r"regexp_extract(path, '[^/.](\.[^./]+)$', 1)"
_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _lines(source: str, key: str, where: str = "true", text: str = "text") -> str:
    return f"""pieces AS (SELECT {key}, string_split_regex({text}, '{_END}') AS p FROM {source} WHERE text IS NOT NULL AND {where}),
every AS (SELECT {key}, unnest(p) AS text, generate_subscripts(p, 1) AS line, len(p) AS n FROM pieces),
lines AS (SELECT {key}, line::int AS line, text FROM every WHERE NOT (line = n AND text = ''))"""


# Suffixes of each language.
_LANGUAGE = f"""CASE WHEN {_SUFFIX} = '.py' THEN 'python' WHEN {_SUFFIX} IN ('.sh', '.bat', '.ps1', '.bash', '.zsh', '.fish') THEN 'shell'
WHEN {_SUFFIX} IN ('.js', '.ts', '.mjs', '.cjs', '.jsx', '.tsx') THEN 'javascript' WHEN {_SUFFIX} IN ('.json', '.yaml', '.yml', '.toml', '.cfg', '.ini') THEN 'config' END"""
_THIN = r"\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{ad}\x{34f}\x{180e}"
_QUOTED_OR_COMMENT = r"""('[^']*(?:'|$)|"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?$)|\\.)|#.*""".replace("'", "''")
_JS_PIECE = r"""(?s)"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|//[^\r\n]*|/\*.*?(?:\*/|\z)|[^"'`/]+|.""".replace("'", "''")
_JS_TEXT = f"""array_to_string(list_transform(regexp_extract_all(text, '{_JS_PIECE}'), lambda c: CASE WHEN starts_with(c, '//') OR starts_with(c, '/*') THEN regexp_replace(c, '[^\\r\\n\\x{{2028}}\\x{{2029}}]', '', 'g') ELSE c END), '')"""
_CODE = f"""lang AS (SELECT file_id, package_id, {_LANGUAGE} AS language, text FROM source_files WHERE text IS NOT NULL),
{_lines("lang", "file_id, package_id, language", "language IS NOT NULL", f"CASE WHEN language = 'javascript' THEN {_JS_TEXT} ELSE text END")},
code AS (SELECT file_id, package_id, language, line, CASE WHEN language = 'shell' THEN regexp_replace(text, '{_QUOTED_OR_COMMENT}', '\\1', 'g') ELSE text END AS text FROM lines)"""


def _rules(tables: dict) -> str:
    rows = [(k, r.rule_id, r.table, r.ord, r.literal, r.pattern, r.severity, r.category, r.action, r.once, r.scoped) for k, t in tables.items() for x in t for r in x]
    return _values(rows, "rules", 'language, rule_id, tbl, ord, literal, pattern, severity, category, "action", once, scoped')


_HIT = "l.language = r.language AND contains(CASE WHEN starts_with(r.pattern, '(?i)') THEN lower(l.text) ELSE l.text END, r.literal) AND regexp_matches(l.text, r.pattern)"


def _every(language: str, rules: list) -> str:
    return f"""WITH {_CODE}, {_rules({language: [rules]})}
SELECT l.file_id, l.line, r.rule_id, r.severity, r.category, r."action" FROM code l JOIN rules r ON {_HIT}"""


def _once(language: str) -> str:
    return f"""WITH {_CODE}, {_rules({language: R.SCANS[language]})},
firsts AS (SELECT l.file_id, l.line, l.text, r.* FROM code l JOIN rules r ON {_HIT} QUALIFY row_number() OVER (PARTITION BY l.file_id, l.line, r.tbl ORDER BY r.ord) = 1),
named AS (SELECT *, CASE WHEN scoped THEN regexp_extract(text, '(?:' || pattern || ')[^''"]*[''"]([^''"]+)[''"]', 1) ELSE '' END AS quoted FROM firsts WHERE severity <> 'info')
SELECT file_id, category || ':' || "action" || CASE WHEN once = 'rule' THEN ':' || rule_id ELSE '' END AS claim, line, rule_id, severity, category, "action",
CASE WHEN starts_with(quoted, 'http') OR starts_with(quoted, '/') THEN quoted ELSE '*' END AS scope FROM named
QUALIFY row_number() OVER (PARTITION BY file_id, claim ORDER BY line, ord, rule_id) = 1"""


_F = "fnd AS (SELECT * FROM findings WHERE finding_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY received_at DESC, ord DESC) = 1)"
_C = _F + """, caps AS (SELECT package_id, string_split(file, '/') AS parts, file, line, ord, finding_id, capability.category AS category, capability."action" AS act, capability.scope AS scope, capability.scope_resolved AS scope_resolved
FROM fnd WHERE capability IS NOT NULL AND package_id IS NOT NULL)"""
_BINS = "bins AS (SELECT DISTINCT package_id, string_split(v, '/')[-1] AS name FROM (SELECT package_id, unnest(scope) AS v FROM caps WHERE category = 'subprocess' AND act = 'exec') WHERE v <> '*')"
_CLASS = f"cls AS (SELECT package_id, name, CASE WHEN name IN {_list(R.DENIED_BINARIES)} THEN 'deny' WHEN name IN {_list(R.ALLOWED_BINARIES)} THEN 'allow' ELSE 'unrecognized' END AS class FROM bins)"
_COMBO = _values([(r, s, c, n, k, len(set(cs))) for r, s, cs, n, k in R.COMBINATIONS for c in sorted(set(cs))], "combo", "rule_id, severity, cap, needs, risk, n_caps") + f""",
fired AS (SELECT h.package_id, c.rule_id, c.severity, c.risk, string_agg(h.cap, '|' ORDER BY h.cap) AS matched
FROM (SELECT DISTINCT package_id, category || ':' || act AS cap FROM caps) h JOIN combo c USING (cap)
WHERE NOT c.needs OR h.package_id IN (SELECT package_id FROM bins WHERE name NOT IN {_list(R.ALLOWED_BINARIES)})
GROUP BY h.package_id, c.rule_id, c.severity, c.risk, c.n_caps HAVING count(*) = c.n_caps)"""
_GLOBS = _values([(g, R.glob_regex(g)) for g in R.DENIED_PATHS], "globs", '"glob", rx')
_PATHS = _GLOBS + """, viol AS (SELECT package_id, v AS "value", "glob" FROM (SELECT package_id, unnest(scope) AS v FROM caps WHERE category = 'fs' AND act IN ('write', 'delete')) s
JOIN globs ON regexp_matches(replace(CASE WHEN v LIKE '~%' THEN '/home/user' || v[2:] ELSE v END, '\\', '/'), rx) WHERE v <> '*')"""
_POINTS = "CASE WHEN category IN ('subprocess', 'browser', 'secret') THEN 15 WHEN category IN ('network', 'fs') THEN 10 WHEN category = 'serial' THEN 12 WHEN category IN ('crypto', 'system', 'concurrency') THEN 2 ELSE 5 END"
_MAP = """flat AS (SELECT package_id, category, act, unnest(scope) AS v, generate_subscripts(scope, 1) AS pos, parts, line, ord, finding_id FROM caps),
met AS (SELECT * FROM flat QUALIFY row_number() OVER (PARTITION BY package_id, category, act, v ORDER BY parts, line, ord, finding_id, pos) = 1),
cmap AS (SELECT package_id, category, act, string_agg(v, '|' ORDER BY parts, line, ord, finding_id, pos) AS scopes FROM met GROUP BY ALL)"""
_CLEAN = r"regexp_replace(regexp_replace({}, '[/\\]+', '/', 'g'), '^(\./)+', '')"
_HASH = r"sha256(regexp_replace(text, '\r\n?', chr(10), 'g'))"


def _policy() -> str:
    rows = [(("deny", "allow").index(a), -p, i, r, a, cap, R.glob_regex(g)) for i, (r, a, cap, globs, p) in enumerate(R.POLICY) if a in ("deny", "allow") for g in globs]
    return _values(rows, "pol", "kind, prio, n, rule_id, decision, cap, rx")


def _keyword_sql() -> str:
    scores = []
    for i, (name, words) in enumerate(R.KEYWORDS.items()):
        total = " + ".join(f"least(3, (length(low) - length(replace(low, {_text(w)}, ''))) // {len(w)})" for w in words)
        scores.append(f"SELECT doc_id, {i} AS i, {_text(name)} AS name, ({total})::int AS score FROM d")
    return f"""WITH d AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL), s AS ({' UNION ALL '.join(scores)}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS k, count(*) OVER (PARTITION BY doc_id, score) AS tied FROM s)
SELECT doc_id, CASE WHEN score < 3 THEN 'general' ELSE name END AS class, score, CASE WHEN score < 3 THEN 'none' WHEN tied > 1 OR score <= 4 THEN 'low' ELSE 'high' END AS confidence FROM r WHERE k = 1"""


def _case(pairs: list[tuple[str, str]], form: str) -> str:
    return "CASE " + " ".join(f"WHEN {form.format(t=_text(t))} THEN {_text(a)}" for t, a in pairs) + " END"


def _config_sql() -> str:
    text = "value_type = 'str' AND "
    tests = {
        "url": text + "regexp_matches(\"value\", '^https?://')",
        "secret": text + "regexp_matches(lower(key), '(pass|secret|token|api.?key)') AND length(\"value\") > 0",
        "base64": text + "regexp_matches(\"value\", '^[A-Za-z0-9+/]{40,}={0,2}$')",
        "jwt": text + "regexp_matches(\"value\", '^eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.')",
        "sensitive_path": text + "regexp_matches(\"value\", '(\\.ssh/|\\.pem$|/etc/)')",
        "connection": text + "regexp_matches(\"value\", '^[a-z+]+://[^/@: ]+:[^/@ ]+@')",
        "command": text + "regexp_matches(lower(key), '(command|cmd|exec)')",
    }
    each = " UNION ALL ".join(f"SELECT package_id, path, key_path, \"value\", '{n}' AS detector FROM e WHERE {t}" for n, t in tests.items())
    return f"""WITH e AS (SELECT DISTINCT * FROM config_entries), h AS ({each})
SELECT package_id, path, detector, CASE WHEN detector IN ('url', 'command') THEN "value" ELSE '' END AS claim, min(key_path) AS key_path, count(*) AS n FROM h GROUP BY 1, 2, 3, 4"""


_TREE = f"""leaf AS (SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY string_split(path, '/')) - 1 AS i, {_HASH} AS h, count(*) OVER (PARTITION BY package_id) AS n FROM source_files WHERE text IS NOT NULL),
lv AS (SELECT package_id, 0 AS l, i, h, n FROM leaf UNION ALL
SELECT package_id, l + 1, i // 2, sha256(min_by(h, i) || max_by(h, i)), (n + 1) // 2 FROM lv WHERE n > 1 GROUP BY package_id, l, i // 2, n)"""

_LOCKED = f"""lv AS (SELECT package_id, snapshot_no, received_at, idx, {_CLEAN.format('path')} AS p, regexp_replace(lower(trim(hash, ' ' || chr(9) || chr(10) || chr(13))), '^sha256:\\s*', '') AS h FROM merkle_leaves WHERE path IS NOT NULL AND hash IS NOT NULL),
locked AS (SELECT package_id, p, h FROM lv WHERE (package_id, snapshot_no) IN (SELECT package_id, max(snapshot_no) FROM lv GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY package_id, p ORDER BY received_at DESC, idx DESC, h DESC) = 1),
cur AS (SELECT package_id, {_CLEAN.format('path')} AS p, {_HASH} AS now FROM source_files WHERE text IS NOT NULL)"""

SQL: dict[str, str] = {
    "line_counts": f"WITH {_lines('source_files', 'file_id')} SELECT file_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(text) = '') AS n_blank, max(length(text))::int AS longest FROM lines GROUP BY 1",
    "file_routes": f"""WITH f AS (SELECT {_LANGUAGE} AS language, lower(string_split(path, '/')[-1]) AS name, length(text) AS n FROM source_files),
r AS (SELECT language AS route, n FROM f WHERE language IS NOT NULL UNION ALL SELECT 'docker', n FROM f WHERE name IN ('dockerfile', 'containerfile') OR name LIKE 'dockerfile.%' OR name LIKE '%.dockerfile')
SELECT route, count(*) AS n_files, sum(n)::bigint AS n_chars FROM r GROUP BY 1""",
    "files_kept": f"""SELECT package_id, count(*) AS n_files, min(path) AS first_path FROM source_files
WHERE NOT list_has_any(string_split(path, '/'), [{", ".join(_text(x) for x in R.IGNORED if not x.startswith("*"))}]) AND {" AND ".join(f"NOT ends_with(path, {_text(x[1:])})" for x in R.IGNORED if x.startswith("*"))} GROUP BY 1""",
    "main_file": """WITH c AS (SELECT package_id, path, list_position(['settings.json', 'settings.yaml', 'config.toml', 'index.py', 'main.py', 'main.sh'], string_split(path, '/')[-1]) AS r FROM source_files)
SELECT package_id, path FROM c WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY r, path) = 1""",
    "shell_prohibited": _every("shell", R.SHELL_PROHIBITED),
    "shell_capabilities": _once("shell"),
    "js_prohibited": _every("javascript", R.JS_PROHIBITED),
    "js_capabilities": _once("javascript"),
    "python_patterns": _every("python", R.PY_RULES),
    "pattern_totals": f"""WITH {_CODE}, {_rules({k: [*t, R.PROHIBITED.get(k, [])] for k, t in R.SCANS.items()})}
SELECT r.rule_id, count(*) AS n_findings, count(DISTINCT l.file_id) AS n_files, count(DISTINCT l.package_id) AS n_packages FROM code l JOIN rules r ON {_HIT} GROUP BY 1""",
    "config_detections": _config_sql(),
    "hidden_characters": f"""WITH b AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'file', file_id, text FROM source_files WHERE lower({_SUFFIX}) NOT IN {_list(R.BINARY_SUFFIXES)}),
d AS (SELECT kind, id, CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END AS t FROM b),
h AS (SELECT kind, id, t, regexp_extract_all(t, '[{_THIN}]') AS hits, regexp_extract(t, '^[^{_THIN}]*') AS before FROM d)
SELECT kind, id, len(hits)::int AS n_hidden, array_to_string(list_sort(list_distinct(list_transform(hits, lambda c: printf('%04X', unicode(c))))), ',') AS codes,
(1 + length(before) - length(replace(before, chr(10), '')))::int AS first_line FROM h WHERE len(hits) > 0""",
    "foreign_letters": f"""WITH f AS (SELECT file_id, text, regexp_extract(text, '^[^{R.LOOK_ALIKES[1:-1]}]*') AS before FROM source_files WHERE lower({_SUFFIX}) IN {_list(R.SOURCE_SUFFIXES)} AND regexp_matches(text, '{R.LOOK_ALIKES}'))
SELECT file_id, len(regexp_extract_all(text, '{R.LOOK_ALIKES}'))::int AS n_foreign, (1 + length(before) - length(replace(before, chr(10), '')))::int AS first_line FROM f""",
    "text_files": f"""SELECT lower({_SUFFIX}) AS suffix, count(*) AS n_files, coalesce(sum(length(text)), 0)::bigint AS n_chars FROM source_files WHERE lower({_SUFFIX}) NOT IN {_list(R.BINARY_SUFFIXES)} GROUP BY 1""",
    "shadowing_modules": f"""WITH m AS (SELECT package_id, path, CASE WHEN NOT contains(path, '/') AND path LIKE '%.py' THEN path[:-4] WHEN len(string_split(path, '/')) = 2 AND string_split(path, '/')[2] = '__init__.py' THEN string_split(path, '/')[1] END AS module FROM source_files)
SELECT package_id, module, min(path) AS path, CASE WHEN module IN {_list(Q.SENSITIVE_STDLIB)} THEN 'prohibited' ELSE 'restricted' END AS severity FROM m WHERE module IN {_list(Q.STDLIB)} GROUP BY 1, 2""",
    "deduplicated_findings": f"""WITH {_F} SELECT package_id, pattern, count(*) AS n FROM fnd a WHERE pattern LIKE 'config:%'
AND NOT EXISTS (SELECT 1 FROM fnd b WHERE b.pattern NOT LIKE 'config:%' AND a.package_id = b.package_id AND a.file = b.file AND a.line = b.line) GROUP BY 1, 2""",
    "capability_set": f"""WITH {_C} SELECT DISTINCT package_id, category, act AS "action", coalesce(array_to_string(scope, '|'), '') AS scope FROM caps""",
    "capability_map": f"""WITH {_C}, {_MAP} SELECT package_id, category, act AS "action", scopes FROM cmap""",
    "visible_map": f"""WITH {_C}, {_MAP} SELECT package_id, category, act AS "action", scopes FROM cmap m WHERE category NOT IN {_list(Q.QUIET)} OR EXISTS (SELECT 1 FROM fnd f WHERE f.severity = 'restricted' AND f.capability IS NOT NULL AND f.package_id = m.package_id AND f.capability.category = m.category)""",
    "binary_classes": f"WITH {_C}, {_BINS}, {_CLASS} SELECT * FROM cls",
    "combinations": f"WITH {_C}, {_BINS}, {_COMBO} SELECT * FROM fired",
    "path_violations": f"WITH {_C}, {_PATHS} SELECT * FROM viol",
    "policy_decisions": f"""WITH {_C}, vals AS (SELECT DISTINCT package_id, category || ':' || act AS cap, unnest(scope) AS v FROM caps), {_policy()},
hit AS (SELECT vals.package_id, vals.cap, v, decision, rule_id FROM vals LEFT JOIN pol ON vals.cap = pol.cap AND regexp_matches(v, rx) QUALIFY row_number() OVER (PARTITION BY vals.package_id, vals.cap, v ORDER BY kind, prio, n) = 1)
SELECT package_id, cap, v AS "value", coalesce(decision, 'deny') AS decision, coalesce(rule_id, 'default') AS rule_id FROM hit""",
    "static_risk": f"""WITH {_C}, {_BINS}, {_CLASS}, {_COMBO}, {_PATHS},
one AS (SELECT * FROM caps QUALIFY row_number() OVER (PARTITION BY package_id, category, act ORDER BY parts, line, ord, finding_id) = 1),
b AS (SELECT package_id, sum({_POINTS} + CASE WHEN list_contains(scope, '*') AND category IN ('subprocess', 'browser', 'secret', 'network', 'fs') THEN 5 ELSE 0 END) AS base FROM one GROUP BY 1),
l AS (SELECT package_id, max(risk) AS least FROM fired GROUP BY 1), p AS (SELECT package_id, count(*) AS n FROM viol GROUP BY 1),
c AS (SELECT package_id, count(*) FILTER (WHERE class = 'deny') AS nd, count(*) FILTER (WHERE class = 'unrecognized') AS nu FROM cls GROUP BY 1)
SELECT package_id, least(100, greatest(base, coalesce(least, 0)) + 10 * coalesce(n, 0) + 10 * coalesce(nd, 0) + 5 * coalesce(nu, 0))::int AS static_risk FROM b LEFT JOIN l USING (package_id) LEFT JOIN p USING (package_id) LEFT JOIN c USING (package_id)""",
    "plain_risk": f"WITH {_C} SELECT package_id, least(100, sum({_POINTS} + CASE WHEN list_contains(scope, '*') THEN 5 ELSE 0 END))::int AS plain_risk FROM caps GROUP BY 1",
    "unresolved_scopes": f"WITH {_C} SELECT package_id, count(*) AS n_capabilities, count(*) FILTER (WHERE NOT scope_resolved) AS n_unresolved, count(*) FILTER (WHERE NOT scope_resolved) / count(*) AS ratio FROM caps GROUP BY 1",
    "quality_score": f"""WITH {_C}, r AS (SELECT package_id, least(100, sum({_POINTS} + CASE WHEN list_contains(scope, '*') THEN 5 ELSE 0 END))::int AS risk, count(*) FILTER (WHERE NOT scope_resolved) / count(*) AS ratio FROM caps GROUP BY 1),
b AS (SELECT package_id, count(*) FILTER (WHERE severity = 'prohibited') AS p FROM fnd GROUP BY 1)
SELECT package_id, greatest(0, 100 - trunc(ratio * 40)::int - least(30, risk // 3) - least(20, 10 * coalesce(p, 0)))::int AS score FROM r LEFT JOIN b USING (package_id)""",
    "unexpected_categories": f"""WITH {_C}, {_values([(k, c) for k, v in R.UNEXPECTED.items() for c in v], "u", "skill_category, category")}
SELECT DISTINCT p.package_id, u.category FROM packages p JOIN u USING (skill_category) JOIN caps c ON c.package_id = p.package_id AND c.category = u.category""",
    "claimed_and_used": f"""WITH {_C}, a AS (SELECT * FROM (SELECT DISTINCT package_id, unnest(regexp_extract_all(text, '([a-z]+:[a-z]+)', 1)) AS cap FROM documents WHERE package_id IS NOT NULL) WHERE string_split(cap, ':')[1] IN {_list(R.CATEGORIES)} AND string_split(cap, ':')[2] IN {_list(R.ACTIONS)}), b AS (SELECT DISTINCT package_id, category || ':' || act AS cap FROM caps)
SELECT coalesce(a.package_id, b.package_id) AS package_id, coalesce(a.cap, b.cap) AS cap, CASE WHEN a.cap IS NULL THEN 'right' WHEN b.cap IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.package_id = b.package_id AND a.cap = b.cap""",
    "document_mentions": " UNION ".join(f"SELECT DISTINCT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_text(p)}, 1)) AS \"value\" FROM documents" for k, p in Q.MENTIONS.items()),
    "documentation_scores": f"""WITH {_C}, a AS (SELECT * FROM (SELECT DISTINCT package_id, unnest(regexp_extract_all(text, '([a-z]+:[a-z]+)', 1)) AS cap FROM documents WHERE package_id IS NOT NULL) WHERE string_split(cap, ':')[1] IN {_list(R.CATEGORIES)} AND string_split(cap, ':')[2] IN {_list(R.ACTIONS)}), b AS (SELECT DISTINCT package_id, category || ':' || act AS cap FROM caps),
v AS (SELECT package_id, sum(CASE WHEN string_split(cap, ':')[1] IN ('subprocess', 'secret') THEN 20 ELSE 10 END) AS cost FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.package_id = b.package_id AND a.cap = b.cap) GROUP BY 1),
s AS (SELECT package_id, greatest(0, 100 - cost)::int AS score FROM v) SELECT package_id, score, CASE WHEN score < 30 THEN 20 WHEN score < 50 THEN 12 WHEN score < 70 THEN 5 ELSE 0 END AS adjustment FROM s""",
    "ghost_files": f"""WITH {_F}, have AS (SELECT package_id, {_CLEAN.format('path')} AS p FROM source_files), nm AS (SELECT DISTINCT package_id, {_CLEAN.format('file')} AS p FROM fnd WHERE package_id IS NOT NULL AND file IS NOT NULL)
SELECT package_id, p AS path FROM nm WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.package_id = nm.package_id AND (h.p = nm.p OR string_split(h.p, '/')[-1] = string_split(nm.p, '/')[-1]))""",
    "ghost_references": f"""WITH nm AS (SELECT DISTINCT package_id, ltrim(p, './') AS p FROM (SELECT package_id, unnest(regexp_extract_all(text, {_text(Q.MENTIONS["path"])}, 1)) AS p FROM documents WHERE package_id IS NOT NULL) WHERE ltrim(p, './') <> ''),
have AS (SELECT package_id, ltrim({_CLEAN.format('path')}, './') AS p FROM source_files)
SELECT package_id, p AS path FROM nm WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.package_id = nm.package_id AND (h.p = nm.p OR string_split(h.p, '/')[-1] = string_split(nm.p, '/')[-1]))""",
    "keyword_classes": _keyword_sql(),
    "top_findings": f"""WITH {_F} SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY CASE WHEN severity = 'prohibited' THEN 0 ELSE 1 END, file NULLS FIRST, line NULLS FIRST, col NULLS FIRST, pattern NULLS FIRST, finding_id)::int AS rank, finding_id, severity, file, line FROM fnd WHERE package_id IS NOT NULL QUALIFY rank <= 12""",
    "top_files": f"""WITH {_F}, n AS (SELECT package_id, file, count(*) AS n FROM fnd WHERE package_id IS NOT NULL GROUP BY 1, 2) SELECT package_id, file, n, row_number() OVER (PARTITION BY package_id ORDER BY n DESC, file NULLS FIRST)::int AS rank FROM n QUALIFY rank <= 5""",
    "advice": f"""WITH {_F} SELECT pattern, coalesce({_case(Q.ADVICE, "contains(lower(pattern), {t}) OR contains(lower(message), {t})")}, {_case(Q.FALLBACK, "capability.category = {t}")}) AS advice, count(*) AS n FROM fnd GROUP BY 1, 2""",
    "weaknesses": f"""WITH {_F}, {_values(Q.WEAKNESS, "w", "p, cwe")}, {_values(Q.WEAKNESS_DEFAULT, "w3", "category, act, cwe")}
SELECT pattern, coalesce(a.cwe, b.cwe, c.cwe) AS cwe, count(*) AS n FROM fnd LEFT JOIN w a ON a.p = pattern LEFT JOIN w b ON b.p = string_split(pattern, ':')[1] LEFT JOIN w3 c ON c.category = capability.category AND c.act = capability."action" GROUP BY 1, 2""",
    "gates": f"""WITH {_C}, {_BINS}, {_COMBO} SELECT package_id, bool_or(severity = 'prohibited') AS hard_fail, package_id NOT IN (SELECT package_id FROM fired WHERE severity = 'critical') AS lock_allowed FROM fnd WHERE package_id IS NOT NULL GROUP BY 1""",
    "badges": """WITH l AS (SELECT package_id, risk_static AS risk FROM lock_snapshots QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY snapshot_no DESC, locked_at DESC, risk_static DESC) = 1),
t AS (SELECT *, CASE WHEN risk <= 25 THEN 'green' WHEN risk <= 50 THEN 'yellow' WHEN risk <= 75 THEN 'orange' ELSE 'red' END AS tier FROM l)
SELECT package_id, risk, tier, 'badge/' || replace(package_id, '-', '--') || '-' || risk || '-' || tier AS link FROM t""",
    "first_paths": "SELECT package_id, min_by(path, string_split(path, '/')) AS first_path, max_by(path, string_split(path, '/')) AS last_path FROM source_files GROUP BY 1",
    "merkle_roots": f"WITH RECURSIVE {_TREE} SELECT package_id, count(*) FILTER (WHERE l = 0) AS n_leaves, max_by(h, l) AS root FROM lv GROUP BY 1",
    "merkle_proofs": f"""WITH RECURSIVE {_TREE}, x AS (SELECT DISTINCT * FROM lv) SELECT a.package_id, a.i AS leaf, n.l AS level, coalesce(s.h, n.h) AS sibling, CASE WHEN n.i % 2 = 0 THEN 'right' ELSE 'left' END AS side
FROM x a JOIN x n ON n.package_id = a.package_id AND n.i = (a.i >> n.l) AND n.n > 1 LEFT JOIN x s ON s.package_id = n.package_id AND s.l = n.l AND s.i = xor(n.i, 1) WHERE a.l = 0""",
    "merkle_verified": "SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY path) - 1 AS leaf, true AS valid FROM source_files WHERE text IS NOT NULL",
    "lock_verified": f"""WITH {_LOCKED}, st AS (SELECT package_id, CASE WHEN starts_with(p, '/') OR regexp_matches('/' || p || '/', '/\\.\\./') THEN 'escapes' WHEN now IS NULL THEN 'missing' WHEN now = h THEN 'ok' ELSE 'mismatch' END AS status FROM locked LEFT JOIN cur USING (package_id, p))
SELECT package_id, status, count(*) AS n, min(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY package_id) = 1 AS root_ok FROM st GROUP BY 1, 2""",
    "locks": f"""WITH RECURSIVE {_TREE} SELECT package_id, '{{"n_files":' || count(*) FILTER (WHERE l = 0) || ',"package_id":"' || package_id || '","root":"' || max_by(h, l) || '"}}' AS lock FROM lv GROUP BY package_id""",
    "file_verified": f"""WITH {_LOCKED}, c AS (SELECT package_id, path, list_position(['settings.json', 'settings.yaml', 'config.toml', 'index.py', 'main.py', 'main.sh'], string_split(path, '/')[-1]) AS r FROM source_files),
m AS (SELECT package_id, {_CLEAN.format('path')} AS p FROM c WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY r, path) = 1)
SELECT package_id, p AS path, h IS NOT NULL AS locked, now = h AS same, now = h AS proven FROM m LEFT JOIN locked USING (package_id, p) LEFT JOIN cur USING (package_id, p)""",
    "package_reports": f"""WITH {_F}, n AS (SELECT package_id, file, count(*) AS n FROM fnd WHERE package_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY n DESC, file NULLS FIRST) <= 5),
t AS (SELECT package_id, string_agg('{{"file":"' || file || '","findings":' || n || '}}', ',' ORDER BY n DESC, file) AS top FROM n WHERE file IS NOT NULL GROUP BY 1)
SELECT package_id, '{{"counts":{{"files":' || count(DISTINCT file) || ',"findings":' || count(*) || ',"prohibited":' || count(*) FILTER (WHERE severity = 'prohibited') || ',"restricted":' || count(*) FILTER (WHERE severity = 'restricted') || '}},"package_id":"' || package_id || '","top_files":[' || coalesce(any_value(top), '') || ']}}' AS report
FROM fnd LEFT JOIN t USING (package_id) WHERE package_id IS NOT NULL GROUP BY package_id""",
    "sessions": """WITH e AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::bigint AS session_no FROM e)
SELECT user_id, session_no, min(ts) AS started, count(*) AS n_events, array_to_string(list_sort(list(DISTINCT event_type)), '|') AS kinds FROM s GROUP BY 1, 2""",
    "severity_cube": f"""WITH {_F}, f AS (SELECT coalesce(severity, 'none') AS severity, coalesce(confidence, 'none') AS confidence FROM fnd) SELECT severity, confidence, count(*) AS n FROM f GROUP BY CUBE (severity, confidence)""",
    "escaping_scopes": f"""WITH {_C}, v AS (SELECT DISTINCT package_id, unnest(scope) AS v FROM caps WHERE category = 'fs') SELECT package_id, v AS "value", starts_with(v, '/') OR regexp_matches('/' || v || '/', '^/(\\.?/)*\\.\\./') AS escapes FROM v""",
}
