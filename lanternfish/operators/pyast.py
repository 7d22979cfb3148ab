"""Python sources as rows of their syntax tree: calls, imports, functions with complexity, and flows of input to sinks.

Only the parser runs per file; everything that looks names up is a join afterwards. Files that don't parse, null and
empty texts give no rows. Equal calls on one place are kept apart by their column. Very deep sources that exhaust the
parser count as not parsing.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.rules import frame

ROW = "file_id bigint, kind string, line int, col int, name string, arg string, arg_resolved boolean, tainted boolean, target string, number int"
_FIELDS = [("file_id", pa.int64()), ("kind", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("name", pa.string()), ("arg", pa.string()), ("arg_resolved", pa.bool_()), ("tainted", pa.bool_()), ("target", pa.string()), ("number", pa.int32())]
#: Calls and names whose values come from outside.
INPUTS = frozenset(["input", "os.getenv", "os.environ.get", "sys.stdin.read", "sys.stdin.readline", "getpass.getpass"])
INPUT_NAMES = frozenset(["sys.argv", "os.environ", "request.args", "request.form", "request.json"])
#: Calls that take such values to a command, a network place, a file or a database.
SINKS = {
    "subprocess.run": "command", "subprocess.call": "command", "subprocess.Popen": "command", "subprocess.check_output": "command", "os.system": "command",
    "requests.get": "url", "requests.post": "url", "urllib.request.urlopen": "url", "session.get": "url",
    "open": "path", "os.remove": "path", "shutil.rmtree": "path", "pathlib.Path": "path",
}
#: (call, category, action)
CALLS = [
    ("open", "fs", "read"), ("os.remove", "fs", "delete"), ("os.environ.get", "env", "read"), ("os.getenv", "env", "read"), ("getpass.getpass", "secret", "access"),
    ("subprocess.run", "subprocess", "exec"), ("subprocess.Popen", "subprocess", "exec"), ("subprocess.call", "subprocess", "exec"), ("os.system", "subprocess", "exec"),
    ("requests.get", "network", "connect"), ("requests.post", "network", "connect"), ("session.get", "network", "connect"),
    ("hashlib.sha256", "crypto", "hash"), ("base64.b64decode", "serial", "deserialize"), ("pickle.loads", "serial", "deserialize"), ("json.loads", "serial", "deserialize"), ("re.compile", "system", "pattern"),
]
DENIED_CALLS = ["eval", "exec", "compile", "execfile"]
IMPORTS = [("subprocess", "subprocess"), ("requests", "network"), ("socket", "network"), ("pickle", "serial"), ("ctypes", "system"), ("hashlib", "crypto"), ("getpass", "secret"), ("os", "system"), ("base64", "serial")]


def _dotted(node: ast.AST, alias: dict[str, str]) -> str | None:
    """a.b.c of a name or attribute, the first part seen through import aliases."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([alias.get(node.id, node.id), *reversed(parts)])


def _literal(node: ast.AST) -> str | None:
    """Text of a string constant or of constants put together by +."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = _literal(node.left), _literal(node.right)
        return None if a is None or b is None else a + b
    return None


def _complexity(fn: ast.AST) -> int:
    n = 1
    for x in ast.walk(fn):
        if isinstance(x, (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With, ast.Assert, ast.IfExp)):
            n += 1
        elif isinstance(x, ast.BoolOp):
            n += len(x.values) - 1
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
    return n


def tree_rows(text: str) -> list[tuple]:
    """(kind, line, col, name, arg, arg_resolved, tainted, target, number) of a source text, in order of visit."""
    try:
        tree = ast.parse(text)
        nodes = list(ast.walk(tree))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    alias: dict[str, str] = {}
    out: list[tuple] = []
    for n in nodes:
        if isinstance(n, ast.Import):
            for a in n.names:
                alias[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
                out.append(("import", n.lineno, n.col_offset, a.name, None, None, None, None, None))
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                alias[a.asname or a.name] = f"{n.module or ''}.{a.name}"
            out.append(("import", n.lineno, n.col_offset, n.module or "", None, None, None, None, None))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", n.lineno, n.col_offset, n.name, None, None, None, None, _complexity(n)))
    tainted: set[str] = set()

    def dirty(e: ast.AST) -> bool:
        for x in ast.walk(e):
            if isinstance(x, ast.Name) and x.id in tainted:
                return True
            if isinstance(x, (ast.Attribute, ast.Name)) and _dotted(x, alias) in INPUT_NAMES:
                return True
            if isinstance(x, ast.Call) and _dotted(x.func, alias) in INPUTS:
                return True
        return False

    order = sorted((n for n in nodes if isinstance(n, (ast.Assign, ast.AnnAssign, ast.NamedExpr, ast.Call))), key=lambda n: (n.lineno, n.col_offset))
    for n in order:
        if not isinstance(n, ast.Call):
            if n.value is not None and dirty(n.value):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    tainted |= {x.id for x in ast.walk(t) if isinstance(x, ast.Name)}
            continue
        name = _dotted(n.func, alias)
        if name is None:
            continue
        first = n.args[0] if n.args else next((k.value for k in n.keywords if k.arg in ("url", "path", "file", "filename", "cmd")), None)
        words = None
        if isinstance(first, (ast.List, ast.Tuple)):
            words = [_literal(x) or "*" for x in first.elts]
        text_of = _literal(first) if first is not None else None
        arg = " ".join(words) if words is not None else text_of if text_of is not None else "*" if first is not None else None
        fixed = "*" not in (words or [arg or ""]) if first is not None else None
        out.append(("call", n.lineno, n.col_offset, name, arg, fixed, any(dirty(a) for a in [*n.args, *(k.value for k in n.keywords)]), None, None))
    return out


def syntax_rows(files: DataFrame) -> DataFrame:
    """Rows of ``file_id, text`` of Python files (see ROW)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.simplefilter("ignore")
        for b in batches:
            rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in tree_rows(t)]
            columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])

    return files.where("file_id IS NOT NULL AND text IS NOT NULL").select(F.col("file_id").cast("bigint").alias("file_id"), "text").mapInArrow(run, ROW)


def call_capabilities(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Calls of the call table with their capability and scope; an unresolved first argument is ``*``."""
    known = F.broadcast(frame(spark, CALLS, "name string, category string, action string"))
    calls = rows.where("kind = 'call'").join(known, "name")
    words = F.when(F.col("category") == "subprocess", F.split(F.trim("arg"), r"\s+")).otherwise(F.array("arg"))
    scope = F.when(F.col("arg").isNull(), F.array(F.lit("*"))).otherwise(words)
    return calls.select("file_id", "line", "col", "name", "category", "action", scope.alias("scope"), F.coalesce("arg_resolved", F.lit(False)).alias("scope_resolved"))


def import_capabilities(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Imports of listed root modules with their category."""
    known = F.broadcast(frame(spark, IMPORTS, "root string, category string"))
    return rows.where("kind = 'import'").withColumn("root", F.split("name", r"\.")[0]).join(known, "root").select("file_id", "line", "name", "category")


def tainted_sinks(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Calls of a sink that get input from outside."""
    sinks = F.broadcast(frame(spark, list(SINKS.items()), "name string, sink string"))
    return rows.where("kind = 'call' AND tainted").join(sinks, "name").select("file_id", "line", "col", "name", "sink")
