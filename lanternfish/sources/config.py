"""Settings files as flat entries: key path, key, value and its type.

JSON, YAML (where its parser is installed) and TOML, by suffix without regard to case. Scalars directly in a list are no
entries; objects in lists are. Line ends at the end of a value (of a block text, say) are dropped. Files that don't parse, null and empty texts give
none; equal files give equal entries.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTRY = "file_id bigint, key_path string, key string, value string, value_type string"


def flatten(tree: object) -> list[tuple[str, str, str | None, str]]:
    """(key_path, key, value, value_type) of every scalar under a key."""
    out: list[tuple[str, str, str | None, str]] = []
    todo: list[tuple[str, object]] = [("", tree)]
    while todo:
        at, v = todo.pop()
        items = v.items() if isinstance(v, dict) else enumerate(v)
        for k, x in items:
            path = f"{at}[{k}]" if isinstance(v, list) else f"{at}.{k}" if at else str(k)
            if isinstance(x, (dict, list)):
                todo.append((path, x))
            elif isinstance(v, dict):
                kind = "null" if x is None else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "str"
                out.append((path, str(k), None if x is None else str(x).lower() if kind == "bool" else str(x).rstrip("\r\n"), kind))
    return out


def _yaml(text: str) -> object:
    """A YAML tree in which only true and false are booleans and dates stay text."""
    import yaml

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        pass

    kept = {"tag:yaml.org,2002:int", "tag:yaml.org,2002:null", "tag:yaml.org,2002:float", "tag:yaml.org,2002:merge"}
    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t in kept] for k, v in Loader.yaml_implicit_resolvers.items()}
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    return yaml.load(text, Loader=Loader)


def parsed(suffix: str, text: str) -> object:
    """The tree of a settings text; null if it doesn't parse or holds no object or list."""
    try:
        tree = json.loads(text) if suffix == "json" else tomllib.loads(text) if suffix == "toml" else _yaml(text)
    except Exception:  # whatever the parsers raise, the file has no entries
        return None
    return tree if isinstance(tree, (dict, list)) else None


def config_entries(files: DataFrame) -> DataFrame:
    """Entries of ``file_id, path, text``."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    rows = files.select(F.col("file_id").cast("bigint").alias("file_id"), suffix.alias("suffix"), "text").where("suffix IN ('json', 'yaml', 'yml', 'toml') AND text IS NOT NULL AND file_id IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *e) for i, s, t in zip(*(b.column(k).to_pylist() for k in range(3))) if (tree := parsed(s, t)) is not None for e in flatten(tree)]
            columns = list(zip(*out)) if out else [[] for _ in range(5)]
            types = [pa.int64(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["file_id", "key_path", "key", "value", "value_type"])

    return rows.mapInArrow(run, ENTRY)
