"""Source files that aren't valid in the language of their suffix.

Files are lexed into rows; pairs of adjacent tokens (and of statements of a block, and of the parts of a line) that the
language's grammar doesn't permit are found by an anti-join, brackets, quotes, indentation, conditional expressions and
compound commands by windowed reductions over their events, names given twice by a grouping.

A null text or a suffix of no known language gives no row; an empty file is valid except for JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.llm import grammar
from lanternfish.llm.lexers import LEXERS

LANGUAGES = {"py": "py", "js": "js", "sh": "sh", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml"}


def _js_pairs() -> set[tuple[str, str]]:
    """The grammar's pairs, and those across a line end (first class followed by ~) or before } and the end,
    where a missing ; is supplied."""
    base = grammar.permitted(grammar.JS, "script")
    ends = {a for a, b in base if b == ";"}
    starts = {b for a, b in base if a == ";"}
    out = set(base) | {(a, "$") for a in ends} | {(a, b) for a in ends for b in ("}", "}T", "}K", "}D", "}C", "}S")}
    no_break = {"return", "throw", "break", "continue"}
    out |= {(a + "~", b) for a, b in base if a not in no_break}
    out |= {(a + "~", b) for a in ends | no_break - {"throw"} for b in starts}
    out |= {(a + "~", b) for a in ends for b in ("}", "}T", "}K", "}D", "}C", "}S", "$")}
    return out | {(a + "~", "$") for a, b in out if b == "$"}


def _shell_pairs() -> set[tuple[str, str]]:
    return grammar.permitted(grammar.SHELL, "script")


def _python_pairs() -> set[tuple[str, str]]:
    block = grammar.permitted(grammar.PYTHON_BLOCK, "block") | {("^", "$"), ("^M", "CASE"), ("CASE", "CASE"), ("CASE", "$")}
    lines = {(a, b) for a, b in grammar.permitted(grammar.PYTHON_LINE, "line") if a != "^" and b != "$"}
    return grammar.permitted(grammar.PYTHON, "file") | {("H:" + a, "H:" + b) for a, b in block} | lines


def permitted_pairs() -> dict[str, set[tuple[str, str]]]:
    """Permitted pairs of every language; their number depends on the grammars only."""
    return {
        "py": _python_pairs(),
        "js": _js_pairs(),
        "sh": _shell_pairs(),
        "json": grammar.permitted(grammar.JSON, "json"),
        "yaml": grammar.yaml_pairs(),
        "toml": grammar.permitted(grammar.TOML, "doc"),
    }


def language_of(path):
    """The language of a path's suffix as a column expression; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = None
    for k, v in LANGUAGES.items():
        out = F.when(suffix == k, v) if out is None else out.when(suffix == k, v)
    return out


_LEXED = "file_id bigint, lang string, pairs array<string>, nest array<int>, keys array<string>"


def _lex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spelled: dict[tuple[str, str], int] = {}  # a pair's text is made once
    for b in batches:
        pairs, nests, keys = [], [], []
        ends = [[0], [0], [0]]
        for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            p, n, k = LEXERS[lang](text)
            pairs += [spelled.setdefault(x, len(spelled)) for x in p]
            nests += n
            keys += k
            for at, have in zip(ends, (pairs, nests, keys)):
                at.append(len(have))
        texts = pa.DictionaryArray.from_arrays(pa.array(pairs, pa.int32()), pa.array([f"{x}\t{y}" for x, y in spelled], pa.string())).cast(pa.string())
        events, at = _without_leaves(np.array(nests, dtype=np.int32), np.array(ends[1]))
        lists = [(texts, ends[0]), (pa.array(events), at), (pa.array(keys, pa.string()), ends[2])]
        arrays = [b.column(0), b.column(1), *(pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for v, e in lists)]
        yield pa.RecordBatch.from_arrays(arrays, names=["file_id", "lang", "pairs", "nest", "keys"])


def _without_leaves(events: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The events of several texts without openings that are closed by the very next event, which say nothing more."""
    if len(events) < 2:
        return events, ends
    pair = (events[:-1] > 0) & (events[1:] == -events[:-1])
    inner = ends[(ends > 0) & (ends < len(events))]
    pair[inner - 1] = False  # the next event is another text's
    leaf = np.zeros(len(events), dtype=bool)
    leaf[:-1] |= pair
    leaf[1:] |= pair
    kept = np.concatenate([[0], np.cumsum(~leaf)])
    return events[~leaf], kept[ends]


def lexed(files: DataFrame) -> DataFrame:
    """``file_id, lang, pairs, nest, keys`` of each file of ``file_id, path, text`` in a known language."""
    known = files.select(F.col("file_id").cast("bigint").alias("file_id"), language_of(F.col("path")).alias("lang"), "text")
    return known.where("file_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").mapInArrow(_lex, _LEXED)


def wrong_pairs(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``file_id, lang, pair``: adjacent tokens that no text of the language has side by side."""
    table = [(lang, f"{a}\t{b}") for lang, pairs in permitted_pairs().items() for a, b in pairs]
    good = F.broadcast(spark.createDataFrame(table, "lang string, pair string"))
    return rows.select("file_id", "lang", F.explode("pairs").alias("pair")).join(good, ["lang", "pair"], "left_anti")


def wrong_nesting(rows: DataFrame) -> DataFrame:
    """``file_id, lang`` where an opening event has no closing one of its kind at its depth, or the reverse.

    The running sum of events gives each its depth; among the events of one depth every opening one must be
    followed at once by a closing one of the same kind.
    """
    events = rows.select("file_id", "lang", F.posexplode("nest").alias("at", "e"))
    up = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("e") > 0, 1).otherwise(-1)
    leveled = events.withColumn("sum", F.sum(sign).over(up)).withColumn("level", F.when(F.col("e") > 0, F.col("sum")).otherwise(F.col("sum") + 1))
    side = Window.partitionBy("file_id", "level").orderBy("at")
    seen = leveled.withColumn("next", F.lead("e").over(side)).withColumn("last", F.lag("e").over(side))
    open_ok = (F.col("e") > 0) & F.col("next").isNotNull() & (F.col("next") == -F.col("e"))
    close_ok = (F.col("e") < 0) & F.col("last").isNotNull() & (F.col("last") == -F.col("e"))
    return seen.where(~(open_ok | close_ok)).select("file_id", "lang")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """``file_id, lang`` of files that give a name twice which may be given once."""
    keys = rows.where("size(keys) > 0").select("file_id", "lang", F.explode("keys").alias("key"))
    return keys.groupBy("file_id", "lang", "key").count().where("count > 1").select("file_id", "lang")


def invalid_files(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``file_id, lang`` of the lexed files that don't parse."""
    return wrong_pairs(spark, rows).select("file_id", "lang").unionByName(wrong_nesting(rows)).unionByName(repeated_keys(rows)).distinct()


def invalid_rates(files: DataFrame, packages: DataFrame, invalid: DataFrame) -> DataFrame:
    """``repository, lang, n_files, n_invalid, rate`` over all files with a known language."""
    known = files.select("file_id", "package_id", language_of(F.col("path")).alias("lang")).where("lang IS NOT NULL")
    joined = known.join(packages.select("package_id", "repository").dropDuplicates(["package_id"]), "package_id", "left")
    marked = joined.join(invalid.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
    out = marked.groupBy("repository", "lang").agg(F.count(F.lit(1)).alias("n_files"), F.count("bad").alias("n_invalid"))
    return out.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
