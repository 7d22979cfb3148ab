"""Nested records as an adjacency table of nodes, and flat entity tables joined out of it.

A node is an object, an array or a scalar: ``record, node, parent, holder, label, ordinal, kind, scalar``. node
numbers follow the order of the text; parent is the enclosing node; holder is the nearest enclosing array
element; label is the path of keys with ``[]`` for elements; ordinal is an element's position, else -1.

A Shape names the paths where arrays and objects belong: there a single value becomes the only element and a
string holding JSON stands for what it holds. Null elements give no node but keep their position.
Records that are null or not valid JSON give no nodes; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.jsontext import canonical, strict_loads

NODE = "record bigint, node int, parent int, holder int, label string, ordinal int, kind string, scalar string"
_ARROW = pa.schema([("record", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("holder", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string())])


@dataclass(frozen=True)
class Shape:
    """Paths where arrays and objects belong; elements of an array are written ``array[]``."""

    arrays: frozenset[str]
    objects: frozenset[str]


def _held(value: object) -> object:
    """What a string of JSON holds, if that is an array or object."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        ok, v = strict_loads(value)
        if ok and isinstance(v, (list, dict)):
            return v
    return value


def _nodes(value: object, shape: Shape, wanted: frozenset[str] | None) -> Iterator[tuple]:
    """(node, parent, holder, label, ordinal, kind, scalar) in the order of the text."""
    n = 0
    todo = [(_held(value), -1, -1, "", -1)]
    while todo:
        v, parent, holder, label, ordinal = todo.pop()
        if label in shape.arrays or label in shape.objects:
            v = _held(v)
        if label in shape.arrays and v is not None and not isinstance(v, list):
            v = [v]
        if v is None:
            continue
        me, n = n, n + 1
        inside = me if ordinal >= 0 else holder
        shown = wanted is None or label in wanted
        if isinstance(v, dict):
            if shown:
                yield me, parent, holder, label, ordinal, "object", None
            todo.extend((x, me, inside, f"{label}.{k}" if label else k, -1) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            if shown:
                yield me, parent, holder, label, ordinal, "array", None
            todo.extend((v[i], me, inside, f"{label}[]", i) for i in range(len(v) - 1, -1, -1))
        elif shown:
            yield me, parent, holder, label, ordinal, "scalar", v if isinstance(v, str) else canonical(v)


def shred(records: DataFrame, record: str, body: str, shape: Shape, labels: list[str] | None = None) -> DataFrame:
    """The adjacency table of ``body``; ``labels`` limits it to the nodes a query reads, as column pruning does."""
    wanted = None if labels is None else frozenset(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in _ARROW]
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ok, v = strict_loads(text)
                if not ok:
                    continue
                for row in _nodes(v, shape, wanted):
                    columns[0].append(key)
                    for c, x in zip(columns[1:], row):
                        c.append(x)
                if len(columns[0]) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
                    columns = [[] for _ in _ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

    return records.where(F.col(record).isNotNull()).select(F.col(record).cast("bigint").alias("record"), F.col(body).alias("body")).mapInArrow(run, NODE)


def entity_table(nodes: DataFrame, label: str, fields: dict[str, str], parents: str | None = None) -> DataFrame:
    """Rows of the elements of one array: ``record, node, holder, parent_ord, ord, value`` and a column per field.

    fields: column to path below the element; objects in between (``capability.category``) are followed through
    the nodes' holder. value is a scalar element's own text. parents is the label of the elements that hold the
    array; without it parent_ord is -1. A field an element lacks is null.
    """
    own = nodes.where(F.col("label") == f"{label}[]").select("record", "node", "holder", F.col("ordinal").alias("ord"), F.col("scalar").alias("value"))
    if fields:
        names = {f"{label}[].{p}": c for c, p in fields.items()}
        leaves = nodes.where(F.col("label").isin(*names) & (F.col("kind") == "scalar"))
        wide = leaves.groupBy("record", "holder").agg(*[F.max(F.when(F.col("label") == k, F.col("scalar"))).alias(c) for k, c in names.items()])
        own = own.join(wide.withColumnRenamed("holder", "node"), ["record", "node"], "left")
    if parents is None:
        return own.withColumn("parent_ord", F.lit(-1))
    up = nodes.where(F.col("label") == f"{parents}[]").select("record", F.col("node").alias("holder"), F.col("ordinal").alias("parent_ord"))
    return own.join(up, ["record", "holder"])


@dataclass(frozen=True)
class Child:
    """One kind of element in a listing: array label, path of its item below the element ('' for the element
    itself), label of the elements that hold the array ('' for none)."""

    label: str
    item: str = ""
    parents: str = ""


def element_listing(nodes: DataFrame, children: dict[str, Child]) -> DataFrame:
    """``record, child, parent_ord, ord, item`` of all elements of several arrays.

    Object elements are joined with their scalar child, nested elements with the element that holds them; an
    object element without that child has a null item. All kinds share the joins.
    """
    def pick(of: dict[str, str]) -> Column:
        out = None
        for name, at in of.items():
            hit = F.col("label") == at
            out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
        return out

    kind = pick({k: f"{c.label}[]" for k, c in children.items()})
    elements = nodes.withColumn("child", kind).where("child IS NOT NULL")
    nested = [k for k, c in children.items() if c.parents]
    objects = [k for k, c in children.items() if c.item]
    scalar_of = nodes.where(F.col("label").isin(*[f"{children[k].label}[].{children[k].item}" for k in objects]) & (F.col("kind") == "scalar"))
    scalar_of = scalar_of.select("record", F.col("parent").alias("node"), F.col("scalar").alias("inner"))
    flat = elements.where(F.col("child").isin(*nested)).select("record", "child", "holder", "ordinal", F.col("scalar").alias("item"))
    up = elements.where(F.col("child").isin(*{k for k, c in children.items() if any(x.parents == c.label for x in children.values())}))
    up = up.select("record", F.col("node").alias("holder"), F.col("ordinal").alias("parent_ord"))
    low = flat.join(up, ["record", "holder"]).select("record", "child", "parent_ord", F.col("ordinal").alias("ord"), "item")
    top = elements.where(~F.col("child").isin(*nested)).join(scalar_of, ["record", "node"], "left")
    top = top.select("record", "child", F.lit(-1).alias("parent_ord"), F.col("ordinal").alias("ord"), F.coalesce("scalar", "inner").alias("item"))
    return top.unionByName(low)
