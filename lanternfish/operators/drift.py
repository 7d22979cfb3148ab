"""Schemas that drift between files: fields per file, their changes, and one consistent typed table.

Every record is loaded as a list of (path, raw type, value). Counts of path and type per file give the file's
fields; comparing consecutive files gives the changes; following renames back gives every value its first name,
under which typed columns are projected, with the casts that failed.

Empty and very long texts, nulls and invalid JSON: a record without valid JSON counts as a row of its file and
carries nothing. A null package takes no part in finding renames. An empty table gives no changes and no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternfish.functions.jsontext import canonical, kind, strict_loads
from lanternfish.sources.storage import cut

FILE = ["producer_id", "artifact", "file_seq"]
#: The list of fields that vanish or appear is broadcast up to this many rows; beyond it the join is a shuffle.
BROADCAST_ROWS = 200_000
#: Objects under these keys are single values.
WHOLE = frozenset({"capabilities"})
_FIELDS = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("path", "type", "value")]))


def _fields(value: object) -> list[tuple[str, str, str]]:
    """(path, type, value) of every value that isn't an object; scalars of type string keep their own text."""
    out: list[tuple[str, str, str]] = []
    todo = [("", value)] if isinstance(value, dict) else []
    while todo:
        at, v = todo.pop()
        for k, x in v.items():
            path = f"{at}.{k}" if at else k
            if isinstance(x, dict) and k not in WHOLE:
                todo.append((path, x))
            elif x is not None:
                out.append((path, kind(x), x if isinstance(x, str) else canonical(x)))
    return out


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        valid, sizes, paths, types, values = [], [0], [], [], []
        for body in b.column("body").to_pylist():
            ok, v = strict_loads(body)
            valid.append(ok)
            for p, t, x in _fields(v):
                paths.append(p)
                types.append(t)
                values.append(x)
            sizes.append(len(paths))
        entries = pa.StructArray.from_arrays([pa.array(paths, pa.string()), pa.array(types, pa.string()), pa.array(values, pa.string())], ["path", "type", "value"])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), entries)
        kept = [n for n in b.schema.names if n != "body"]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(valid, pa.bool_()), lists], names=[*kept, "valid", "fields"])


def load_fields(records: DataFrame) -> DataFrame:
    """The records with ``valid`` and ``fields`` in place of ``body``; further columns are dropped."""
    kept = records.select("record_id", *FILE, "package_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), "body")
    head = [f for f in kept.schema.fields if f.name != "body"]
    schema = T.StructType([*head, T.StructField("valid", T.BooleanType()), T.StructField("fields", _FIELDS)])
    return kept.mapInArrow(_load, schema)


def file_fields(loaded: DataFrame) -> DataFrame:
    """``FILE, path, type`` of the fields that more than half of a file's rows carry.

    The type is the most frequent one; of equally frequent ones the first by name. Arrays whose first element
    is missing or null have no element type ("array of") and lose against any other type.
    """
    rows = loaded.groupBy(*FILE).agg(F.count(F.lit(1)).alias("n_rows"))
    counts = loaded.select(*FILE, F.explode("fields").alias("f")).groupBy(*FILE, "f.path", "f.type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((F.col("type") == "array of").cast("int"), -F.col("n"), F.col("type"))
    best = counts.groupBy(*FILE, "path").agg(F.sum("n").alias("carried"), F.min_by("type", rank).alias("type"))
    return best.join(rows, FILE).where(F.col("carried") * 2 > F.col("n_rows")).select(*FILE, "path", "type")


def file_pairs(loaded: DataFrame) -> DataFrame:
    """``producer_id, artifact, file_seq, prev_seq`` of each file that has one before it."""
    w = Window.partitionBy("producer_id", "artifact").orderBy("file_seq")
    return loaded.select(*FILE).distinct().withColumn("prev_seq", F.lag("file_seq").over(w)).where("prev_seq IS NOT NULL")


def _renames(gone: DataFrame, come: DataFrame, loaded: DataFrame, pairs: DataFrame) -> DataFrame:
    """``FILE, old, new``: a vanished and an appearing field of one type with equal values in at least half of
    the packages that carry both; the highest share first, then by path, each field once."""
    key = ["producer_id", "artifact", "file_seq"]
    old = gone.join(pairs, key).select("producer_id", "artifact", F.col("prev_seq").alias("file_seq"), F.col("file_seq").alias("pair"), F.lit(0).alias("later"), "path", "type")
    new = come.select(*key, F.col("file_seq").alias("pair"), F.lit(1).alias("later"), "path", "type")
    watched = cut(old.unionByName(new), "watched")
    # Fields that neither vanish nor appear go no further than this join, which is a lookup while the list is short.
    small = watched.count() <= BROADCAST_ROWS
    rows = loaded.where("package_id IS NOT NULL").select(*key, "package_id", F.explode("fields").alias("f")).select(*key, "package_id", "f.path", "f.value")
    rows = rows.join(F.broadcast(watched) if small else watched, [*key, "path"])
    rows = rows.select("producer_id", "artifact", F.col("pair").alias("file_seq"), "later", "package_id", "path", "type", F.xxhash64("value").alias("v1"), F.xxhash64(F.lit(1), "value").alias("v2"))
    rows = cut(rows.distinct(), "moved")
    before = rows.where("later = 0").withColumnRenamed("path", "old").drop("later")
    after = rows.where("later = 1").withColumnRenamed("path", "new").drop("later")
    equal = before.join(after, [*key, "package_id", "type", "v1", "v2"]).select(*key, "old", "new", "package_id").distinct()
    equal = equal.groupBy(*key, "old", "new").agg(F.count(F.lit(1)).alias("n_equal"))
    # Only pairs with an equal value need their number of common packages.
    both = (
        equal.join(before.select(*key, "old", "package_id").distinct(), [*key, "old"])
        .join(after.select(*key, "new", "package_id").distinct(), [*key, "new", "package_id"])
        .groupBy(*key, "old", "new")
        .agg(F.count(F.lit(1)).alias("n_both"), F.first("n_equal").alias("n_equal"))
        .where("n_equal * 2 >= n_both")
    )
    # The list holds the candidates of one pair of files: its size depends on the number of fields, not of rows.
    order = F.array_sort(F.collect_list(F.struct((-F.col("n_equal") / F.col("n_both")).alias("rank"), "old", "new")))
    none = F.array().cast("array<struct<rank:double,old:string,new:string>>")
    taken = F.aggregate(
        order,
        none,
        lambda acc, c: F.when(F.exists(acc, lambda a: (a["old"] == c["old"]) | (a["new"] == c["new"])), acc).otherwise(F.concat(acc, F.array(c))),
    )
    return both.groupBy(*key).agg(taken.alias("t")).select(*key, F.explode("t").alias("t")).select(*key, "t.old", "t.new")


def field_changes(loaded: DataFrame) -> DataFrame:
    """``FILE, change_kind, field_path, new_path`` between each file and the one just before it."""
    fields = cut(file_fields(loaded), "fields")
    pairs = file_pairs(loaded)
    key = ["producer_id", "artifact", "file_seq"]
    new = fields.join(pairs, key, "left_semi")
    old = fields.withColumnRenamed("file_seq", "prev_seq").withColumnRenamed("type", "old_type").join(pairs, ["producer_id", "artifact", "prev_seq"]).drop("prev_seq")
    met = cut(old.join(new, [*key, "path"], "full"), "met")
    gone = met.where("type IS NULL").select(*key, "path", F.col("old_type").alias("type"))
    come = met.where("old_type IS NULL").select(*key, "path", "type")
    renamed = cut(_renames(gone, come, loaded, pairs), "renames")
    none = F.lit("").alias("new_path")
    unknown = (F.col("type") == "array of") & F.col("old_type").startswith("array") | (F.col("old_type") == "array of") & F.col("type").startswith("array")
    return (
        renamed.select(*key, F.lit("renamed").alias("change_kind"), F.col("old").alias("field_path"), F.col("new").alias("new_path"))
        .unionByName(gone.join(renamed.withColumnRenamed("old", "path"), [*key, "path"], "left_anti").select(*key, F.lit("removed").alias("change_kind"), F.col("path").alias("field_path"), none))
        .unionByName(come.join(renamed.withColumnRenamed("new", "path"), [*key, "path"], "left_anti").select(*key, F.lit("added").alias("change_kind"), F.col("path").alias("field_path"), none))
        .unionByName(met.where((F.col("type") != F.col("old_type")) & ~unknown).select(*key, F.lit("retyped").alias("change_kind"), F.col("path").alias("field_path"), none))
    )


def _origins(events):
    """Spans of files in which a path stands for another name (one producer's renames and additions; schema-sized).

    A renamed path stands for its first name. A first name that comes back as a new field after it was renamed away
    is another field: it gets its name with ~2, ~3 and so on.
    """
    import pandas as pd

    events = events.sort_values(["file_seq", "old"])
    live: dict[str, tuple[str, int]] = {}
    uses: dict[str, int] = {}
    rows = []
    for seq, part in events.groupby("file_seq", sort=True):
        moved = []
        for e in part[part["new"] != ""].itertuples():
            origin, since = live.pop(e.old, (e.old, None))
            if since is not None:
                rows.append((e.old, origin, since, seq - 1))
            else:
                uses[e.old] = 1
            moved.append((e.new, origin))
        for path in part.loc[part["new"] == "", "old"]:
            if path in uses and path not in live:
                uses[path] += 1
                moved.append((path, f"{path}~{uses[path]}"))
        for path, origin in moved:
            if path in live:
                rows.append((path, *live[path], seq - 1))
            live[path] = (origin, seq)
    rows += [(p, o, s, 2**31 - 1) for p, (o, s) in live.items()]
    out = pd.DataFrame(rows, columns=["path", "field", "since", "until"])
    out.insert(0, "artifact", events["artifact"].iloc[0])
    out.insert(0, "producer_id", events["producer_id"].iloc[0])
    return out


def unified_values(loaded: DataFrame, changes: DataFrame) -> DataFrame:
    """``record_id, artifact, field, type, value``: every value under the first name of its field.

    Where a record carries one field more than once (under its old and its new name, say), the value under the
    present name keeps the field and the others get it with #2, #3 and so on, so none is lost.
    """
    named = F.col("change_kind").isin("renamed", "added")
    events = changes.where(named).select(*FILE, F.col("field_path").alias("old"), F.col("new_path").alias("new"))
    spans = events.groupBy("producer_id", "artifact").applyInPandas(_origins, "producer_id string, artifact string, path string, field string, since int, until int")
    flat = loaded.select("record_id", *FILE, F.explode("fields").alias("f")).select("record_id", *FILE, "f.*").alias("v")
    on = [F.col(f"v.{c}") == F.col(f"s.{c}") for c in ("producer_id", "artifact", "path")]
    hit = flat.join(spans.alias("s"), [*on, F.col("v.file_seq").between(F.col("s.since"), F.col("s.until"))], "left")
    rows = hit.select("v.record_id", "v.artifact", F.coalesce("s.field", "v.path").alias("field"), "v.type", "v.value", "v.path", F.col("s.field").isNull().alias("former"))
    nth = F.row_number().over(Window.partitionBy("record_id", "field").orderBy("former", "path", "type", "value"))
    rows = rows.withColumn("nth", nth)
    return rows.select("record_id", "artifact", F.when(F.col("nth") > 1, F.concat("field", F.lit("#"), "nth")).otherwise(F.col("field")).alias("field"), "type", "value")


def target_types(values: DataFrame) -> DataFrame:
    """``artifact, field, target``: the most frequent raw type of each field over all records."""
    n = values.groupBy("artifact", "field", "type").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct((F.col("type") == "array of").cast("int"), -F.col("n"), F.col("type"))
    return n.groupBy("artifact", "field").agg(F.min_by("type", rank).alias("target"))


def cast_values(values: DataFrame, targets: DataFrame) -> DataFrame:
    """``values`` with ``target`` and ``cast`` (text of the value in the target type; null where the cast failed).

    number: what reads as a double; boolean: what reads as one; string and object: the value's text; arrays: an
    array of that type, or a single element of its type, which becomes its only element.
    """
    t, v, raw = F.col("target"), F.col("value"), F.col("type")
    plain = ~raw.startswith("array") & (raw != "object")
    done = (
        F.when(t == raw, v)
        .when((t == "number") & plain, F.when(raw != "boolean", v.try_cast("double").cast("string")))
        .when((t == "boolean") & plain, v.try_cast("boolean").cast("string"))
        .when((t == "string") & plain, v)
        .when(t.startswith("array") & (raw == "array of"), v)
        .when(t == F.concat(F.lit("array of "), raw), F.when(raw == "string", F.to_json(F.array(v))).otherwise(F.concat(F.lit("["), v, F.lit("]"))))
    )
    return values.join(targets, ["artifact", "field"]).withColumn("cast", done)


def failed_casts(cast: DataFrame) -> DataFrame:
    """``artifact, field, target, type, n_failed, example`` of the casts that failed."""
    return cast.where("cast IS NULL").groupBy("artifact", "field", "target", "type").agg(F.count(F.lit(1)).alias("n_failed"), F.min(F.substring("value", 1, 80)).alias("example"))


def consistent_table(loaded: DataFrame, cast: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per record: a typed column for each field (dots become two underscores), and ``failed_fields``.

    A field whose columns would have different types in different artifacts has a column for each of these artifacts,
    named artifact, two underscores, field. Only the list of fields, which is schema and not data, comes to the driver
    to name the columns.
    """
    types = {"number": "double", "boolean": "boolean", "array of string": "array<string>", "array of number": "array<double>"}
    fields: dict[str, dict[str, str]] = {}
    for r in targets.select("artifact", "field", "target").collect():
        fields.setdefault(r.field, {})[r.artifact] = types.get(r.target, "string")
    maps = cast.groupBy("record_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("cast").isNotNull(), F.struct("field", "cast")))).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("cast").isNull(), F.col("field")))).alias("failed_fields"),
    )
    used: set[str] = {"record_id", *FILE, "package_id", "received_at", "valid", "failed_fields"}
    columns = []
    for field, kinds in sorted(fields.items()):
        one = len(set(kinds.values())) == 1
        for artifact, kind_ in sorted(kinds.items())[: 1 if one else None]:
            name = (field if one else f"{artifact}.{field}").replace(".", "__")
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            x = F.col("m")[field] if one else F.when(F.col("artifact") == artifact, F.col("m")[field])
            columns.append((F.from_json(x, kind_) if kind_.startswith("array") else x.try_cast(kind_)).alias(name))
    head = loaded.select("record_id", *FILE, "package_id", "received_at", "valid")
    return head.join(maps, "record_id", "left").select(*head.columns, *columns, "failed_fields")
