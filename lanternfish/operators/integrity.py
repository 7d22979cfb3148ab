"""Normalised hashes, Merkle trees by level, proofs and their verification.

Leaves are rows ``group..., idx, hash`` with idx counted from 0 without gaps. A pair's hash is the SHA-256 of both
hexadecimal texts put together; a lone last one is paired with itself; a single leaf is the root. Groups without a leaf
have the root of 64 zeros only where asked for. Null hashes count as empty text. A grouping by ``idx div 1024`` folds ten
levels at once within lists of at most 1,024 hashes, so a tree of n leaves takes log n to the base of 1,024 groupings and no
group's leaves are ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.sources.storage import cut

ZERO = "0" * 64
#: Levels folded in one grouping.
STEPS = 10


def text_hash(text: Column) -> Column:
    """``sha256:`` and the SHA-256 of a text whose line ends are LF."""
    return F.concat(F.lit("sha256:"), F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256))


def _pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat(a, b), 256)


def numbered(rows: DataFrame, groups: list[str], order: Column) -> DataFrame:
    """Adds ``idx``, the place in the order within a group. Rows are cut into ranges of (group, order) first and numbered
    within each, so that one large group is spread over many tasks; ranges add the sizes of those before them."""
    ranged = rows.withColumn("__order", order).repartitionByRange(*groups, "__order").withColumn("__part", F.spark_partition_id())
    ranged = cut(ranged, "ranged")
    sizes = ranged.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*groups, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*groups, "__part").orderBy("__order")
    at = (F.col("__start") + F.row_number().over(inside) - 1).cast("bigint")
    return ranged.join(starts, [*groups, "__part"]).withColumn("idx", at).drop("__order", "__part", "__start")


def _folded(lone: Column) -> Column:
    """``level, idx, hash`` of the levels above a block's hashes ``hs``: up to one node where the block is its whole tree
    (``lone``), else all STEPS levels."""

    def half(hs: Column) -> Column:
        last = (F.ceil(F.size(hs) / 2) - 1).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: _pair(F.get(hs, 2 * i), F.coalesce(F.get(hs, 2 * i + 1), F.get(hs, 2 * i))))

    steps = F.when(lone, F.ceil(F.log2(F.size("hs").cast("double"))).cast("int")).otherwise(STEPS)
    levels = F.aggregate(F.sequence(F.lit(1), steps), F.array(F.col("hs")), lambda acc, _: F.concat(acc, F.array(half(F.element_at(acc, -1)))))
    rows = F.transform(levels, lambda hs, n: F.transform(hs, lambda h, i: F.struct(n.alias("level"), i.alias("at"), h.alias("hash"))))
    return F.flatten(F.slice(rows, 2, STEPS))


def merkle_levels(leaves: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, level, idx, hash`` of all nodes, level 0 being the leaves."""
    level = cut(leaves.select(*groups, F.lit(0).alias("level"), F.col("idx").cast("bigint").alias("idx"), F.coalesce("hash", F.lit("")).alias("hash")), "level")
    out, n = level, 0
    width = 1 << STEPS
    while True:
        # The lists are bounded by the width; a tree of one block ends in it.
        tops = level.groupBy(*groups).agg(F.max("idx").alias("top")).where("top > 0")
        blocks = level.join(tops, groups).groupBy(*groups, "top", F.expr(f"idx div {width}").alias("block"))
        lists = blocks.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("hs"))
        each = lists.select(*groups, "block", F.explode(_folded(F.col("top") < width)).alias("f"))
        nodes = each.select(*groups, (F.col("f.level") + n).cast("int").alias("level"), (F.col("block") * F.call_function("shiftright", F.lit(width).cast("bigint"), F.col("f.level")) + F.col("f.at")).cast("bigint").alias("idx"), F.col("f.hash").alias("hash"))
        nodes = cut(nodes, "level")
        out, n = out.unionByName(nodes), n + STEPS
        level = nodes.where(F.col("level") == n)
        if not (level.agg(F.max("idx")).first()[0] or 0):
            return out


def roots(levels: DataFrame, groups: list[str]) -> DataFrame:
    """``groups, n_leaves, root``."""
    return levels.groupBy(*groups).agg(F.count_if(F.col("level") == 0).alias("n_leaves"), F.max_by("hash", "level").alias("root"))


def proofs(levels: DataFrame, groups: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """``groups, leaf, level, sibling, side``: the other node of each level on a leaf's way up; a lone one is its own.
    wanted: ``groups, leaf`` where not every leaf's proof is asked for."""
    depth = levels.groupBy(*groups).agg(F.max("level").alias("depth"))
    leaves = levels.where("level = 0").join(depth, groups).where("depth > 0")
    if wanted is not None:
        leaves = leaves.join(wanted.withColumnRenamed("leaf", "idx"), [*groups, "idx"], "left_semi")
    way = leaves.select(*groups, F.col("idx").alias("leaf"), F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("level"))
    at = way.withColumn("idx", F.expr("shiftright(leaf, level)"))
    nodes = levels.select(*groups, "level", "idx", "hash")
    other = nodes.withColumnRenamed("hash", "sibling").withColumn("idx", F.col("idx").bitwiseXOR(F.lit(1).cast("bigint")))
    j = at.join(nodes, [*groups, "level", "idx"]).join(other, [*groups, "level", "idx"], "left")
    side = F.when(F.col("idx") % 2 == 0, "right").otherwise("left")
    return j.select(*groups, "leaf", "level", F.coalesce("sibling", "hash").alias("sibling"), side.alias("side"))


def verified(levels: DataFrame, proof: DataFrame, groups: list[str], claimed: DataFrame | None = None) -> DataFrame:
    """``groups, leaf, valid``: whether each leaf's proof leads to the root. A proof has as many steps as levels.
    claimed: ``groups, idx, hash`` to be proven in place of all leaves of the tree."""
    step = F.array_sort(F.collect_list(F.struct("level", "sibling", "side"))).alias("steps")
    path = proof.groupBy(*groups, "leaf").agg(step)
    leaves = (levels.where("level = 0") if claimed is None else claimed).select(*groups, F.col("idx").alias("leaf"), "hash")
    top = roots(levels, groups).select(*groups, "root")
    j = leaves.join(path, [*groups, "leaf"], "left").join(top, groups)
    folded = F.aggregate(
        F.coalesce("steps", F.array().cast("array<struct<level:int,sibling:string,side:string>>")),
        F.col("hash"),
        lambda acc, s: F.when(s["side"] == "right", _pair(acc, s["sibling"])).otherwise(_pair(s["sibling"], acc)),
    )
    return j.select(*groups, "leaf", (folded == F.col("root")).alias("valid"))


def path_escapes(path: Column) -> Column:
    """Whether a relative path leaves its root: absolute, or ``..`` goes above it at some point."""
    parts = F.split(path, "/")
    step = lambda p: F.when(p == "..", -1).when((p == ".") | (p == ""), 0).otherwise(1)
    walk = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, p: F.struct((acc["depth"] + step(p)).alias("depth"), F.least(acc["low"], acc["depth"] + step(p)).alias("low")),
    )
    return F.startswith(path, F.lit("/")) | (walk["low"] < 0)


def compared_files(locked: DataFrame, current: DataFrame) -> DataFrame:
    """``package_id, path, hash, now, status`` of every locked leaf against current hashes: ok, mismatch, missing or escapes."""
    now = current.select("package_id", "path", F.col("hash").alias("now"))
    j = locked.select("package_id", "path", "hash").join(now, ["package_id", "path"], "left")
    status = F.when(path_escapes(F.col("path")), "escapes").when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("hash"), "ok").otherwise("mismatch")
    return j.select("package_id", "path", "hash", "now", status.alias("status"))


def lock_text(package: Column, n_files: Column, root: Column) -> Column:
    """A lock as JSON with its keys in order, without blanks."""
    return F.to_json(F.struct(n_files.alias("n_files"), package.alias("package_id"), root.alias("root")))


def verified_files(leaves: DataFrame, current: DataFrame, wanted: DataFrame) -> DataFrame:
    """``package_id, path, locked, same, proven`` of wanted files: whether the lock has a leaf for it, whether that is the
    hash there now, and whether the proof of that hash leads to the lock's root (null without leaf or file).

    leaves: ``package_id, path, hash, idx`` of the locks; only the nodes on the way of wanted leaves are looked up.
    """
    levels = merkle_levels(leaves, ["package_id"])
    asked = wanted.join(leaves.select("package_id", "path", "idx", "hash"), ["package_id", "path"], "left")
    asked = asked.join(current.select("package_id", "path", F.col("hash").alias("now")), ["package_id", "path"], "left")
    mine = asked.where("idx IS NOT NULL AND now IS NOT NULL").select("package_id", F.lit(0).alias("level"), "idx", F.col("now").alias("hash"))
    way = proofs(levels, ["package_id"], mine.select("package_id", F.col("idx").alias("leaf")))
    good = verified(levels, way, ["package_id"], mine).withColumnRenamed("leaf", "idx")
    out = asked.join(good, ["package_id", "idx"], "left")
    return out.select("package_id", "path", F.col("idx").isNotNull().alias("locked"), (F.col("now") == F.col("hash")).alias("same"), F.col("valid").alias("proven"))


def root_matches(compared: DataFrame) -> DataFrame:
    """``package_id, root, root_ok``: the root over the locked hashes, and whether the files there now have the same one;
    a leaf that is missing or leaves the package counts as ZERO."""
    now = F.when(F.col("status").isin("missing", "escapes"), ZERO).otherwise(F.col("now"))
    rows = numbered(compared.select("package_id", "path", "hash", now.alias("now")), ["package_id"], F.split("path", "/"))
    # Both trees have the same places and are built in one go.
    sides = F.explode(F.create_map(F.lit("then"), F.col("hash"), F.lit("now"), F.col("now"))).alias("side", "hash")
    tops = roots(merkle_levels(rows.select("package_id", "idx", sides), ["package_id", "side"]), ["package_id", "side"])
    j = tops.groupBy("package_id").agg(*[F.max(F.when(F.col("side") == s, F.col("root"))).alias(c) for s, c in (("then", "hash"), ("now", "now"))])
    return j.select("package_id", F.col("hash").alias("root"), (F.col("hash") == F.col("now")).alias("root_ok"))
