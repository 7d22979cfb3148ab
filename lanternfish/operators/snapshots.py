"""Changes between consecutive full snapshots, found through digests of hash ranges.

Every snapshot becomes a Merkle tree over ranges of the key's hash. Consecutive snapshots are compared from the
top down, and rows meet only within sub-ranges whose digests differ.

The leaves of the tree are nodes: ranges of about NODE_ROWS keys whatever the size of a snapshot, each with the digests
of its sixteen sub-ranges; above them every sixteen nodes are a node up to the root, as many levels as the largest
snapshot needs. A digest is the xor of a 64-bit hash of each row. It doesn't depend on the order of rows, so it needs no
sort and combines upward by xor; the xor of both snapshots' digests is zero where a range is equal.

Rows travel as 64-bit hashes of key and value; the keys of the changes are looked up at the end. So unequal ranges, and
unequal values, agree with a chance of 2**-64 each, and two of n keys of a group with one of less than n**2 * 2**-65.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.sources.storage import cut, looked_up, unsent

#: Children of a node, and sub-ranges of the lowest nodes.
FANOUT = 16
#: Snapshots of up to this many rows form one node; larger ones are split into ranges of about this size.
NODE_ROWS = 4096
NODE = ["g", "s", "bits", "node"]
#: Span of snapshot numbers within which neighbours are looked up at once.
BLOCK = 1024


def snapshot_links(snapshots: DataFrame, group: str, number: str) -> DataFrame:
    """``group, number, prev_no, next_no`` of every distinct snapshot.

    Rows with a null group or number are left out. Neighbours are found inside blocks of numbers first and
    between blocks by their edges, so no window holds more than BLOCK rows of a group or one row per block.
    """
    seen = snapshots.select(F.col(group).alias("g"), F.col(number).alias("s")).where("g IS NOT NULL AND s IS NOT NULL").distinct()
    seen = seen.withColumn("block", F.floor(F.col("s") / BLOCK))
    over = Window.partitionBy("g").orderBy("block")
    edges = (
        seen.groupBy("g", "block")
        .agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
        .select("g", "block", F.lag("hi").over(over).alias("before"), F.lead("lo").over(over).alias("after"))
    )
    inside = Window.partitionBy("g", "block").orderBy("s")
    return (
        seen.withColumn("p", F.lag("s").over(inside))
        .withColumn("n", F.lead("s").over(inside))
        .join(edges, ["g", "block"])
        .select(F.col("g").alias(group), F.col("s").alias(number), F.coalesce("p", "before").alias("prev_no"), F.coalesce("n", "after").alias("next_no"))
    )


def large_groups(rows: DataFrame, group: str, number: str) -> DataFrame:
    """``group, bits`` of the groups with a snapshot of more than NODE_ROWS rows: into how many (2**bits) nodes their
    snapshots are split, so that a node has NODE_ROWS rows or fewer on average."""
    return (
        rows.groupBy(group, number)
        .count()
        .where(F.col("count") > NODE_ROWS)
        .groupBy(group)
        .agg(F.ceil(F.log2(F.max("count") / F.lit(NODE_ROWS))).cast("int").alias("bits"))
    )


def node_of(key_hash: Column, bits: Column) -> Column:
    """The node of a key: the first bits of its hash."""
    return F.when(bits > 0, F.call_function("shiftrightunsigned", key_hash, 64 - bits)).otherwise(F.lit(0).cast("bigint"))


def _with_bits(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``g, s, k, v, at, idx`` with the bits of their group."""
    joined = looked_up(rows, large, ["g"], "k")
    return joined.withColumn("bits", F.coalesce("bits", F.lit(0)))


def _latest(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("at", "idx", "v")).alias("best")
    return rows.groupBy(*NODE, "k").agg(best).select(*NODE, "k", "best.*")


def _differing(compared: DataFrame, bits: int) -> DataFrame:
    """The lowest nodes that differ, top down: only below nodes that differ is the next level compared.

    Every sixteen nodes are one of the level above; its digest is the xor of theirs. A tree has as many rows here as it has
    nodes, one for NODE_ROWS rows.
    """
    opened = compared.where("whole <> 0")
    for n in range(-(-bits // 4), 0, -1):
        above = Window.partitionBy("g", "pair", F.shiftright("node", 4 * n))
        opened = opened.withColumn("above", F.bit_xor("whole").over(above)).where("above <> 0").drop("above")
    return opened


def snapshot_changes(
    rows: DataFrame, snapshots: DataFrame, *, group: str, number: str, key: Column, value: Column, at: str, idx: str
) -> DataFrame:
    """``group, number, key, change_kind`` for every two consecutive snapshots of a group.

    rows: full deliveries; of several rows for one key in a snapshot the one with the latest ``at`` counts, then
    the highest ``idx``, then the greatest hash of the value. snapshots: further snapshots that may have no rows.
    A null key is ignored; a null value counts as present but never as changed; an empty table gives no rows;
    further columns are ignored. change_kind is added, removed or changed; ``number`` is the later snapshot's.
    """
    rows = rows.where(F.col(group).isNotNull() & F.col(number).isNotNull())
    names = [F.col(group).alias("g"), F.col(number).alias("s")]
    links = unsent(cut(snapshot_links(rows.select(*names).unionByName(snapshots.select(*names)), "g", "s"), "links"))
    large = cut(large_groups(rows, group, number).select(F.col(group).alias("g"), "bits"), "large")
    bits = large.agg(F.max("bits")).first()[0] or 0

    keyed = rows.select(*names, key.alias("key"), value.alias("text"), F.col(at).alias("at"), F.col(idx).alias("idx")).where("key IS NOT NULL")
    hashed = keyed.select("g", "s", F.xxhash64("key").alias("k"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("v"), "at", "idx")
    placed = _with_bits(hashed, large).withColumn("node", node_of(F.col("k"), F.col("bits")))
    # Large snapshots may repeat one key any number of times: combine before the shuffle. Others are bounded.
    columns = [*NODE, "k", "at", "idx", "v"]
    spread = placed.where("bits = 0").select(*columns)
    if bits:
        spread = spread.unionByName(_latest(placed.where("bits > 0")).select(*columns))
    # One shuffle brings a node's rows together; the two steps below work within it.
    held = _latest(spread.repartition(*NODE)).select(*NODE, "k", "v", F.expr("cast(shiftrightunsigned(shiftleft(k, bits), 60) as int)").alias("bucket"))

    zero = F.lit(0).cast("bigint")
    digests = [f"d{i}" for i in range(FANOUT)]
    nodes = held.withColumn("leaf", F.xxhash64("k", F.col("v").isNull(), "v")).groupBy(*NODE).agg(
        F.bit_xor(F.xxhash64(F.lit(2), "leaf")).alias("whole"),
        *[F.bit_xor(F.when(F.col("bucket") == i, F.col("leaf")).otherwise(zero)).alias(d) for i, d in enumerate(digests)],
    )
    # A node takes part as the later side of its own pair and as the earlier side of the next one; the xor over
    # both sides is zero where they are equal, and a side without rows counts as zero.
    pairs = F.explode(F.array_compact(F.array(F.when(F.col("prev_no").isNotNull(), F.col("s")), F.col("next_no"))))
    sided = nodes.join(links, ["g", "s"]).select("g", pairs.alias("pair"), "bits", "node", "whole", *digests)
    compared = sided.groupBy("g", "pair", "bits", "node").agg(*[F.bit_xor(c).alias(c) for c in ["whole", *digests]])
    mask = F.lit(0)
    for i, d in enumerate(digests):
        mask = mask.bitwiseOR(F.when(F.col(d) != 0, F.lit(1 << i)).otherwise(F.lit(0)))
    # Equal nodes end here, of the others only the sub-ranges in the mask are opened.
    opened = _differing(compared.select("g", "pair", "bits", "node", "whole", mask.alias("mask")), bits)
    both = F.explode(F.array(F.struct(F.col("pair").alias("s"), F.lit(1).alias("later")), F.struct(F.col("prev_no").alias("s"), F.lit(0).alias("later"))))
    todo = (
        opened.join(links.select("g", F.col("s").alias("pair"), "prev_no"), ["g", "pair"])
        .select("g", both.alias("e"), "bits", "node", "pair", "mask")
        .select("g", "e.s", "e.later", "bits", "node", "pair", "mask")
    )
    touched = held.join(todo, NODE).where("shiftright(mask, bucket) & 1 = 1")
    sides = touched.groupBy("g", "pair", "k").agg(
        F.max("later").alias("in_new"),
        F.min("later").alias("in_old"),
        F.bit_xor("v").alias("differs"),
        F.count("v").alias("known"),
    )
    kind = (
        F.when(F.col("in_old") == 1, "added")
        .when(F.col("in_new") == 0, "removed")
        .when((F.col("known") == 2) & (F.col("differs") != 0), "changed")
    )
    changes = sides.select("g", "pair", "k", kind.alias("change_kind")).where("change_kind IS NOT NULL")
    # A group delivers the same keys again and again: they are combined before they meet the changes.
    spelled = keyed.groupBy("g", F.xxhash64("key").alias("k")).agg(F.min("key").alias("key"))
    return changes.join(spelled, ["g", "k"]).select(F.col("g").alias(group), F.col("pair").alias(number), "key", "change_kind")
