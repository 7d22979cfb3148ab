"""Items of varying size in containers of fixed capacity, filled exactly where sizes complement each other.

Only the histogram of sizes is planned over, and it has at most as many rows as the capacity: sizes, and an index of the
sums of two and three sizes, that fill a gap exactly are taken with the multiplicity that their counts allow (a fill is
missed only if none exists), then what is left goes best-fit. The plan says which ranks of each size go where; the items find their place by their rank, which needs no
sort of a whole size.

An item larger than the capacity is cut: its full parts fill containers of their own, the rest is an item like any
other. Items of size null or 0 or less go nowhere. Capacities that are null or less than 1 are ignored. Equal items are
told apart by their id; ids must be unique. Empty tables give no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.sources.storage import cut

#: Ranks within a size are given in this many parts, so one frequent size isn't one task.
SALTS = 256


class _Index:
    """Available sizes and, for every sum up to the capacity, the number of pairs of available sizes that give it."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        n = len(counts)
        have = (counts > 0).astype(float)
        have[0] = 0
        width = 1 << (2 * n - 1).bit_length()
        ordered = np.rint(np.fft.irfft(np.fft.rfft(have, width) ** 2, width)[:n]).astype(np.int64)
        ordered[0 : n : 2] -= have[: (n + 1) // 2].astype(np.int64)  # s + s is looked at on its own
        self.pairs = ordered // 2
        self.twice = np.zeros(n, dtype=bool)
        self.twice[0 : n : 2] = counts[: (n + 1) // 2] >= 2

    def take(self, parts: list[int]) -> tuple[dict[int, int], int] | None:
        """Uses up a combination as often as the counts allow; what it takes of each size, and how often."""
        need: dict[int, int] = {}
        for p in parts:
            need[p] = need.get(p, 0) + 1
        times = min(int(self.counts[s]) // k for s, k in need.items())
        if times <= 0:
            return None
        for s, k in need.items():
            self.counts[s] -= k * times
            if 2 * s < len(self.counts):
                self.twice[2 * s] = self.counts[s] >= 2
            if not self.counts[s]:
                other = np.flatnonzero(self.counts[: len(self.counts) - s])
                self.pairs[s + other[other > 0]] -= 1
        return need, times

    def pair(self, total: int) -> list[int] | None:
        """Two available sizes of a sum, those of the most even availability; null if there are none."""
        if total < 2 or not (self.pairs[total] or self.twice[total]):
            return None
        low = np.arange(1, total // 2 + 1)
        high = total - low
        n = np.minimum(self.counts[low], self.counts[high])
        if total % 2 == 0:
            n[-1] = self.counts[low[-1]] // 2
        i = int(np.argmax(n))
        return [int(high[i]), int(low[i])] if n[i] > 0 else None

    def triple(self, total: int) -> list[int] | None:
        """Three available sizes of a sum, the most frequent first size first; null if there are none."""
        if total < 3:
            return None
        some = np.flatnonzero(self.counts[1 : total - 1]) + 1
        some = some[(self.pairs[total - some] > 0) | self.twice[total - some]]
        for b in some[np.argsort(-self.counts[some], kind="stable")]:
            self.counts[b] -= 1
            found = self.pair(total - int(b))
            self.counts[b] += 1
            if found:
                return [int(b), *found]
        return None


def _complements(counts: np.ndarray, capacity: int, emit) -> None:
    """Takes combinations that fill the capacity exactly, the largest size first: one size that fills the gap, else two,
    else three, until none of them is there."""
    index = _Index(counts)
    for a in range(capacity, 0, -1):
        while counts[a]:
            gap = capacity - a
            parts = [a] if not gap else [a, gap] if counts[gap] > (gap == a) else None
            if parts is None:
                counts[a] -= 1  # one is set aside while partners are sought
                more = index.pair(gap) or index.triple(gap)
                counts[a] += 1
                parts = [a, *more] if more else None
            took = index.take(parts) if parts else None
            if not took:
                break
            emit(*took, None)


def _best_fit(counts: np.ndarray, capacity: int, emit) -> None:
    """Best fit of what is left, the largest sizes first: an item goes into the fullest container that still takes it.

    Containers of one gap are kept as ranges (first, number), so equal items go into equal containers in one step.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_ = np.zeros(capacity + 1, dtype=bool)

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            gaps.setdefault(gap, []).append((first, number))
            open_[gap] = True

    for s in np.flatnonzero(counts)[::-1]:
        s, n = int(s), int(counts[s])
        while n:
            at = int(np.argmax(open_[s:])) + s
            if open_[at]:
                first, number = gaps[at].pop()
                if not gaps[at]:
                    open_[at] = False
            else:
                at, first, number = capacity, None, n
            per = min(at // s, n)
            times = min(number, n // per)
            base = emit({s: per}, times, first)
            n -= per * times
            put(at - per * s, base, times)
            if first is not None:
                put(at, first + times, number - times)
        counts[s] = 0


def plan(sizes: np.ndarray, numbers: np.ndarray, capacity: int) -> pd.DataFrame:
    """``size, since, until, base, per``: items of a size with ranks in [since, until) go to container
    base + (rank - since) div per. The input has at most ``capacity`` rows, whatever the number of items."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    counts[sizes] = numbers
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    base = 0

    def emit(need: dict[int, int], times: int, into: int | None) -> int:
        """Puts items of some sizes into new containers or into those from ``into`` on; the first container's number."""
        nonlocal base
        first = base if into is None else into
        for s, k in need.items():
            rows.append((s, int(used[s]), int(used[s]) + k * times, first, k))
            used[s] += k * times
        base += times if into is None else 0
        return first

    _complements(counts, capacity, emit)
    _best_fit(counts, capacity, emit)
    return pd.DataFrame(rows, columns=["size", "since", "until", "base", "per"])


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """``pack_id, container, doc_id, piece, start_token, n_tokens`` of items ``doc_id, tokens``.

    capacities: ``pack_id, capacity_tokens``, a few rows. Containers are numbered from 0 in each pack_id.
    """
    caps = capacities.where("pack_id IS NOT NULL AND capacity_tokens >= 1").groupBy("pack_id").agg(F.max("capacity_tokens").alias("capacity"))
    sizes = {r.pack_id: int(r.capacity) for r in caps.collect()}  # the list of capacities, not data
    spark = items.sparkSession
    if not sizes:
        return spark.createDataFrame([], "pack_id int, container bigint, doc_id bigint, piece int, start_token bigint, n_tokens bigint")
    every = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("bigint").alias("capacity")) for p, c in sorted(sizes.items())]))
    each = items.where("tokens > 0").select("doc_id", "tokens", every.alias("c")).select("doc_id", "tokens", "c.*")
    each = each.withColumn("full", F.expr("tokens div capacity")).withColumn("rest", F.col("tokens") % F.col("capacity"))
    # An item of exactly the capacity is whole; larger ones are cut into full parts and a rest.
    rest = each.where("rest > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rest = cut(rest, "rests")

    parts = rest.groupBy("pack_id", "capacity", "rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("pack_id", "rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("pack_id", "rest", "salt", "offset")
    histogram = parts.groupBy("pack_id", "capacity", "rest").agg(F.sum("n").alias("n"))

    def planned(rows: pd.DataFrame) -> pd.DataFrame:
        out = plan(rows["rest"].to_numpy(), rows["n"].to_numpy(), int(rows["capacity"].iloc[0]))
        out.insert(0, "pack_id", int(rows["pack_id"].iloc[0]))
        return out

    # The plan's size is bounded by the capacities, whatever the number of items: each step of complements uses up a size,
    # each step of best fit a size or a gap, and there are no more of either than tokens of capacity.
    table = histogram.groupBy("pack_id").applyInPandas(planned, "pack_id int, size bigint, since bigint, until bigint, base bigint, per bigint").toPandas()
    plans = spark.sparkContext.broadcast({(int(p), int(s)): g[["since", "base", "per"]].to_numpy() for (p, s), g in table.sort_values("since").groupby(["pack_id", "size"])})
    inside = Window.partitionBy("pack_id", "rest", "salt").orderBy("doc_id")
    ranked = rest.withColumn("r", F.row_number().over(inside) - 1).join(offsets, ["pack_id", "rest", "salt"])
    ranked = ranked.select("pack_id", "doc_id", "full", "capacity", "rest", (F.col("r") + F.col("offset")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pandas()
            where = np.zeros(len(d), dtype=np.int64)
            for (p, s), g in d.groupby(["pack_id", "rest"]):
                t = plans.value[int(p), int(s)]
                rank = g["rank"].to_numpy()
                k = np.searchsorted(t[:, 0], rank, side="right") - 1
                where[g.index.to_numpy()] = t[k, 1] + (rank - t[k, 0]) // t[k, 2]
            d["container"] = where
            yield pa.RecordBatch.from_pandas(d[["pack_id", "container", "doc_id", "full", "capacity", "rest"]], preserve_index=False)

    placed = ranked.mapInArrow(place, "pack_id int, container bigint, doc_id bigint, full bigint, capacity bigint, rest bigint")
    small = placed.select("pack_id", "container", "doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), F.col("rest").alias("n_tokens"))
    # Full parts: numbered after the planned containers by the rank of their item, again in salted parts.
    whole = each.where("full > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    totals = whole.groupBy("pack_id", "salt").agg(F.sum("full").alias("n"))
    w = Window.partitionBy("pack_id").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).select("pack_id", "salt", "offset")
    ends = (table["base"] + (table["until"] - table["since"]) // table["per"]).groupby(table["pack_id"]).max().to_dict()
    first = F.lit(0).cast("bigint")
    for p, n in ends.items():
        first = F.when(F.col("pack_id") == int(p), F.lit(int(n)).cast("bigint")).otherwise(first)
    own = Window.partitionBy("pack_id", "salt").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = whole.withColumn("at", F.coalesce(F.sum("full").over(own), F.lit(0))).join(starts, ["pack_id", "salt"])
    large = numbered.select("pack_id", "doc_id", "capacity", (first + F.col("offset") + F.col("at")).alias("start"), F.posexplode(F.array_repeat(F.lit(0), F.col("full").cast("int"))).alias("piece", "_"))
    large = large.select("pack_id", (F.col("start") + F.col("piece")).alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    return small.unionByName(large)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``pack_id, capacity_tokens, n_containers, n_tokens, unused_share, fewest_possible`` of each capacity."""
    sums = packed.groupBy("pack_id").agg(F.countDistinct("container").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    out = sums.join(capacities.groupBy("pack_id").agg(F.max("capacity_tokens").alias("capacity_tokens")), "pack_id")
    space = F.col("n_containers") * F.col("capacity_tokens")
    return out.withColumn("unused_share", 1 - F.col("n_tokens") / space).withColumn("fewest_possible", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
