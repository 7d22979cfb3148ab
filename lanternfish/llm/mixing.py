"""Records of several sources mixed to target shares of all tokens, by balanced sampling.

Each source is due a number of tokens; every record gets the same expected number of copies, whose whole part is
given at once and whose fraction is an inclusion probability. The cube method moves these probabilities in the null
space of the balancing constraints (number of records, number of tokens) until all but a few are 0 or 1. It runs in
blocks of bounded size; what a block leaves undecided meets in the blocks of the next round. In the round in which a
source fits into one block it lands: the choice of the last undecided records that is nearest to the due tokens, then
exchanges of single records in that block.

Sources are compared without case, outer blanks and with - for _. Records without a token, a source or a target are
not used; a source with a target and no record supplies nothing, and the others share its part in proportion.
Repeated texts are records of their own. Equal sizes are balanced by number alone. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.truncation import normal_source
from lanternfish.sources.storage import cut

#: Records of a block on average.
BLOCK = 512
#: The size of a mix whose total isn't given, as a share of the tokens of all targeted sources.
TOTAL_SHARE = 0.5


def flight(tokens: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Chances after the flight: all but at most two are 0 or 1, sums of chance and of chance times size kept."""
    p = chance.astype(float).tolist()
    t = tokens.astype(float).tolist()
    live: list[int] = []
    eps = 1e-9
    for k in range(len(p)):
        if eps < p[k] < 1 - eps:
            live.append(k)
        while len(live) >= 3:
            a, b, c = live[-3:]
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if max(map(abs, u)) < 1e-12:
                u = (1.0, -1.0, 0.0)
            _move(p, (a, b, c), u, rng)
            live = [i for i in live[:-3] + [a, b, c] if eps < p[i] < 1 - eps]
    if len(live) == 2 and abs(t[live[0]] - t[live[1]]) < 1e-12:
        _move(p, tuple(live), (1.0, -1.0), rng)
    return np.array([0.0 if x <= eps else 1.0 if x >= 1 - eps else x for x in p])


def _move(p: list[float], units: tuple, u: tuple, rng: np.random.Generator) -> None:
    """One random step along u, as far as the chances allow, unbiased."""
    up = min(((1 - p[i]) / d if d > 0 else p[i] / -d) for i, d in zip(units, u) if d)
    down = min((p[i] / d if d > 0 else (1 - p[i]) / -d) for i, d in zip(units, u) if d)
    step = up if rng.random() < down / (up + down) else -down
    for i, d in zip(units, u):
        p[i] += step * d


def landing(tokens: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """0 or 1 for the records a flight leaves undecided (two at most) so that their tokens come nearest to what is due."""
    due = float((tokens * chance).sum())
    best = min(range(1 << len(tokens)), key=lambda m: abs(sum(int(tokens[i]) for i in range(len(tokens)) if m >> i & 1) - due))
    return np.array([(best >> i) & 1 for i in range(len(tokens))], dtype=float)


def improved(tokens: np.ndarray, chosen: np.ndarray, due: float) -> np.ndarray:
    """A choice brought nearer to the due tokens by adding, dropping or exchanging single records, until none helps.

    Every step comes nearer to the due number and choices are finite, so it ends.
    """
    out = chosen.copy()
    while True:
        gap = due - float(tokens[out > 0].sum())
        inside, outside = np.flatnonzero(out > 0), np.flatnonzero(out == 0)
        best, move = abs(gap), None
        for part, sign in ((outside, 1), (inside, -1)):
            if len(part):
                left = np.abs(gap - sign * tokens[part])
                if left.min() < best - 1e-9:
                    best, move = float(left.min()), [part[int(left.argmin())]]
        if len(inside) and len(outside):
            left = np.abs(gap - (tokens[outside][:, None] - tokens[inside][None, :]))
            if left.min() < best - 1e-9:
                i, j = np.unravel_index(int(left.argmin()), left.shape)
                best, move = float(left.min()), [outside[i], inside[j]]
        if move is None:
            return out
        out[move] = 1 - out[move]


def dues(limits: dict[str, float], shares: dict[str, float], total: float) -> dict[str, float]:
    """Tokens each source is to supply of a total: its share, at most its limit; what the exhausted ones can't supply is
    spread over the others in proportion to their shares, until it fits or all are exhausted."""
    full: dict[str, float] = {}
    while True:
        rest = total - sum(full.values())
        free = {s: x for s, x in shares.items() if s not in full}
        whole = sum(free.values())
        over = [s for s, x in free.items() if x / whole * rest >= limits[s]]
        if not over:
            return full | {s: x / whole * rest for s, x in free.items()}
        full |= {s: limits[s] for s in over}


def source_budget(records: DataFrame, targets: DataFrame, total_tokens: int | None = None, total_share: float = TOTAL_SHARE) -> DataFrame:
    """``source, target_share, max_repeats, n_records, available, due, rate`` of the targeted sources with records.

    due is the tokens a source is to supply (see :func:`dues`), rate the expected copies of each of its records. The
    total is total_tokens, or else total_share of the tokens that all targeted sources have.
    """
    t = targets.where("target_share > 0").groupBy(normal_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("tokens").alias("available"))
    both = cut(t.join(have, "source").where("max_repeats >= 1 AND available > 0"), "sources")
    rows = both.collect()  # a row per target: the list of targets, not data
    total = float(total_tokens) if total_tokens is not None else total_share * sum(r.available for r in rows)
    due = dues({r.source: float(r.available * r.max_repeats) for r in rows}, {r.source: r.target_share for r in rows}, total)
    wanted = both.sparkSession.createDataFrame(sorted(due.items()), "source string, due double")
    out = both.join(F.broadcast(wanted), "source")
    return out.withColumn("rate", F.least(F.col("due") / F.col("available"), F.col("max_repeats").cast("double")))


def _round(undecided: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """One round of flights over ``source, doc_id, tokens, chance``; a source of one block lands in it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        rng = np.random.default_rng(abs(hash((seed, int(rows["doc_id"].iloc[0]), len(rows)))) % (1 << 32))
        size = rows["tokens"].to_numpy(dtype=float)
        p = flight(size, rows["chance"].to_numpy(), rng)
        if rows["blocks"].iloc[0] == 1:
            open_ = (p > 0) & (p < 1)
            if open_.any():
                p[open_] = landing(size[open_], p[open_])
            p = improved(size, p, float((size * rows["chance"].to_numpy()).sum()))
        return rows.assign(chance=p)[["source", "doc_id", "tokens", "chance"]]

    keyed = undecided.join(F.broadcast(blocks), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("blocks")))
    return keyed.groupBy("source", "block").applyInPandas(run, "source string, doc_id bigint, tokens bigint, chance double")


def mix(records: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, total_share: float = TOTAL_SHARE, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the records used, from ``doc_id, source, tokens``."""
    named = records.where("doc_id IS NOT NULL AND tokens > 0").select("doc_id", normal_source(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    named = named.where("source <> ''")
    budget = cut(source_budget(named, targets, total_tokens, total_share), "budget")
    # One row per target: the budget may be broadcast, its size is that of the list of targets.
    rated = named.join(F.broadcast(budget.select("source", "rate")), "source")
    base = F.floor(F.col("rate") + 1e-12)
    rated = cut(rated.select("source", "doc_id", "tokens", base.cast("int").alias("base"), F.greatest(F.col("rate") - base, F.lit(0.0)).alias("chance")), "rated")
    left = rated.where("chance > 1e-9").select("source", "doc_id", "tokens", "chance")
    decided = left.select("doc_id", F.lit(1).alias("extra")).where("false")
    while True:
        # A source that fits into one block lands in this round, whatever the size of the others.
        blocks = cut(left.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "blocks")
        most = blocks.agg(F.max("blocks")).first()[0]
        if not most:
            break
        done = cut(_round(left, blocks, seed), "round")
        decided = decided.unionByName(done.where("chance >= 1").select("doc_id", F.lit(1).alias("extra")))
        if most == 1:
            break
        left, seed = done.where("chance > 0 AND chance < 1"), seed + 1
    out = rated.join(decided, "doc_id", "left").withColumn("copies", F.col("base") + F.coalesce("extra", F.lit(0)))
    return out.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, n_records, n_tokens, most_copies`` of every target."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("tokens") * F.col("copies")).alias("n_tokens"), F.max("copies").alias("most_copies"))
    all_tokens = got.agg(F.sum("n_tokens")).first()[0]
    t = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats")
    out = t.join(got, "source", "left").withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.lit(all_tokens), F.lit(0.0)))
    return out.select("source", "target_share", "max_repeats", "actual_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "most_copies")
