"""Problem 8: a mix of sources by token shares, with a cap on repeats.

The texts of a source form one stream of tokens, cut into blocks of fixed length. Each output shard draws its number of
blocks of every source from a multinomial; slot i of a source takes block perm(i mod blocks), a keyed pseudorandom
permutation that is another one in every pass over the source, so no block comes a second time before all came once.
The draws are multinomial ones given the totals (see shard_counts), so every source comes to its share exactly. Slots and blocks meet in one join on the block's number; no shuffle order, state or global sort is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import tokens
from evidara.plans.lineage import Scratch
from evidara.plans.ranking import running_sum

BLOCK_TOKENS = 256
#: Slots wanted in a shard.
SHARD_SLOTS = 1024
#: Shards whose counts one task draws, at most.
SHARDS_A_TASK = 1024
#: Beyond so many blocks a hypergeometric draw is taken from its normal limit (the exact sampler is bounded).
EXACT_DRAWS = 500_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: np.ndarray) -> np.ndarray:
    """Where each index under ``size`` goes in the permutation of its key: a Feistel network, walked on until it stays
    inside."""
    half = max(1, (max(1, int(size) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(out.size)
    while todo.size:
        left, right, k = out[todo] >> shift, out[todo] & mask, key[todo]
        for r in range(4):
            left, right = right, left ^ (_mix(right + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def shards_of(slots: int) -> int:
    return max(1, slots // SHARD_SLOTS)


def _halved(counts: list[int], size: int, rng: np.random.Generator) -> list[int]:
    """How many of each source's ``counts`` fall among the first ``size`` slots of their uniformly random order."""
    out, left, rest = [], size, sum(counts)
    for n in counts:
        rest -= n
        if not left or not n:
            take = 0
        elif not rest:
            take = left
        elif n + rest <= EXACT_DRAWS:
            take = int(rng.hypergeometric(n, rest, left))
        else:
            p, whole = n / (n + rest), n + rest
            spread = (left * p * (1 - p) * ((whole - left) / max(1, whole - 1))) ** 0.5
            take = min(n, left, max(0, left - rest, round(left * p + spread * rng.standard_normal())))
        out.append(take)
        left -= take
    return out


def shard_counts(totals: list[int], shards: int, seed: int, low: int, high: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(shard, blocks of each source, blocks of each source in the shards before it) for the shards from ``low`` to ``high``.

    The counts are multinomial draws given that every source comes to its total. They are drawn down a binary tree over
    the shards: a node splits its counts between its halves, seeded by the node, so any range of shards is drawn alone
    and alike everywhere, and no task or driver holds the counts of all.
    """
    slots = sum(totals)
    each, more = divmod(slots, shards)

    def down(first: int, last: int, counts: list[int], before: list[int]) -> Iterator[tuple[int, list[int], list[int]]]:
        if last <= low or first >= high:
            return
        if last - first == 1:
            yield first, counts, before
            return
        middle = (first + last) // 2
        size = (middle - first) * each + min(middle, more) - min(first, more)
        left = _halved(counts, size, np.random.default_rng((seed, first, last)))
        yield from down(first, middle, left, before)
        yield from down(middle, last, [n - k for n, k in zip(counts, left, strict=True)], [b + k for b, k in zip(before, left, strict=True)])

    yield from down(0, shards, list(totals), [0] * len(totals))


def _largest_mix(shares: dict[str, float], most: dict[str, int]) -> dict[str, int]:
    """Slots of each source in the largest mix with these shares of which no source is used beyond ``most``."""
    wanted = [s for s, w in shares.items() if w > 0]
    total = min((most[s] / shares[s] for s in wanted), default=0)
    return {s: min(most[s], round(total * shares[s])) for s in wanted}


def mix(documents: DataFrame, weights: DataFrame, id_col: str, text: str, source: str, block: int = BLOCK_TOKENS, seed: int = 1) -> DataFrame:
    """(shard, slot, source, block, id, tok_from, tok_to, tokens): the parts of texts that fill each slot of each shard.

    The mix is the largest that keeps the target shares with no part of a text used more than ``max_repeats`` times. The
    last block of a source may be short, which is the only deviation from the shares besides rounding to blocks.
    ``weights`` is a small table (source, target_share, max_repeats); null or negative shares count as 0, null repeats as
    1, and shares are scaled to sum to 1. A source of positive share without any token makes the mix empty. Texts that are
    null, empty or of a source without weight are not used. Ids must be unique: rows that repeat an id are ordered
    arbitrarily. Empty tables give no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "mix")
    plan = {r["source"]: (max(r["target_share"] or 0.0, 0.0), r["max_repeats"] if r["max_repeats"] is not None else 1) for r in weights.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect()}
    whole = sum(w for w, _ in plan.values())
    names = [s for s, (w, _) in plan.items() if w > 0]
    shares = {s: plan[s][0] / whole for s in names}

    @F.pandas_udf("long")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = tokens.encoding()
        for batch in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) for t in batch], dtype="int64")

    used = documents.where(F.col(text).isNotNull() & F.col(source).isin(names)).select(F.col(id_col).alias("id"), F.col(source).alias("source"), measure(text).alias("n"))
    used = scratch.save(used.withColumn("mixed", F.xxhash64("id", F.lit(seed)))).where("n > 0")  # tokens are counted once
    sized = running_sum(used, scratch, ["source"], ["mixed", "id"], "n", "start")
    amount = {r["source"]: r["n"] for r in used.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    blocks = {s: -(-amount.get(s, 0) // block) for s in names}
    slots = _largest_mix(shares, {s: blocks[s] * plan[s][1] for s in names})
    totals = [slots[s] for s in names]
    shards = shards_of(sum(totals))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for low in b["low"]:
                for k, drawn, before in shard_counts(totals, shards, seed, low, min(low + SHARDS_A_TASK, shards)):
                    inside = 0
                    for s, n, first in zip(names, drawn, before, strict=True):
                        if n:
                            rows.append((k, s, n, first, inside, blocks[s]))
                        inside += n
            yield pd.DataFrame(rows, columns=["shard", "source", "n", "first", "inside", "size"])

    tasks = -(-shards // SHARDS_A_TASK) if sum(totals) else 0
    ranges = spark.range(0, tasks, 1, max(1, tasks)).select((F.col("id") * SHARDS_A_TASK).alias("low"))
    counts = ranges.mapInPandas(draw, "shard bigint, source string, n bigint, first bigint, inside bigint, size bigint")
    filled = counts.select("shard", "source", "first", "inside", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    filled = filled.select("shard", "source", "size", (F.col("inside") + F.col("i")).alias("slot"), (F.col("first") + F.col("i")).alias("index"))

    @F.pandas_udf("long")
    def take(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        out = np.empty(len(index), np.int64)
        number, sizes = index.to_numpy(np.int64), size.to_numpy(np.int64)
        keys = key.to_numpy(np.int64).view(np.uint64)
        for one in np.unique(sizes):
            at = np.flatnonzero(sizes == one)
            out[at] = permuted(number[at] % one, one, keys[at])
        return pd.Series(out)

    turn = F.xxhash64("source", F.floor(F.col("index") / F.col("size")), F.lit(seed))
    chosen = filled.select("shard", "slot", "source", take("index", "size", turn).alias("block"))
    parts = sized.select("source", "id", "n", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block))).alias("block"))
    low = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * block - F.col("start"), F.col("n"))
    parts = parts.select("source", "block", F.col("id").alias(id_col), low.alias("tok_from"), high.alias("tok_to"))
    return chosen.join(parts, ["source", "block"]).select("shard", "slot", "source", "block", id_col, "tok_from", "tok_to", (F.col("tok_to") - F.col("tok_from")).alias("tokens"))


def reached(mixed: DataFrame, weights: DataFrame, id_col: str) -> DataFrame:
    """(source, target_share, actual_share, tokens, most_uses): what the mix came to; a source not used has 0."""
    uses = mixed.groupBy("source", "block", id_col).agg(F.count(F.lit(1)).alias("uses"), F.sum("tokens").alias("tokens"))
    got = uses.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"))
    total = got.agg(F.sum("tokens").alias("t")).first()["t"] or 1
    rows = weights.select("source", "target_share").join(got, "source", "left")
    n = F.coalesce("tokens", F.lit(0))
    return rows.select("source", "target_share", (n / F.lit(total)).alias("actual_share"), n.alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
