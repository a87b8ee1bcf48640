"""Problem 7: texts in containers of fixed capacity with as little unused room as possible.

Sizes are whole numbers up to the capacity, so the instance is its histogram, however many documents there are: at most
``capacity`` counts come to the driver. There, Martello and Toth's dominance criterion fixes small sets (one, two or three
sizes) that can replace whatever else a container with their largest size could hold; what remains is placed best-fit,
largest first, all containers with the same room at once. The plan says, for each size, which of its texts (by rank) go to
which containers; the texts take their places in the cluster.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm import tokens
from evidara.plans.lineage import Scratch
from evidara.plans.ranking import running_sum


def _dominating(counts: dict[int, int], sizes: list[int], j: int, room: int) -> list[int] | None:
    """Sizes that, beside one text of size ``j``, dominate every other feasible filling of ``room``; None if unclear.

    ``sizes`` is sorted and holds the sizes that are left; only its ends and what lies around half the room are looked at.
    """

    def left(i: int) -> int:
        return counts[sizes[i]] - (sizes[i] == j)

    top = bisect_right(sizes, room) - 1
    if top >= 0 and not left(top):
        top -= 1
    if top < 0:
        return []
    if sizes[top] == room:
        return [room]

    def least(n: int) -> int | None:
        total, i = 0, 0
        while n and i <= top:
            k = min(n, left(i))
            total, n, i = total + k * sizes[i], n - k, i + 1
        return None if n else total

    two, three = least(2), least(3)
    if two is None or two > room:
        return [sizes[top]]
    if three is not None and three <= room:
        return None
    # At most two texts fit. The best partner of the largest, and the largest least member of any pair.
    if not _pair_above(counts, sizes, j, top, room):
        return [sizes[top]]
    mate = bisect_right(sizes, room - sizes[top], 0, top + 1) - 1
    while mate >= 0 and left(mate) <= (mate == top):
        mate -= 1
    if mate < 0:
        return None
    low = bisect_right(sizes, room // 2, 0, top + 1) - 1
    while low > mate:
        after = low + 1
        while after <= top and not left(after):
            after += 1
        if left(low) > 1 or left(low) and after <= top and sizes[low] + sizes[after] <= room:
            return None
        low -= 1
    return [sizes[top], sizes[mate]]


def _pair_above(counts: dict[int, int], sizes: list[int], j: int, top: int, room: int) -> bool:
    """Whether two texts together fill more than the largest one alone."""
    i, k = 0, top
    while i <= k:
        total = sizes[i] + sizes[k]
        if total > room or i == k and counts[sizes[i]] - (sizes[i] == j) < 2:
            k -= 1
        elif counts[sizes[i]] == (sizes[i] == j):
            i += 1
        elif counts[sizes[k]] == (sizes[k] == j):
            k -= 1
        elif total > sizes[top]:
            return True
        else:
            i += 1
    return False


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, count, first container, texts of this size in one container) for every run of texts.

    The texts of a size with ranks first, first+1, ... go, ``texts in one container`` at a time, to the containers
    first container, first container + 1, ...
    """
    counts = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    given = dict.fromkeys(counts, 0)
    sizes = sorted(counts)
    out: list[tuple[int, int, int, int, int]] = []
    containers = 0

    def put(size: int, times: int, first: int, each: int = 1) -> None:
        out.append((size, given[size], times * each, first, each))
        given[size] += times * each
        counts[size] -= times * each
        if not counts[size]:
            del sizes[bisect_left(sizes, size)]

    # Reduction: while the largest remaining size has a dominating set, fix it as often as the counts allow.
    tried = len(sizes) - 1
    while tried >= 0:
        j = sizes[tried]
        mates = _dominating(counts, sizes, j, capacity - j)
        if mates is None:
            tried -= 1
            continue
        need: dict[int, int] = {}
        for s in (j, *mates):
            need[s] = need.get(s, 0) + 1
        times = min(counts[s] // k for s, k in need.items())
        if len(mates) == 0 and 2 * j <= capacity:
            times = 1
        first, containers = containers, containers + times
        for s, k in need.items():
            put(s, times, first, k)
        tried = min(tried, len(sizes) - 1)
        while tried + 1 < len(sizes) and sizes[tried + 1] <= j:
            tried += 1

    # Best fit, largest first. rooms: (room, first container, how many) of the open containers, ordered by room.
    rooms: list[tuple[int, int, int]] = []
    while sizes:
        size = sizes[-1]
        at = bisect_left(rooms, (size, -1, -1))
        if at < len(rooms):
            room, first, many = rooms.pop(at)
            each = min(room // size, max(1, counts[size] // many))
            times = min(many, counts[size] // each)
            if many > times:
                insort(rooms, (room, first + times, many - times))
        else:
            each = min(capacity // size, counts[size])
            room, first, times = capacity, containers, counts[size] // each
            containers += times
        put(size, times, first, each)
        if room - each * size:
            insort(rooms, (room - each * size, first, times))
    return out


def measured(documents: DataFrame, id_col: str, text: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, end, size): each text as one piece, those above the capacity cut into several."""

    @F.pandas_udf("array<struct<start:int,end:int,size:int>>")
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"start": a, "end": b, "size": n} for a, b, n in tokens.pieces(t, capacity)] for t in batch])

    rows = documents.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), measure(text).alias("p"))
    return rows.select("id", F.posexplode("p").alias("piece_no", "x")).select("id", "piece_no", "x.start", "x.end", "x.size")


def pack(documents: DataFrame, id_col: str, text: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, end, size, container_id): every text in one container, sizes in tokens.

    A text above the capacity is cut; only its last piece leaves room. Containers hold at most ``capacity`` tokens and are
    numbered from 0. Null texts are left out; empty texts, and any of 0 tokens, go to container 0 (-1 if there is no other).
    Rows that repeat an id are packed each for itself. An empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "pack")
    sized = scratch.save(measured(documents, id_col, text, capacity))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(histogram, capacity)
    ranked = running_sum(sized.withColumn("__u", F.monotonically_increasing_id()), scratch, ["size"], ["id", "piece_no", "__u"], None, "rank")
    # Of one size the runs follow each other, so the last run that starts at or before a rank is the text's: an array
    # lookup in a broadcast table of runs, whose number depends on the capacity and not on the documents.
    spark = documents.sparkSession
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for size, rank, _, first, each in runs:
        by_size.setdefault(size, []).append((rank, first, each))
    table = spark.createDataFrame([(s, [{"rank": r, "first": f, "each": e} for r, f, e in sorted(x)]) for s, x in by_size.items()], "size int, runs array<struct<rank:bigint,first:bigint,each:int>>")
    placed = ranked.join(F.broadcast(table), "size", "left")
    run = F.element_at(F.filter("runs", lambda x: x["rank"] <= F.col("rank")), -1)
    placed = placed.withColumn("__run", run)
    container = F.col("__run.first") + F.floor((F.col("rank") - F.col("__run.rank")) / F.col("__run.each"))
    empty = F.lit(0 if runs else -1).cast("long")
    return placed.select(F.col("id").alias(id_col), "piece_no", "start", "end", "size", F.coalesce(container, empty).alias("container_id"))
