"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of all rows, so there are at most so many hot keys.
HOT_PARTS = 1000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[tuple[str, str]], value: str, count: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of the row of ``table`` whose keys are equal, nulls included; rows without one are left out.

    ``table`` has one row a key and in ``count`` how many rows hold it, which sum to at most ``total``. Hot keys, at most
    HOT_PARTS by that sum, are broadcast, so their rows stay where they are; only the others are shuffled by key.
    """
    hot = F.col(count) * HOT_PARTS > F.lit(total)

    def side(part: DataFrame) -> DataFrame:
        return part.select(*[F.col(t).alias(f"__{t}") for _, t in keys], F.col(value).alias(f"__{value}"))

    same = reduce(lambda x, y: x & y, [F.col(r).eqNullSafe(F.col(f"__{t}")) for r, t in keys])
    drop = [f"__{t}" for _, t in keys]
    near = rows.join(F.broadcast(side(table.where(hot))), same, "left").drop(*drop)
    here = near.where(F.col(f"__{value}").isNotNull())
    away = near.where(F.col(f"__{value}").isNull()).drop(f"__{value}").join(side(table.where(~hot)), same).drop(*drop)
    return here.unionByName(away).withColumnRenamed(f"__{value}", value)
