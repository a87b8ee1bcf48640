"""Ranks and running sums over all rows, without one task that sees a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidara.plans.lineage import Scratch


def running_sum(df: DataFrame, scratch: Scratch, keys: Sequence[str], order: Sequence[str], value: str | None, out: str) -> DataFrame:
    """Adds ``out``, the sum of ``value`` (1 if None) over the rows of the key that come before this one in ``order``.

    ``order`` must end in a unique column. Rows are range-partitioned on key and order, so a hot key spans many
    partitions; partition totals (one row a partition and key) give each partition its offset.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    amount = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    ranged = df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)]).withColumn("__part", F.spark_partition_id()).withColumn("__amount", amount)
    ranged = scratch.save(ranged)
    totals = ranged.groupBy("__part", *keys).agg(F.sum("__amount").alias("__total"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *keys, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("__local", F.coalesce(F.sum("__amount").over(inside), F.lit(0)))
    same = F.col("l.__part") == F.col("o.__part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
    kept = [F.col(f"l.{c}").alias(c) for c in df.columns]
    # One row a partition and key: the planner broadcasts it when it is small and sorts and merges when it is not.
    return local.alias("l").join(offsets.alias("o"), same).select(*kept, (F.col("l.__local") + F.col("o.__offset")).alias(out))
