"""The event log: replay, counters, bounded tails and stages, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.plans.lineage import shared_root


def numbered(events: DataFrame, order: list[str]) -> DataFrame:
    """The log with ``seq``, its position from 0, numbered over range partitions."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    return running_sum(events.withColumn("__all", F.lit(0)), Scratch(events.sparkSession, "log"), ["__all"], order, None, "seq").drop("__all")


def since(log: DataFrame, seq: int) -> DataFrame:
    return log.where(F.col("seq") >= seq)


def tail(log: DataFrame, keys: list[str], most: int = 1000) -> DataFrame:
    """The last ``most`` events of each key: what a subscriber that reads too slowly still gets."""
    w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
    return log.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, kind, n, total) for a batch or a stream; a stream drops windows ``late`` after their end."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    counted = source.groupBy(F.window(time, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), kind, "n", "total")


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream yields for the input there is, written exactly once to the shared folder and read back."""
    import uuid

    at = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def upserts(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """The latest row of each key of a stream of changes."""
    from evidara.operators.search import latest

    return latest(drained(spark, stream, name), keys, order)


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes") -> DataFrame:
    """(user, session_start, session_end, n): runs of events with no pause of ``gap``."""
    grouped = events.groupBy(user, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
