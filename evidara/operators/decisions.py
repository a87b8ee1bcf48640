"""Recorded model decisions as tables: replay, hits and misses, merging into rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def input_key(*parts: Column) -> Column:
    """Identifies a decision by what was asked: the hash of its parts, whose order counts."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts]), {"ignoreNullFields": "false"}), 256)


def replay(asked: DataFrame, key: str, decisions: DataFrame, fallback: Column) -> DataFrame:
    """Adds ``decision`` and ``hit``: the recorded decision of each key, the last one recorded, else the fallback."""
    last = decisions.groupBy(F.col(key).alias("__k")).agg(F.max_by("decision", "event").alias("__d"))
    joined = asked.join(last, F.col(key) == F.col("__k"), "left")
    return joined.withColumn("hit", F.col("__k").isNotNull()).withColumn("decision", F.coalesce("__d", fallback)).drop("__k", "__d")


def hit_counts(replayed: DataFrame, *keys: str) -> DataFrame:
    return replayed.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


def per_subject(pairs: DataFrame, subject: str, verdicts: DataFrame) -> DataFrame:
    """One verdict for each distinct subject, given to all of its pairs; unjudged stays null."""
    return pairs.join(verdicts.select(F.col("subject").alias("__s"), F.col("belongs").alias("subject_trust")).dropDuplicates(["__s"]), F.col(subject) == F.col("__s"), "left").drop("__s")
