"""Runs and their saved state: differences of settings, stages, versions, totals, the pool of resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import scalars
from evidara.operators import pipeline

#: Stages in the order they run.
STAGES = ("keywords", "search", "extraction")


def changed_settings(saved: DataFrame, live: DataFrame, keys: Sequence[str], column: str, stage: str) -> DataFrame:
    """(keys, path, saved, live, warning): settings that differ; those of the running stage do so on purpose, any other
    comes with a warning."""
    diff = pipeline.map_diff(saved, live, keys, column)
    shown = lambda c: F.coalesce(F.col(c), F.lit("unset"))
    text = F.format_string("Config mismatch at '%s': saved=%s, live=%s", "path", shown("saved"), shown("live"))
    return diff.withColumn("warning", F.when(~F.col("path").startswith(f"stage.{stage}"), text))


def stage_reached(present: dict[str, Column]) -> Column:
    """The furthest stage that a saved run holds, 'none' if it holds none."""
    out = F.lit("none")
    for stage in STAGES:
        if stage in present:
            out = F.when(present[stage], stage).otherwise(out)
    return out


def resume_at(stages: Sequence[str], completed: Column) -> Column:
    """The number of the stage after a completed one; 0 for one that isn't known."""
    return F.array_position(F.array(*[F.lit(s) for s in stages]), completed).cast("int")


def is_breaking(old: Column, new: Column) -> Column:
    """Whether (major, minor, patch) changed so that saved runs can't be read: the major number, or before 1.0 the minor."""
    return (old["major"] != new["major"]) | ((old["major"] == 0) & (old["minor"] != new["minor"]))


def run_totals(mentions: DataFrame, kind: str, name: str, doc: str, pairs: DataFrame, accepted: str) -> DataFrame:
    """One row (documents, entities, mentions, pairs, accepted) on a run."""
    m = mentions.agg(F.countDistinct(doc).alias("documents"), F.countDistinct(F.struct(kind, name)).alias("entities"), F.count(F.lit(1)).alias("mentions"))
    p = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.coalesce(F.col(accepted), F.lit(False))).alias("accepted"))
    return m.join(p)  # one row each


def sweep_totals(found: DataFrame, kind: str) -> DataFrame:
    """(kind, co_mentions, documents): what a sweep found by kind."""
    return found.groupBy(kind).agg(F.count(F.lit(1)).alias("co_mentions"), F.countDistinct("doc_id").alias("documents"))


def empty_result(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of a run that was given up: right columns, no rows."""
    kinds = {"mentions": "doc_id string, kind string, name string", "pairs": "e1 string, e2 string, accepted boolean", "resources": "doc_id string, url string"}
    return {name: spark.createDataFrame([], schema) for name, schema in kinds.items()}


def pool_rows(pool: DataFrame, doc: str) -> DataFrame:
    """Adds ``number``, the counter an id begins with, and ``implied``: whether the id is what its place and URL make it, so
    that it needn't be saved. Places are counted over range partitions."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    numbered = pool.withColumn("number", F.split_part(F.col(doc), F.lit("_"), F.lit(1)).cast("long")).withColumn("__all", F.lit(0))
    placed = running_sum(numbered, Scratch(pool.sparkSession, "pool"), ["__all"], ["number", doc], None, "__place").drop("__all")
    implied = F.col(doc) == scalars.resource_id(F.col("__place") + 1, F.col("url"))
    return placed.withColumn("implied", implied).drop("__place")


def saved_pool(pool: DataFrame, doc: str, optional: Sequence[str]) -> DataFrame:
    """(number, json): the rows of a pool as they are saved, in order of their numbers, without what is null or implied."""
    rows = pool_rows(pool, doc)
    row = F.struct(F.when(~F.col("implied"), F.col(doc)).alias("id"), F.col("url").alias("url"), *[F.col(c) for c in optional])
    return rows.select("number", F.to_json(row).alias("json")).orderBy("number")


def read_pool(json: Column, fields: str) -> Column:
    """The resources of a saved pool, a list or one under "resources", with ids made from place and URL where left out."""
    kind = f"array<struct<id:string,url:string,{fields}>>"
    listed = F.coalesce(F.from_json(json, f"struct<resources:{kind}>")["resources"], F.from_json(json, kind))
    return F.transform(listed, lambda r, i: r.withField("id", F.coalesce(r["id"], scalars.resource_id(i + 1, r["url"]))))
