"""What reports need beside the pair table: reranking, usage, citations, opposed labels, passages rewritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import names, scalars
from evidara.operators import entities, evidence


def reranked(rows: DataFrame, keys: Sequence[str], score: str, tie: str, most: int) -> DataFrame:
    """The ``most`` rows of each key of greatest model score, as a probability; 0 keeps all in order. The limit is applied
    within partitions first."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    probable = rows.withColumn("probability", 1.0 / (1.0 + F.exp(-F.col(score))))
    if not most:
        return probable
    return probable.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def usage(calls: DataFrame, stage: str, agent: str, model: str, tokens: str) -> DataFrame:
    """(stage, agent, model, tokens, calls) with subtotals: null model, agent and stage stand for all."""
    total = calls.rollup(stage, agent, model).agg(F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.grouping_id().alias("level"))
    return total.select(stage, agent, model, "tokens", "calls", "level")


def cited(texts: DataFrame, key: str, text: str, pool: DataFrame, doc: str) -> DataFrame:
    """(key, doc, known): the documents each text cites and whether the pool has them."""
    ids = texts.select(key, F.explode(scalars.citation_ids(F.col(text))).alias(doc))
    return ids.join(pool.select(doc).distinct().withColumn("__known", F.lit(True)), doc, "left").select(key, doc, F.coalesce("__known", F.lit(False)).alias("known"))


def opposition(rules: DataFrame, label: str, opposites: str) -> DataFrame:
    """(a, b) in both directions: labels and their opposites, each resolved to a known label by equal normal form or, that
    failing, the closest match."""
    known = rules.select(F.col(label).alias("known")).where("known IS NOT NULL").distinct().withColumn("f", names.comparable_of(F.col("known")))
    wanted = rules.select(F.col(label).alias("a"), F.explode(opposites).alias("o")).where("o IS NOT NULL").distinct().withColumn("f", names.comparable_of(F.col("o")))
    exact = wanted.join(known.groupBy("f").agg(F.min("known").alias("b")), "f").select("a", "o", "b")
    open_ = wanted.join(exact.select("o").distinct(), "o", "left_anti")
    far = entities.fuzzy_between(known.select(F.col("f")), open_.select(F.col("f")))
    near = far.join(known.select(F.col("f").alias("x"), "known"), "x").join(open_.select("a", "o", F.col("f").alias("y")), "y")
    best = near.groupBy("a", "o").agg(F.min_by("known", F.struct("distance", "known")).alias("b"))
    return evidence.symmetric(exact.unionByName(best).where("a <> b"), "a", "b")


def document_groups(rows: DataFrame, keys: Sequence[str], doc: str, label: str, order: str) -> DataFrame:
    """(keys, doc, labels, rows): a pair's rows by document, with their labels in order and without repeats."""
    listed = rows.groupBy(*keys, doc, label).agg(F.min(order).alias("__o"), F.count(F.lit(1)).alias("__n"))
    grouped = listed.groupBy(*keys, doc).agg(F.array_sort(F.collect_list(F.struct("__o", F.col(label).alias("l")))).alias("__l"), F.sum("__n").alias("n"))
    return grouped.select(*keys, doc, F.transform("__l", lambda x: x["l"]).alias("labels"), "n")


def previously_failed(urls: DataFrame, url: str, hops: DataFrame, failures: DataFrame, most: int = 3) -> DataFrame:
    """URLs that, themselves or up to ``most`` redirects on, have a recorded failure that isn't of the environment."""
    real = failures.where(~F.col("reason").rlike("browsers are not installed|Executable doesn't exist|browserType.launch")).select(F.col("url").alias("__bad")).distinct()
    now = urls.select(F.col(url).alias("url")).distinct().withColumn("at", F.col("url"))
    reached = now
    for _ in range(most):
        now = now.join(hops.select(F.col("url").alias("at"), "target"), "at").select("url", F.col("target").alias("at"))
        reached = reached.unionByName(now)
    return reached.join(real, F.col("at") == F.col("__bad"), "left_semi").select("url").distinct()


def relocated(spans: DataFrame, old: str, new: str, start: str, end: str) -> DataFrame:
    """Adds ``new_start`` and ``new_end``: where the text of a span stands in the replacement; null if it is gone."""
    piece = F.substring(F.col(old), F.col(start) + 1, F.col(end) - F.col(start))
    at = F.nullif(F.instr(F.col(new), piece), F.lit(0)) - 1
    return spans.withColumn("new_start", at).withColumn("new_end", at + F.col(end) - F.col(start))


def overlapping_quotes(quotes: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, merged): neighbouring quotes that overlap collapse into the longest of them."""
    from evidara.operators import islands

    runs = islands.islands(quotes, keys, start, end, -1).groupBy(*keys, "island")
    best = runs.agg(F.max_by(F.struct(start, end), F.struct(F.col(end) - F.col(start), -F.col(start))).alias("b"), F.count(F.lit(1)).alias("merged"))
    return best.select(*keys, F.col(f"b.{start}").alias(start), F.col(f"b.{end}").alias(end), "merged")


def version(text: Column) -> Column:
    """(run, major, minor, patch, hash) of '12v1.2.3#abc'; null if it is none."""
    pattern = r"^(\d+)?v(\d+)\.(\d+)\.(\d+)(?:#(.+))?$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    number = lambda k: part(k).try_cast("int")
    return F.when(text.rlike(pattern), F.struct(number(1).alias("run"), number(2).alias("major"), number(3).alias("minor"), number(4).alias("patch"), part(5).alias("hash")))


def stage_events(tables: dict[str, DataFrame], order: str) -> DataFrame:
    """(stage, place, description): an event log rebuilt from stage tables (order, description), each stage closed by a
    boundary. Places are numbered within a stage over range partitions."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    rows = None
    for k, (stage, t) in enumerate(tables.items()):
        part = t.select(F.lit(k).alias("number"), F.lit(stage).alias("stage"), F.col(order).cast("long").alias("o"), "description")
        part = part.unionByName(t.sparkSession.createDataFrame([(k, stage, (1 << 62), "end of stage")], "number int, stage string, o long, description string"))
        rows = part if rows is None else rows.unionByName(part)
    placed = running_sum(rows, Scratch(rows.sparkSession, "stages"), ["stage"], ["o", "description"], None, "place")
    return placed.select("stage", "place", "description")
