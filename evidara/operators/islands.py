"""Intervals: islands, coverage, stabbing, point and overlap lookups, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0, out: str = "island") -> DataFrame:
    """Adds ``out``, the number (from 0) of the run of spans each one belongs to within its key.

    A span joins the run when it starts at most ``gap`` after the greatest end so far; spans are taken by start, the
    longer first. Keys are documents or the like, whose spans fit one task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(start), F.col(end).desc())
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0)
    flagged = spans.withColumn("__opens", opens)
    run = F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    return flagged.withColumn(out, run).drop("__opens")


def merged_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """(keys, island, start, end, spans): each run as one span."""
    runs = islands(spans, keys, start, end, gap)
    return runs.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("spans"))


def proximal_sets(mentions: DataFrame, doc: str, entity: str, start: str, end: str, threshold: int) -> DataFrame:
    """(doc, island, start, end, entities): runs of chunk ranges within ``threshold`` that hold at least two entities."""
    runs = islands(mentions, [doc], start, end, threshold).groupBy(doc, "island")
    sets = runs.agg(F.min(start).alias("start"), F.max(end).alias("end"), F.array_sort(F.collect_set(entity)).alias("entities"))
    return sets.where(F.size("entities") >= 2)


def regions(pairs: DataFrame, doc: str, start: str, end: str, first: str, second: str) -> DataFrame:
    """(doc, island, start, end, pairs): chunk ranges merged where they touch, with the distinct pairs of each."""
    runs = islands(pairs, [doc], start, end, 1).groupBy(doc, "island")
    return runs.agg(F.min(start).alias("start"), F.max(end).alias("end"), F.countDistinct(first, second).alias("pairs"))


def covered(position: Column, other: Column, spans: Column) -> Column:
    """Whether both positions lie in one span of an array of (s, e), ends included."""
    inside = lambda p: lambda x: (x["s"] <= p) & (p <= x["e"])
    return F.exists(spans, lambda x: inside(position)(x) & inside(other)(x))


def chunk_of(chunks: Column, position: Column) -> Column:
    """Number of the first chunk (start, end exclusive) holding a position; null if none does."""
    hits = F.filter(F.sequence(F.lit(0), F.size(chunks) - 1), lambda i: (F.element_at(chunks, i + 1)["start"] <= position) & (position < F.element_at(chunks, i + 1)["end"]))
    return F.when(F.size(chunks) > 0, F.try_element_at(hits, F.lit(1)))


def chunks_of(chunks: Column, start: Column, end: Column) -> Column:
    """Numbers of all chunks that overlap [start, end)."""
    hits = F.filter(F.sequence(F.lit(0), F.size(chunks) - 1), lambda i: (F.element_at(chunks, i + 1)["start"] < end) & (start < F.element_at(chunks, i + 1)["end"]))
    return F.when(F.size(chunks) > 0, hits).otherwise(F.array().cast("array<int>"))


def as_of(offsets: Column, position: Column) -> Column:
    """The last (pos, delta) entry at or before a position, added to it; the position itself before the first entry."""
    entry = F.try_element_at(F.filter(offsets, lambda x: x["pos"] <= position), F.lit(-1))
    return position + F.coalesce(entry["delta"], F.lit(0))


def within_budget(passages: DataFrame, keys: Sequence[str], order: Sequence[str], size: str, budget: Column) -> DataFrame:
    """The passages of each key in order until their sizes reach the budget; ``taken`` is how much of the last one fits."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(size).over(w), F.lit(0))
    rows = passages.withColumn("__used", used).withColumn("__budget", budget)
    return rows.where("__used < __budget").withColumn("taken", F.least(F.col(size), F.col("__budget") - F.col("__used"))).drop("__used", "__budget")


def co_mentions(positions: DataFrame, doc: str, entity: str, position: str, band: int, bucket: int | None = None) -> DataFrame:
    """(doc, first, second, pos1, pos2): mentions of two entities of one document at most ``band`` apart.

    The join is an equi-join on document and position bucket, so a long document spreads over many tasks and no pair
    beyond two neighbouring buckets is ever formed.
    """
    width = bucket or max(1, band)
    near = positions.select(F.col(doc), F.col(entity).alias("first"), F.col(position).alias("pos1"), F.explode(F.sequence(F.floor((F.col(position) - band) / width), F.floor((F.col(position) + band) / width))).alias("b"))
    other = positions.select(F.col(doc), F.col(entity).alias("second"), F.col(position).alias("pos2"), F.floor(F.col(position) / width).alias("b"))
    met = near.join(other, [doc, "b"]).where((F.col("first") < F.col("second")) & (F.abs(F.col("pos1") - F.col("pos2")) <= band))
    return met.select(doc, "first", "second", "pos1", "pos2")


def longest_first(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Non-overlapping spans, taken by start and then length: a span is kept if it starts after all kept ones ended.

    Greedy choice depends on what was kept before, so each key's spans (one document's) are folded in one expression.
    """
    item = F.struct(F.col(start).alias("s"), (-F.col(end)).alias("e"))
    listed = spans.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("__l"))
    kind = listed.schema["__l"].dataType.simpleString()
    keep = F.aggregate("__l", F.array().cast(kind), lambda acc, x: F.when((F.size(acc) == 0) | (x["s"] >= -F.try_element_at(acc, F.lit(-1))["e"]), F.concat(acc, F.array(x))).otherwise(acc))
    return listed.select(*keys, F.explode(keep).alias("x")).select(*keys, F.col("x.s").alias(start), (-F.col("x.e")).alias(end))
