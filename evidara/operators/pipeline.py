"""Stages made of other operators: sweeping for co-mentions, consolidating names, judging pairs, chunks and vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import names
from evidara.operators import entities, evidence, islands
from evidara.plans.lineage import Scratch


def positions(mentions: DataFrame, doc: str, name: str, aliases: str, documents: DataFrame, text: str) -> DataFrame:
    """(doc, name, s, e): whole-word mentions, in normal form, of each document's own entities in its text."""
    forms = mentions.where(F.col(name).isNotNull()).groupBy(doc, name).agg(F.array_distinct(F.flatten(F.collect_set(F.coalesce(aliases, F.array().cast("array<string>"))))).alias("__a"))
    listed = forms.groupBy(doc).agg(F.collect_list(F.struct(F.col(name).alias("n"), F.concat(F.array(name), "__a").alias("f"))).alias("__l"))
    rows = listed.join(documents.where(F.col(text).isNotNull()).select(doc, F.col(text).alias("__t")), doc)
    kind = dict(rows.dtypes)[doc]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, listed, t in zip(b[doc], b["__l"], b["__t"], strict=True):
                out += [(d, *found) for found in names.mentions_in({x["n"]: [f for f in x["f"] if f] for x in listed}, t)]
            yield pd.DataFrame(out, columns=[doc, name, "s", "e"])

    return rows.mapInPandas(find, f"{doc} {kind}, {name} string, s int, e int")


def sweep(found: DataFrame, doc: str, name: str, known: DataFrame, band: int) -> DataFrame:
    """(doc, first, second, pos1, pos2): entities mentioned within ``band`` characters whose pair the document has no row
    for yet in ``known`` (doc, first, second)."""
    near = islands.co_mentions(found.select(doc, name, "s").distinct(), doc, name, "s", band)
    return near.join(known.select(doc, "first", "second").distinct(), [doc, "first", "second"], "left_anti")


def consolidate(mentions: DataFrame, name: str, aliases: str, threshold: float) -> DataFrame:
    """(name, target): contested and fuzzy names merged into the one with most mentions.

    Pairs from both phases are linked, and so is what they link in turn, whatever ``threshold`` is; groups are named by
    their most frequent member, ties by the smaller name.
    """
    counts = mentions.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    shared = entities.contested_forms(mentions, name, aliases).select(F.explode("canonicals").alias("b"), F.element_at("canonicals", 1).alias("a")).where("a <> b")
    scratch = Scratch(mentions.sparkSession, "consolidate")
    counts = scratch.save(counts)
    norm = scratch.save(counts.select("name", names.comparable_of(F.col("name")).alias("f")))
    close = entities.fuzzy_pairs(norm, "f")
    x, y = norm.select(F.col("name").alias("a"), F.col("f").alias("fa")), norm.select(F.col("name").alias("b"), F.col("f").alias("fb"))
    fuzzy = close.select(F.col("a").alias("fa"), F.col("b").alias("fb")).join(x, "fa").join(y, "fb").select("b", "a")
    pairs = shared.unionByName(fuzzy).select("a", "b")
    groups = entities.linked(pairs)
    sized = groups.join(counts, groups["entity"] == counts["name"]).select("cluster", "entity", "n")
    best = sized.groupBy("cluster").agg(F.min_by("entity", F.struct(-F.col("n"), F.col("entity"))).alias("target"))
    return sized.join(best, "cluster").where("entity <> target").select(F.col("entity").alias("name"), "target")


def judge(rows: DataFrame, keys: Sequence[str], overall: str, label: str, relevance: str, order: str, opposed: DataFrame, strong: int = 7) -> DataFrame:
    """(keys, accepted, label, confidence, relevance): pairs with two or more strong rows of labels that aren't opposed are
    accepted with the most common label; any other by its median grade.

    Relevance is the lower median of the strong rows, or of all where there are none.
    """
    best = evidence.strong_labels(rows, keys, overall, label, order, strong).withColumnRenamed(label, "__label")
    clash = evidence.contentious(rows.where(F.col(overall) >= strong).withColumn("__p", F.lit("neutral")), keys, "__p", label, opposed)
    every = rows.groupBy(*keys).agg(evidence.median_low(overall).alias("__m"), evidence.median_low(relevance).alias("__r"))
    high = rows.where(F.col(overall) >= strong).groupBy(*keys).agg(evidence.median_low(relevance).alias("__h"))
    common = evidence.first_mode(rows, keys, label, order)
    out = every.join(common, list(keys), "left").join(high, list(keys), "left").join(best, list(keys), "left").join(clash, list(keys), "left")
    sure = F.col("strong").isNotNull() & ~F.coalesce("contentious", F.lit(False))
    confidence = F.when(sure & (F.col("strong") >= 3), 0.95).when(sure, 0.85).otherwise(0.5)
    return out.select(*keys, F.when(sure, True).otherwise(F.col("__m") >= 5).alias("accepted"), F.when(sure, F.col("__label")).otherwise(F.col(label)).alias(label), confidence.alias("confidence"), F.coalesce("__h", "__r").alias("relevance"))


def chunk_places(chunks: Column, text: Column) -> Column:
    """array of (start, end) of chunk texts found one after the other in a text; one that isn't found is left out."""
    kind = "struct<pos:int,spans:array<struct<start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(kind)

    def step(acc: Column, c: Column) -> Column:
        at = F.call_function("locate", c, text, acc["pos"] + 1)
        span = F.array(F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(c)).cast("int").alias("end")))
        hit = (at > 0) & (F.length(c) > 0)
        return F.struct(F.when(hit, (at - 1 + F.length(c)).cast("int")).otherwise(acc["pos"]).alias("pos"), F.when(hit, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(kind)

    return F.aggregate(chunks, start, step)["spans"]


def weighted_mean(vectors: DataFrame, keys: Sequence[str], vector: str, weight: Column) -> DataFrame:
    """(keys, vector): the weighted mean of vectors of one length, by dimension, with partial sums before the shuffle."""
    parts = vectors.select(*keys, weight.cast("double").alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    sums = parts.groupBy(*keys, "__i").agg((F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")).alias("__v"))
    listed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__l"))
    return listed.select(*keys, F.transform("__l", lambda x: x["__v"]).alias(vector))


def position_weight(position: Column, count: Column, length: Column, longest: Column) -> Column:
    """1.5 in the first and last fifth, at least one place each, else 1, times the share of the greatest length."""
    fifth = F.greatest(F.lit(1), F.floor(count / 5))
    edge = (position < fifth) | (position >= count - fifth)
    return F.when(edge, 1.5).otherwise(1.0) * length / longest


def map_diff(saved: DataFrame, live: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, path, saved, live): entries of two maps that differ; a missing one is null."""
    a = saved.select(*keys, F.explode(column).alias("path", "saved"))
    b = live.select(*keys, F.explode(column).alias("path", "live"))
    both = a.join(b, [*keys, "path"], "full_outer")
    return both.where(~F.col("saved").eqNullSafe(F.col("live")))


def co_located(quotes: DataFrame, doc: str, name: str, start: str, end: str, gap: int) -> DataFrame:
    """(doc, first, second): entities whose quotes fall into one run of spans."""
    sets = islands.proximal_sets(quotes, doc, name, start, end, gap)
    pairs = F.flatten(F.transform("entities", lambda x: F.transform(F.filter("entities", lambda y: y > x), lambda y: F.struct(x.alias("first"), y.alias("second")))))
    return sets.select(doc, F.explode(pairs).alias("p")).select(doc, "p.first", "p.second").distinct()


def permitted(pairs: DataFrame, first: str, second: str, kinds: DataFrame, allowed: Column) -> DataFrame:
    """Pairs whose kinds may pair by ``allowed`` (see ``scalars.permitted_kinds``); ``kinds`` is (canonical, kind)."""
    a, b = (kinds.select(F.col("canonical").alias(f"__{x}"), F.col("kind").alias(f"__k{x}")) for x in "ab")
    both = pairs.join(a, F.col(first) == F.col("__a")).join(b, F.col(second) == F.col("__b"))
    return both.where(F.array_contains(F.coalesce(F.try_element_at(allowed, F.col("__ka")), F.array().cast("array<string>")), F.col("__kb"))).select(*pairs.columns)
