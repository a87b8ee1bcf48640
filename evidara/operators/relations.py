"""Relationship labels and pairs: polarities, consolidation, coverage, subjects, decisions, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.operators import entities


def ordered_labels(rows: DataFrame, label: str) -> DataFrame:
    """(label, n), the most frequent first, ties by label."""
    return rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label)


def unclassified(rows: DataFrame, label: str, rules: DataFrame, original: str) -> DataFrame:
    """(label): labels in use that no rule has classified yet."""
    return rows.select(label).where(F.col(label).isNotNull()).distinct().join(rules.select(F.col(original).alias(label)), label, "left_anti")


def polarities(rules: DataFrame, original: str, consolidated: str, polarity: str, order: str) -> DataFrame:
    """(label, polarity): what the last rule that names a label, as its source or its target, says of it."""
    named = F.array(F.struct(F.col(original).alias("label"), F.lit(0).alias("second")), F.struct(F.col(consolidated).alias("label"), F.lit(1).alias("second")))
    rows = rules.where(F.col(polarity).isNotNull()).select(F.explode(named).alias("x"), polarity, order).where("x.label IS NOT NULL")
    return rows.groupBy("x.label").agg(F.max_by(polarity, F.struct(F.col(order), F.col("x.second"))).alias("polarity"))


def with_polarity(labels: DataFrame, label: str, known: DataFrame) -> DataFrame:
    """Adds ``polarity``; labels no rule names are neutral."""
    return labels.join(known.select(F.col("label").alias("__l"), "polarity"), F.col(label) == F.col("__l"), "left").drop("__l").withColumn("polarity", F.coalesce("polarity", F.lit("neutral")))


def consolidated(rows: DataFrame, label: str, rules: DataFrame, original: str, target: str, order: str) -> DataFrame:
    """The rows with labels replaced by the target of the last rule for them, compared without regard to case and outer
    blanks; ``rewritten`` tells which changed."""
    key = lambda c: F.lower(F.trim(c))
    last = rules.where(F.col(target).isNotNull()).groupBy(key(F.col(original)).alias("__k")).agg(F.max_by(target, order).alias("__t"))
    joined = rows.join(last, key(F.col(label)) == F.col("__k"), "left")
    return joined.withColumn("rewritten", F.col("__t").isNotNull() & ~F.col(label).eqNullSafe(F.col("__t"))).withColumn(label, F.coalesce("__t", label)).drop("__k", "__t")


def without_pairs(rows: DataFrame, keys: Sequence[str], pairs: DataFrame) -> DataFrame:
    """Rows of other pairs."""
    return rows.join(pairs.select(*keys).distinct(), list(keys), "left_anti")


def open_irrelevant(rows: DataFrame, keys: Sequence[str], polarity: str, judged: DataFrame) -> DataFrame:
    """(keys): pairs not judged yet all of whose rows are irrelevant."""
    rest = without_pairs(rows, keys, judged)
    return rest.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(polarity) == "irrelevant", F.lit(False))).alias("__all")).where("__all").select(*keys)


def co_mention_kind(found: DataFrame, keys: Sequence[str], pos1: str, pos2: str, spans: DataFrame) -> DataFrame:
    """Adds ``kind``: 'no_existing_assessment' where the document has no row for the pair, 'covered' where both positions
    lie in one quoted span of it, else 'uncovered_region'. ``spans`` has the keys, s and e, one row a span."""
    listed = spans.groupBy(*keys).agg(F.collect_set(F.struct("s", "e")).alias("__s"))
    inside = F.exists("__s", lambda x: (x["s"] <= F.col(pos1)) & (F.col(pos1) <= x["e"]) & (x["s"] <= F.col(pos2)) & (F.col(pos2) <= x["e"]))
    kind = F.when(F.col("__s").isNull(), "no_existing_assessment").when(inside, "covered").otherwise("uncovered_region")
    return found.join(listed, list(keys), "left").withColumn("kind", kind).drop("__s")


def subject_of(kind1: Column, name1: Column, kind2: Column, name2: Column, subject: str) -> Column:
    """The first end of the subject's kind, null if neither is."""
    return F.when(kind1 == subject, name1).when(kind2 == subject, name2)


def reasoning(rows: DataFrame, keys: Sequence[str], label: str, doc: str) -> DataFrame:
    """(keys, label, documents): for each label of a pair its distinct documents in order, joined by commas."""
    return rows.groupBy(*keys, label).agg(F.array_join(F.array_sort(F.collect_set(F.col(doc).cast("string"))), ", ").alias("documents"))


def document_pairs(rows: DataFrame, doc: str, end1: str, end2: str, label: str, quotes: str) -> DataFrame:
    """(doc, first, second, labels, quotes): one row for each pair of a document, whichever end came first, with the
    labels proposed for it and all of its quotes, sorted."""
    first, second = F.least(end1, end2), F.greatest(end1, end2)
    return rows.groupBy(doc, first.alias("first"), second.alias("second")).agg(F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.flatten(F.collect_list(quotes))).alias("quotes"))


def tokens_overlap(tokens1: Column, norms1: Column, tokens2: Column, norms2: Column) -> Column:
    """Whether two entities share enough: half of the smaller one's tokens, at least one, among tokens or known forms."""
    across = F.size(F.array_intersect(tokens1, norms2)) + F.size(F.array_intersect(tokens2, norms1))
    needed = F.greatest(F.lit(1), F.floor(F.least(F.size(tokens1), F.size(tokens2)) / 2))
    return F.greatest(across, F.size(F.array_intersect(tokens1, tokens2))) >= needed


def decided_pairs(decisions: DataFrame, number: str, token: str, pairs: DataFrame) -> DataFrame:
    """Adds ``pair``: the pair a decision means, found by its number and by its token; where they disagree the token
    counts. Decisions that match neither are left out."""
    by_number = pairs.select(F.col("number").alias("__n"), F.col("pair").alias("__a")).dropDuplicates(["__n"])
    by_token = pairs.select(F.col("token").alias("__t"), F.col("pair").alias("__b")).dropDuplicates(["__t"])
    joined = decisions.join(by_number, F.col(number) == F.col("__n"), "left").join(by_token, F.col(token) == F.col("__t"), "left")
    return joined.withColumn("pair", F.coalesce("__b", "__a")).withColumn("conflict", F.coalesce(F.col("__a") != F.col("__b"), F.lit(False))).where("pair IS NOT NULL").drop("__n", "__a", "__t", "__b")


def neighbour_pairs(edges: DataFrame, scope: str, anchor: str, near: str, similar: DataFrame) -> DataFrame:
    """(scope, a, b, similarity, anchors): pairs of neighbours of one anchor that are alike, with the number of anchors
    they share. The similar pairs, which are few, are looked up; no anchor's neighbours are paired with each other."""
    links = edges.select(F.col(scope).alias("scope"), F.col(anchor).alias("anchor"), F.col(near).alias("near")).distinct()
    x = links.select("scope", "anchor", F.col("near").alias("a")).join(similar.select("a", "b", "similarity"), "a")
    y = links.select("scope", "anchor", F.col("near").alias("b"))
    return x.join(y, ["scope", "anchor", "b"]).groupBy("scope", "a", "b").agg(F.max("similarity").alias("similarity"), F.count(F.lit(1)).alias("anchors"))


def neighbours_of_class(edges: DataFrame, scope: str, anchor: str, near: str, classes: DataFrame, kind: str) -> DataFrame:
    """(scope, a, b, similarity, anchors): as ``neighbour_pairs`` where neighbours are alike, by 1, if they have the same
    ``kind`` in ``classes`` (near, kind). Only neighbours of one anchor and class meet; the pairs of a class, which may be far
    more than its members, are never listed."""
    heads = classes.groupBy(kind).agg(F.min(near).alias("__h"))
    of = classes.join(heads, kind).groupBy(F.col(near).alias("near"), "__h").agg(F.count(F.lit(1)).alias("n"))
    links = edges.select(F.col(scope).alias("scope"), F.col(anchor).alias("anchor"), F.col(near).alias("near")).join(of, "near")
    keys = ["scope", "anchor", "__h"]
    x, y = (links.select(*keys, F.col("near").alias(c), F.col("n").alias(f"__{c}")) for c in "ab")
    met = x.join(y, keys).where("a < b").distinct()
    return met.groupBy("scope", "a", "b").agg(F.lit(1.0).alias("similarity"), F.sum(F.col("__a") * F.col("__b")).alias("anchors"))


def neighbour_groups(edges: DataFrame, scope: str, anchor: str, near: str, similar: DataFrame, threshold: float) -> DataFrame:
    """(entity, cluster): names that share an anchor and are alike by at least ``threshold``, linked in turn."""
    return entities.linked(neighbour_pairs(edges, scope, anchor, near, similar).where(F.col("similarity") >= threshold).select("a", "b").distinct())


def distinct_groups(groups: DataFrame, members: str, kind: str, similarity: str, order: str) -> DataFrame:
    """One row for each set of members and kind: that of greatest similarity, the first of equal ones."""
    row = F.struct(*[F.col(c) for c in groups.columns])
    best = groups.groupBy(F.array_sort(members).alias("__m"), F.col(kind).alias("__k")).agg(F.max_by(row, F.struct(F.col(similarity), -F.col(order))).alias("__r"))
    return best.select("__r.*")
