"""Evidence for pairs: aggregation over documents, polarity spread, ranking, filters and totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Polarities in their order of display.
POLARITIES = ("positive", "negative", "neutral", "irrelevant")
#: The factors of an evidence grade and what they are without any assessment.
FACTORS = {"directness": "tangential", "source_type": "other", "specificity": "vague", "language": "speculative"}


def median_low(value: str) -> Column:
    """The lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def first_mode(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """(keys, value): the most frequent value of each key; of equally frequent ones the one that came first, of
    equally early ones the greatest.

    Two aggregations, both partly done before the shuffle; no key's rows are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("__n"), -F.col("__first"), F.col(value))).alias(value))


def aggregate_evidence(rows: DataFrame, keys: Sequence[str], overall: str, factors: Sequence[str], order: str) -> DataFrame:
    """(keys, overall, factors): the lower median of the grades and the first-seen mode of every factor."""
    out = rows.groupBy(*keys).agg(median_low(overall).alias(overall))
    for f in factors:
        out = out.join(first_mode(rows, keys, f, order), list(keys), "left")
    return out.select(*keys, overall, *[F.coalesce(F.col(f).cast("string"), F.lit(FACTORS[f])).alias(f) if f in FACTORS else f for f in factors])


def spread(rows: DataFrame, keys: Sequence[str], polarity: str, overall: str) -> DataFrame:
    """(keys, n and best grade of each polarity); a null or empty polarity counts as irrelevant, an unknown one raises."""
    named = F.when(F.coalesce(F.col(polarity), F.lit("")) == "", "irrelevant").otherwise(F.col(polarity))
    known = F.when(named.isin(*POLARITIES), named).otherwise(F.raise_error(F.concat(F.lit("no such polarity: "), named)))
    p = rows.withColumn("__p", known)
    counts = [F.count_if(F.col("__p") == x).alias(f"n_{x}") for x in POLARITIES]
    best = [F.coalesce(F.max(F.when(F.col("__p") == x, F.col(overall))), F.lit(0)).alias(f"best_{x}") for x in POLARITIES]
    return p.groupBy(*keys).agg(*counts, *best)


def all_irrelevant(rows: DataFrame, keys: Sequence[str], polarity: str) -> DataFrame:
    """Keys of which every row is irrelevant; a missing polarity is not."""
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col(polarity) == "irrelevant", F.lit(False))).alias("__all")).where("__all").select(*keys)


#: Distinct values up to which ranks are made in one task and sent to all.
FEW_VALUES = 100_000


def fractional_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the descending rank with ties averaged, without bringing all rows to one task.

    Distinct values and their counts are ranked instead of rows. Where they are few, which is checked, the ranks are
    broadcast; else counts before a value are summed over range partitions.
    """
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    scratch = Scratch(rows.sparkSession, "ranks")
    counts = scratch.save(rows.groupBy(value).agg(F.count(F.lit(1)).alias("__n")).withColumn("__down", -F.col(value)).withColumn("__all", F.lit(0)))
    few = counts.count() <= FEW_VALUES
    if few:
        w = Window.orderBy(F.col("__down").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    else:
        before = running_sum(counts, scratch, ["__all"], ["__down"], "__n", "__before")
    ranks = before.select(F.col(value).alias("__v"), (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(out))
    return rows.join(F.broadcast(ranks) if few else ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def rank_sum(rows: DataFrame, values: Sequence[str], out: str) -> DataFrame:
    """Adds the sum of the fractional ranks of ``values``; the lower, the better. The rows are written once, as every rank
    reads them."""
    from evidara.plans.lineage import Scratch

    rows = Scratch(rows.sparkSession, "ranked").save(rows)
    for k, v in enumerate(values):
        rows = fractional_ranks(rows, v, f"__r{k}")
    total = sum((F.col(f"__r{k}") for k in range(1, len(values))), F.col("__r0"))
    return rows.withColumn(out, total).drop(*[f"__r{k}" for k in range(len(values))])


def recency_weight(year: Column, as_of_year: int) -> Column:
    """1 / (age + 1)^0.75, no age below 0; 0 without a year."""
    age = F.greatest(F.lit(as_of_year) - year, F.lit(0))
    return F.when(year.isNull(), 0.0).otherwise(1.0 / F.pow(age + 1, F.lit(0.75)))


def pair_entries(rows: DataFrame, keys: Sequence[str], doc: str, year: str, relevance: str, quoted: str, as_of_year: int, order: str) -> DataFrame:
    """(keys, doc_count, row_count, age_w, substantiated): one row a pair.

    age_w adds the recency weight of each document once; substantiated is the mean relevance of the three rows of largest
    relevance times saturation of the quoted length. A window limited to three rows keeps three a task and pair before
    the shuffle, so a hot pair is never gathered.
    """
    docs = rows.groupBy(*keys, doc).agg(F.max(year).alias("__y"), F.count(F.lit(1)).alias("__n")).groupBy(*keys)
    docs = docs.agg(F.count(F.lit(1)).alias("doc_count"), F.sum("__n").alias("row_count"), F.sum(recency_weight(F.col("__y"), as_of_year)).alias("age_w"))
    score = F.col(relevance) * (1.0 - F.exp(-F.col(quoted) / 200.0))
    w = Window.partitionBy(*keys).orderBy(score.desc(), F.col(order))
    best = rows.select(*keys, relevance, quoted, order).withColumn("__k", F.row_number().over(w)).where("__k <= 3")
    top = best.groupBy(*keys).agg(F.avg(F.col(relevance).cast("double")).alias("substantiated"))
    return docs.join(top, list(keys)).select(*keys, "doc_count", "row_count", "age_w", "substantiated")


def report_pairs(rows: DataFrame, keys: Sequence[str], doc: str, year: str, relevance: str, quoted: str, overall: str, polarity: str, label: str, as_of_year: int, order: str, opposed: DataFrame, accepted: DataFrame) -> DataFrame:
    """The whole entry of each pair with its ``place`` in the report: pair_entries, rows and best grade of each polarity,
    the median grade, whether it is contentious, and ``accepted`` (keys, accepted), null counting as not.

    Accepted pairs come first, then by weight of recent documents, grade and names. Places are counted over range
    partitions, not in one task.
    """
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    named = list(keys)
    full = pair_entries(rows, keys, doc, year, relevance, quoted, as_of_year, order).join(spread(rows, keys, polarity, overall), named)
    full = full.join(rows.groupBy(*keys).agg(median_low(overall).alias("overall")), named).join(contentious(rows, keys, polarity, label, opposed), named)
    full = full.join(accepted, named, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
    scratch = Scratch(rows.sparkSession, "report")
    sort = {"__1": (~F.col("accepted")).cast("int"), "__2": -F.round("age_w", 9), "__3": -F.col("overall"), "__4": F.lower(F.col(keys[0]).cast("string")), "__5": F.lower(F.col(keys[1]).cast("string"))}
    placed = running_sum(full.withColumns(sort).withColumn("__all", F.lit(0)), scratch, ["__all"], [*sort, *keys], None, "place")
    return placed.drop("__all", *sort)


def publication_year(date: Column) -> Column:
    """The year of a date in ISO form or compact form, from its first ten characters; null otherwise."""
    head = F.substring(date, 1, 10)
    return F.year(F.coalesce(F.try_to_date(head, "yyyy-MM-dd"), F.try_to_date(head, "yyyyMMdd")))


def contentious(rows: DataFrame, keys: Sequence[str], polarity: str, label: str, opposed: DataFrame) -> DataFrame:
    """(keys, contentious): whether a pair has positive and negative rows, or two labels that are opposed."""
    labels = rows.select(*keys, label, polarity).distinct()
    sides = labels.groupBy(*keys).agg((F.bool_or(F.col(polarity) == "positive") & F.bool_or(F.col(polarity) == "negative")).alias("__both"))
    a = labels.select(*keys, F.col(label).alias("__a")).distinct()
    b = labels.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(label).alias("__b")).distinct()
    edges = symmetric(opposed, "a", "b")
    clash = a.join(edges, F.col("__a") == F.col("a")).join(b, (F.col("b") == F.col("__b")) & _same(keys)).select(*keys).distinct().withColumn("__clash", F.lit(True))
    return sides.join(clash, list(keys), "left").select(*keys, F.coalesce(F.col("__both") | F.col("__clash"), F.col("__both"), F.col("__clash"), F.lit(False)).alias("contentious"))


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(k) == F.col(f"__{k}"))
    return out


def symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Each edge in both directions, once."""
    both = F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b)))
    return edges.select(F.explode(both).alias("e")).select(f"e.{a}", f"e.{b}").distinct()


def strong_labels(rows: DataFrame, keys: Sequence[str], overall: str, label: str, order: str, least: int = 7) -> DataFrame:
    """(keys, strong, label): for pairs with at least two strong rows, their number and the most common label."""
    strong = rows.where(F.col(overall) >= least)
    n = strong.groupBy(*keys).agg(F.count(F.lit(1)).alias("strong")).where("strong >= 2")
    return n.join(first_mode(strong, keys, label, order), list(keys))


def quality(row: Sequence[Column]) -> Column:
    """The sum of a paper's scores by dimension, null ones counting 0."""
    return sum((F.coalesce(c, F.lit(0)) for c in row[1:]), F.coalesce(row[0], F.lit(0)))


def listed(*parts: Column) -> Column:
    """Lists one after the other, a null list as empty."""
    return F.concat(*[F.coalesce(p, F.array()) for p in parts])


def totals(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """(kind, names, rows): distinct names and rows by kind."""
    return rows.groupBy(kind).agg(F.countDistinct(name).alias("names"), F.count(F.lit(1)).alias("n"))


def prune(facts: DataFrame, keep: Column, dimension: DataFrame, key: str) -> DataFrame:
    """The rows of ``dimension`` that some kept fact refers to."""
    return dimension.join(facts.where(keep).select(key).distinct(), key, "left_semi")
