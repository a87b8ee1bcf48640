"""Problem 2: records that differ only in the way they are written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.llm.skew import join_hot
from evidara.plans.lineage import Scratch


def canonical(text: Column) -> Column:
    """The letters and digits, without regard to case; null becomes the empty text."""
    # The removal stands between the two conversions, for the optimizer drops an upper directly under a lower.
    return F.lower(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", ""))


def format_groups(records: DataFrame, id_col: str, exact: Sequence[str], written: Sequence[str], bags: Sequence[str]) -> DataFrame:
    """(id, first_id, copies): the smallest id of each record's group and the group's size.

    Every distinct field value is canonicalised once and given an integer; a record becomes the sorted tuple of its
    (field, integer) pairs and equal tuples are one group. ``exact`` columns are compared as they are, ``written`` ones
    by letters and digits, ``bags`` as unordered lists with repeats of such.

    A null exact value equals another null only; a null written value equals an empty one, a null bag an empty bag; a
    null or punctuation-only element of a bag counts as an empty element. Rows with a null id are left out. Rows
    that share an id are one record holding the values of all. An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(records.sparkSession, "format")
    fields = [*exact, *written, *bags]

    def pair(name: str, value: Column) -> Column:
        return F.struct(F.lit(fields.index(name)).alias("field"), value.alias("raw"))

    def bag(name: str) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(values, lambda v: pair(name, F.coalesce(v, F.lit(""))))

    singles = F.array(*[pair(c, F.col(c).cast("string")) for c in exact], *[pair(c, F.coalesce(F.col(c), F.lit(""))) for c in written])
    lists = [bag(c) for c in bags]
    base = records.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(F.concat(singles, *lists)).alias("v")).select("id", "v.field", "v.raw")

    # The dictionary: distinct raw values, partly aggregated before the shuffle; each canonicalised once.
    is_exact = F.col("field") < len(exact)
    family = F.when(is_exact, F.col("field")).otherwise(-1)
    base = base.withColumn("family", family)
    raws = base.groupBy("family", "raw").agg(F.count(F.lit(1)).alias("n"))
    forms = F.when(F.col("family") < 0, canonical(F.col("raw"))).otherwise(F.col("raw"))
    raws = scratch.save(raws.withColumn("form", forms))
    codes = scratch.save(raws.groupBy("family", "form").agg(F.sum("n").alias("n")).withColumn("code", F.monotonically_increasing_id()))
    total = codes.agg(F.sum("n")).first()[0] or 0
    words = scratch.save(join_hot(raws, codes, [("family", "family"), ("form", "form")], "code", "n", total).select("family", "raw", "code", "n"))
    scratch.drop(raws, codes)

    # One kind or name may stand in most records; its code is broadcast.
    coded = join_hot(base, words, [("family", "family"), ("raw", "raw")], "code", "n", total)
    tuples = coded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("field", "code"))).alias("tuple"))
    tuples = scratch.save(tuples)
    first = tuples.groupBy("tuple").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return tuples.join(first, "tuple").select(F.col("id").alias(id_col), "first_id", "copies")


def collapse(records: DataFrame, id_col: str, exact: Sequence[str], written: Sequence[str], bags: Sequence[str]) -> DataFrame:
    """The first record of each group with ``copies``, the number of records it stands for."""
    groups = format_groups(records, id_col, exact, written, bags).where(F.col(id_col) == F.col("first_id"))
    groups = groups.select(F.col("first_id").alias("__id"), F.col("copies").alias("copies"))
    kept = records.select(id_col, *exact, *written, *bags)
    return kept.join(groups, kept[id_col] == groups["__id"]).drop("__id")
