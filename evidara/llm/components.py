"""Problem 1: one group for all names linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidara.llm.skew import join_hot
from evidara.plans.lineage import Scratch


def group_linked(pairs: DataFrame, scope: str, left: str, right: str) -> DataFrame:
    """(scope, entity_name, group_name) for every name with a link; group_name is the smallest name in binary order.

    Minimum labels move along the edges and pointers are jumped, each round is written to the shared folder, and edges
    are rewritten to labels and thinned, so later rounds read ever fewer rows. Node ids follow the names' binary order,
    which makes the smallest id the smallest name.

    A pair with a null end, or of a name with itself, links nothing. Repeated pairs, circles and ties don't matter. A
    null scope is a scope of its own. An empty string is a name. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(pairs.sparkSession, "linked")
    a, b = F.col(left), F.col(right)
    links = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.col(scope).alias("scope"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    links = scratch.save(links)
    names = links.select("scope", F.explode(F.array("a", "b")).alias("name")).groupBy("scope", "name").agg(F.count(F.lit(1)).alias("n"))
    nodes = scratch.save(names.orderBy("scope", "name").withColumn("id", F.monotonically_increasing_id()))
    edges, total = links, 2 * links.count()
    for end, to in (("a", "u"), ("b", "v")):
        edges = join_hot(edges, nodes.withColumnRenamed("id", to), [("scope", "scope"), (end, "name")], to, "n", total)
    edges = scratch.save(edges.select("u", "v"))
    scratch.drop(links)

    jumps = []
    while not edges.isEmpty():
        # The smallest label next to each node, partly aggregated before the shuffle, so hubs cost one row a task.
        ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("near")), F.struct(F.col("v").alias("id"), F.col("u").alias("near")))
        near = edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.min("e.near").alias("near"), F.count(F.lit(1)).alias("n"))
        hook = scratch.save(near.select("id", F.least("id", "near").alias("to"), "n"))
        total = 2 * edges.count()
        # Many nodes may hook onto one; where it hooks on is asked once for each target.
        targets = hook.groupBy(F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("m")).join(hook.select(F.col("id").alias("target"), F.col("to").alias("top")), "target")
        jump = scratch.save(join_hot(hook, targets, [("to", "target")], "top", "m", total).select("id", F.col("top").alias("to"), "n"))
        jumps.append(jump)
        moved = edges
        for end, to in (("u", "x"), ("v", "y")):
            moved = join_hot(moved, jump.withColumnRenamed("to", to), [(end, "id")], to, "n", total)
        last, edges = edges, scratch.save(moved.where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        scratch.drop(last, hook)

    label = nodes.select("scope", F.col("name").alias("entity_name"), F.col("id").alias("label"))
    for jump in jumps:
        label = label.join(jump.select(F.col("id").alias("label"), "to"), "label", "left").select("scope", "entity_name", F.coalesce("to", "label").alias("label"))
    heads = nodes.select(F.col("id").alias("label"), F.col("name").alias("group_name"))
    return label.join(heads, "label").select(F.col("scope").alias(scope), "entity_name", "group_name")
