"""Entity resolution: variants, matching, merge rules, clusters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import linkage, names
from evidara.plans.lineage import Scratch

#: Endings that obvious variants exchange.
ENDINGS = ("s", "es", "ies", "y", "a", "um", "i", "us", "is", "on", "ices", "ex", "ix", "ise", "ize", "re", "er")

#: Names linked to each other are clustered in one task up to ALONE of them; up to TOGETHER, tasks are shared.
ALONE, TOGETHER = 50_000, 1000


def variant_map(entities: DataFrame, canonical: str, aliases: str) -> DataFrame:
    """(form, canonical, speculation, origin): normal forms claimed by one entity only, at their least speculation."""
    forms = _forms(entities, canonical, aliases)
    owners = forms.groupBy("form").agg(F.countDistinct("canonical").alias("n")).where("n = 1").select("form")
    best = forms.groupBy("form", "canonical").agg(F.min(F.struct("speculation", "origin")).alias("b"))
    return best.join(owners, "form", "left_semi").select("form", "canonical", "b.speculation", "b.origin")


def contested_forms(entities: DataFrame, canonical: str, aliases: str) -> DataFrame:
    """(form, canonicals): normal forms that several entities claim."""
    forms = _forms(entities, canonical, aliases)
    return forms.groupBy("form").agg(F.array_sort(F.collect_set("canonical")).alias("canonicals")).where(F.size("canonicals") > 1)


def _forms(entities: DataFrame, canonical: str, aliases: str) -> DataFrame:
    distinct = global_aliases(entities.where(F.col(canonical).isNotNull()), canonical, aliases).withColumnRenamed("aliases", "a")
    return distinct.select("canonical", F.explode(names.variants_of(F.col("canonical"), F.col("a"))).alias("v")).select("canonical", "v.form", "v.speculation", "v.origin")


def match_exact(queries: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """(name, canonical, speculation, origin): the entity of a name's normal form; the least speculation wins."""
    q = queries.select(F.col(name).alias("name")).distinct().withColumn("form", names.comparable_of(F.col("name")))
    hit = q.join(known, "form").groupBy("name").agg(F.min(F.struct("speculation", "canonical", "origin")).alias("b"))
    return hit.select("name", "b.canonical", "b.speculation", "b.origin")


def fuzzy_pairs(forms: DataFrame, form: str) -> DataFrame:
    """(a, b, distance, how): pairs of distinct normal forms that match without being equal, a < b.

    A match of forms of ten or more characters has at most 1 + n // 10 edits, and they are cut into one part more than
    that. A swap of neighbours across a cut damages two parts, so runs of parts are keys as well, with the two characters
    at each cut inside sorted: cuts that were swapped join parts to one run less each, and every other edit damages one
    run, so one run survives in the other form, shifted by no more than the edits left. An equi-join on (run, its
    numbers, length) finds every such pair. Shorter forms match only by obvious variation, which keeps the folded
    spelling up to an ending; they meet on the folded spelling without blanks and on what is left of it without an ending.
    """
    f = Scratch(forms.sparkSession, "forms").save(forms.select(F.col(form).alias("f")).where(F.length(form) > 0).distinct())
    pairs = _met(f, f).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.withColumn("m", names.match_of(F.col("a"), F.col("b"))).where("m.matched AND m.distance > 0").select("a", "b", "m.distance", "m.how")


def fuzzy_between(known: DataFrame, asked: DataFrame) -> DataFrame:
    """(x, y, distance, how): forms of ``known`` and forms of ``asked`` (one column f each) that match without being equal."""
    met = _met(known.where(F.length("f") > 0).distinct(), asked.where(F.length("f") > 0).distinct())
    return met.withColumn("m", names.match_of(F.col("x"), F.col("y"))).where("m.matched AND m.distance > 0").select("x", "y", "m.distance", "m.how")


def _met(f: DataFrame, asked: DataFrame) -> DataFrame:
    """(x, y): forms of ``f`` and of ``asked`` that could match without being equal (see ``fuzzy_pairs``)."""
    folded = F.replace(F.regexp_replace(F.regexp_replace(F.col("f"), "ae|oe", "e"), "our", "or"), F.lit(" "), F.lit(""))
    # What is left without each ending that obvious variants exchange.
    stems = F.filter(F.array(*[F.when(folded.endswith(e), F.regexp_replace(folded, e + "$", "")) for e in ENDINGS]), lambda x: x.isNotNull())
    n = F.length("f")
    i, j, m, p, w, d = (F.col(c) for c in "ijmpwd")

    def runs(forms: DataFrame) -> DataFrame:
        """Every run of parts from i to j of the p parts of width w that a form of length m has."""
        cut = forms.withColumn("p", 2 + F.floor(m / 10)).withColumn("w", F.floor(m / p))
        return cut.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), p - 1))).withColumn("j", F.explode(F.sequence(i, p - 1)))

    def run_key(t: Column) -> Column:
        """Part t of a run found at shift d, without what is next to cuts inside the run, and the sorted pair at its end."""
        end = F.when(t == p - 1, m).otherwise((t + 1) * w) + d
        low, high = t * w + d + F.when(t > i, 1).otherwise(0), end - F.when(t < j, 1).otherwise(0)
        x, y = (F.substring(F.col("f"), k.cast("int"), F.lit(1)) for k in (end, end + 1))
        return F.concat(F.substring(F.col("f"), (low + 1).cast("int"), (high - low).cast("int")), F.when(t < j, F.concat(F.least(x, y), F.greatest(x, y))).otherwise(""))

    def keys(found: DataFrame) -> DataFrame:
        part = F.array_join(F.transform(F.sequence(i, j), run_key), "")
        return found.select("f", (i * 1000 + j).cast("int").alias("k"), m.cast("int").alias("n"), part.alias("part"))

    here = keys(runs(f.where(n >= 10).withColumn("m", n)).withColumn("d", F.lit(0)))
    whole = F.transform(F.array_distinct(F.concat(F.array(folded), stems)), lambda c: F.struct(F.lit(-1).alias("k"), F.lit(0).alias("n"), c.alias("part")))
    spelled = lambda forms: forms.select("f", F.explode(whole).alias("x")).select("f", "x.*")
    keyed = here.unionByName(spelled(f))

    # The other side looks for each run of every length it could match, at every shift the edits allow.
    most = 1 + F.floor(n / 10) + 1
    lengths = F.sequence(F.greatest(n - most, F.lit(10)), n + most)
    place = runs(asked.where(n >= 8).withColumn("m", F.explode(lengths))).withColumn("left", most - (j - i)).where((F.col("left") >= 0) & (F.abs(m - n) <= F.col("left")))
    place = place.withColumn("d", F.explode(F.sequence(-F.col("left"), F.col("left"))))
    size = F.when(j == p - 1, m).otherwise((j + 1) * w) - i * w
    at = i * w + d
    shifted = keys(place.where((at >= 0) & (at + size <= n)))
    other = shifted.unionByName(spelled(asked)).distinct()
    met = keyed.select(F.col("f").alias("x"), "k", "n", "part").join(other.select(F.col("f").alias("y"), "k", "n", "part"), ["k", "n", "part"])
    # Common endings make most of what meets. A swap is two edits to Levenshtein, so a match of the first kind has at most
    # twice its edits; matches by obvious variation meet on the folded spelling and pass.
    short = F.least(F.length("x"), F.length("y"))
    edits = (1 + F.floor(short / 10)).cast("int")
    near = (F.abs(F.length("x") - F.length("y")) <= edits) & (F.call_function("levenshtein", F.col("x"), F.col("y"), 2 * edits) >= 0)
    return met.where((F.col("x") != F.col("y")) & ((F.col("k") < 0) | near)).select("x", "y").distinct()


def match(queries: DataFrame, name: str, known: DataFrame, least: float = 0.7) -> DataFrame:
    """(name, canonical, how, penalty): the entity each name means, one row for a name that has one.

    A name's own forms (see ``names.variants``) are sought among the known ones first; of several hits the least
    speculation wins. Failing that, the closest known form counts if it is near enough, ``least`` similar over the shorter
    of the two and at most one edit for each ten characters and one more, is no single edit unless an obvious variant, and
    stands out: the next best of any pair of forms is behind by twice what the best lacks of 1.
    """
    asked = queries.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct()
    empty = F.array().cast("array<string>")
    forms = asked.select("name", F.explode(names.variants_of(F.col("name"), empty)).alias("v")).select("name", "v.form", F.col("v.speculation").alias("s"))
    hits = forms.join(known.select("form", "canonical", "speculation"), "form")
    exact = hits.groupBy("name").agg(F.min(F.struct((F.col("s") + F.col("speculation")).alias("penalty"), "canonical")).alias("b")).select("name", "b.canonical", "b.penalty")
    rest = forms.join(exact.select("name"), "name", "left_anti")
    met = _met(known.select(F.col("form").alias("f")).distinct(), rest.select(F.col("form").alias("f")).distinct())
    short = F.least(F.length("x"), F.length("y"))
    scored = met.withColumn("m", names.match_of(F.col("x"), F.col("y"))).withColumn("sim", 1 - F.col("m.distance") / short)
    obvious = F.coalesce(F.col("m.how").isin("spelling", "plural", "spacing"), F.lit(False))
    near = scored.where((F.col("m.distance") <= 1 + F.floor(short / 10)) & (F.col("sim") >= least) & (obvious | (short >= 10) & (F.col("m.distance") > 1)))
    pairs = rest.join(near.select(F.col("y").alias("form"), F.col("x").alias("hit"), "sim"), "form").join(known.select(F.col("form").alias("hit"), "canonical", "speculation"), "hit")
    w = Window.partitionBy("name").orderBy(F.col("sim").desc(), "canonical", "form", "hit")
    two = pairs.select("name", "canonical", "form", "hit", "sim", (F.col("s") + F.col("speculation") + 1).alias("penalty")).withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    first = two.groupBy("name").agg(F.min_by(F.struct("canonical", "penalty", "sim"), "__k").alias("b"), F.max(F.when(F.col("__k") == 2, F.col("sim"))).alias("second"))
    clear = first.where(F.col("second").isNull() | (F.col("b.sim") - F.col("second") >= 2 * (1 - F.col("b.sim"))))
    return exact.select("name", "canonical", F.lit("exact").alias("how"), "penalty").unionByName(clear.select("name", "b.canonical", F.lit("fuzzy").alias("how"), "b.penalty"))


def trigger(penalty: Column, aliased: Column, source: Column, how: Column) -> Column:
    """What a merge was made for: 'penalty:source:how', with 'alias:' before the source of an alias."""
    return F.concat_ws(":", penalty.cast("string"), F.when(aliased, "alias"), source, how)


def resolved(rows: DataFrame, name: str, local: DataFrame, others: DataFrame) -> DataFrame:
    """Adds ``entity`` and ``scope``: the entity of a name among those of its document, else among all, else the bare name.
    ``local`` has doc_id, form and entity, ``others`` form and entity."""
    near = local.select("doc_id", F.col("form").alias("__f"), F.col("entity").alias("__l")).dropDuplicates(["doc_id", "__f"])
    far = others.select(F.col("form").alias("__g"), F.col("entity").alias("__o")).dropDuplicates(["__g"])
    joined = rows.join(near, (rows["doc_id"] == near["doc_id"]) & (F.col(name) == F.col("__f")), "left").drop(near["doc_id"]).join(far, F.col(name) == F.col("__g"), "left")
    scope = F.when(F.col("__l").isNotNull(), "local").when(F.col("__o").isNotNull(), "global").otherwise("bare")
    return joined.withColumn("entity", F.coalesce("__l", "__o", name)).withColumn("scope", scope).drop("__f", "__l", "__g", "__o")


def substring_pairs(forms: DataFrame, form: str) -> DataFrame:
    """(parent, child): a form that lies within another on word boundaries. Both meet on the parent's words: the child's
    runs of words are looked up, no all-pairs comparison is made."""
    f = forms.select(F.col(form).alias("f")).where(F.length(form) > 0).distinct()
    words = F.split("f", " ")
    n = F.size("words")
    runs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), n - i), lambda k: F.array_join(F.slice("words", i + 1, k), " "))))
    child = f.withColumn("words", words).select(F.col("f").alias("child"), F.explode(F.array_distinct(runs)).alias("parent")).where("child <> parent")
    return child.join(f.select(F.col("f").alias("parent")), "parent").select("parent", "child")


def latest_rules(rules: DataFrame, scope: str, source: str, target: str, order: Sequence[str]) -> DataFrame:
    """(scope, source, target): the last rule of every source; null targets and rules onto themselves are none."""
    valid = rules.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    return valid.groupBy(F.col(scope).alias("scope"), F.col(source).alias("source")).agg(F.max_by(target, F.struct(*order)).alias("target"))


def final_targets(rules: DataFrame, scope: str, source: str, target: str, order: Sequence[str]) -> DataFrame:
    """(scope, source, target): where the chain of latest rules ends. In a circle a name stays itself, and a name that
    leads into one becomes the first name of the circle it meets.

    Pointers double each round, so a chain of n rules takes log n joins. What is still moving after enough rounds for all
    names lies on circles, whose names are then held fixed.
    """
    scratch = Scratch(rules.sparkSession, "chains")
    step = scratch.save(latest_rules(rules, scope, source, target, order))

    def doubled(start: DataFrame, rounds: int | None) -> DataFrame:
        now, k = start, 0
        while rounds is None or k < rounds:
            up = now.select(F.col("scope").alias("s"), F.col("source").alias("target"), F.col("target").alias("next"))
            joined = now.join(up, F.col("scope").eqNullSafe(F.col("s")) & (now["target"] == up["target"]), "left").select("scope", "source", F.coalesce("next", now["target"]).alias("target"), F.col("next").isNotNull().alias("moved"))
            new = scratch.save(joined)
            if rounds is None and new.where(F.col("moved")).isEmpty():
                return new.drop("moved")
            now, k = new.drop("moved"), k + 1
        return now

    n = step.count()
    ends = doubled(step, max(1, n.bit_length()))
    again = step.select(F.col("scope").alias("s"), F.col("source").alias("name"))
    circle = ends.join(again, F.col("scope").eqNullSafe(F.col("s")) & (F.col("target") == F.col("name")), "left_semi").select("scope", F.col("target").alias("name")).distinct()
    circle = scratch.save(circle.select(F.col("scope").alias("s"), "name"))
    free = step.join(circle, F.col("scope").eqNullSafe(F.col("s")) & (F.col("source") == F.col("name")), "left_anti")
    out = doubled(scratch.save(free), None)
    return out.unionByName(circle.select(F.col("s").alias("scope"), F.col("name").alias("source"), F.col("name").alias("target")))


def apply_targets(mentions: DataFrame, kind: str, norm: str, name: str, targets: DataFrame) -> DataFrame:
    """Mentions with ``name`` replaced by the final target of their normal form, where there is one."""
    t = targets.select(F.col("scope").alias("__s"), F.col("source").alias("__n"), F.col("target").alias("__t"))
    joined = mentions.join(t, F.col(kind).eqNullSafe(F.col("__s")) & (F.col(norm) == F.col("__n")), "left")
    return joined.withColumn(name, F.coalesce("__t", name)).drop("__s", "__n", "__t")


def global_aliases(mentions: DataFrame, canonical: str, aliases: str) -> DataFrame:
    """(canonical, aliases): all aliases of an entity in all documents; distinct before they are gathered."""
    each = mentions.select(F.col(canonical).alias("canonical"), F.explode_outer(aliases).alias("alias")).distinct()
    return each.groupBy("canonical").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def first_kind(mentions: DataFrame, canonical: str, kind: str, order: str) -> DataFrame:
    return mentions.groupBy(F.col(canonical).alias("canonical")).agg(F.min_by(kind, order).alias("kind"))


def group_extractions(mentions: DataFrame, doc: str, name: str, kind: str, aliases: str, reasoning: str, order: str) -> DataFrame:
    """(doc, norm, name, kind, aliases, reasoning): the mentions of a document by normal name: the first name and kind, the
    aliases in order without repeats, the reasons joined by ' | '."""
    norm = names.comparable_of(F.trim(name))
    distinct = mentions.select(F.col(name)).distinct().withColumn("norm", norm)
    m = mentions.join(distinct, name)
    item = F.struct(order, F.col(aliases).alias("a"), F.col(reasoning).alias("r"))
    rows = m.groupBy(doc, "norm").agg(F.min_by(name, order).alias("name"), F.min_by(kind, order).alias("kind"), F.sort_array(F.collect_list(item)).alias("l"))
    listed = F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["a"], F.array().cast("array<string>")))))
    reasons = F.array_join(F.filter(F.transform("l", lambda x: x["r"]), lambda x: x.isNotNull()), " | ")
    return rows.select(doc, "norm", "name", "kind", listed.alias("aliases"), reasons.alias("reasoning"))


def best_form(forms: DataFrame, key: str, form: str) -> DataFrame:
    """(key, form): of equal names the one with both cases, then most capitals, then fewest small letters."""
    upper, lower = F.length(F.regexp_replace(form, r"[^\p{Lu}]", "")), F.length(F.regexp_replace(form, r"[^\p{Ll}]", ""))
    return forms.groupBy(key).agg(F.max_by(form, F.struct((upper * lower).alias("x"), upper.alias("u"), (-lower).alias("l"), F.col(form).alias("f"))).alias(form))


def specificity(tokens: DataFrame, entity: str, token: str, weight: Column) -> DataFrame:
    """(token, weight, specificity): ln((all + 1) / (own + 1)) of the token's weight, an entity counted at its greatest."""
    own = tokens.groupBy(entity, token).agg(F.max(weight).alias("w")).groupBy(token).agg(F.sum("w").alias("weight"))
    total = own.agg(F.sum("weight").alias("t")).first()["t"] or 0.0
    return own.select(token, "weight", F.log((F.lit(total) + 1) / (F.col("weight") + 1)).alias("specificity"))


def similar_entities(tokens: DataFrame, entity: str, token: str, spec: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b: the specificity of shared tokens over that of the entity with less, at least ``threshold``.

    Candidates share one of the rarest tokens of the lighter entity that together outweigh what may be missing, so tokens
    held by many entities seldom join. Both sides carry their few tokens along: a pair is made at the first token it
    shares only, and weighed there, so nothing but that one join is shuffled.
    """
    t = tokens.select(F.col(entity).alias("e"), F.col(token).alias("t")).distinct().join(spec.select(F.col(token).alias("t"), F.col("specificity").alias("s")), "t")
    sets = t.groupBy("e").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), "t"))).alias("l"), F.sum("s").alias("all"))
    # A token is needed if it and the lighter ones could make up the threshold without the heavier ones.
    rest = lambda i: F.aggregate(F.slice("l", i + 1, F.size("l")), F.lit(0.0), lambda w, x: w - x["n"])
    needed = F.transform(F.filter(F.transform("l", lambda x, i: F.struct(x["t"].alias("t"), (rest(i) >= threshold * F.col("all") - 1e-12).alias("ok"))), lambda x: x["ok"]), lambda x: x["t"])
    a = sets.select(F.col("e").alias("x"), F.col("all").alias("ax"), "l", needed.alias("p")).withColumn("t", F.explode("p"))
    b = sets.select(F.col("e").alias("y"), F.col("all").alias("ay"), F.transform("l", lambda x: x["t"]).alias("ts")).withColumn("t", F.explode("ts"))
    lighter = (F.col("ax") < F.col("ay")) | ((F.col("ax") == F.col("ay")) & (F.col("x") < F.col("y")))
    first = F.try_element_at(F.filter("p", lambda x: F.array_contains("ts", x)), F.lit(1)) == F.col("t")
    shared = F.aggregate("l", F.lit(0.0), lambda w, x: F.when(F.array_contains("ts", x["t"]), w - x["n"]).otherwise(w))
    pairs = a.join(b, "t").where((F.col("x") != F.col("y")) & lighter & first)
    sim = F.when(F.col("ax") > 0, shared / F.col("ax")).otherwise(0.0)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), sim.alias("similarity")).where(F.col("similarity") >= threshold)


def linked(pairs: DataFrame) -> DataFrame:
    """(entity, cluster): names of (a, b) linked directly or through others; a cluster is named by its smallest member.

    Minimum labels move along the edges, pointers are jumped, and edges are rewritten to labels until none is left.
    """
    scratch = Scratch(pairs.sparkSession, "names")
    edges = scratch.save(pairs.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    label = edges.select(F.explode(F.array("u", "v")).alias("entity")).distinct().withColumn("cluster", F.col("entity"))
    while not edges.isEmpty():
        ends = F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("near")), F.struct(F.col("v").alias("id"), F.col("u").alias("near")))
        hook = edges.select(F.explode(ends).alias("e")).groupBy("e.id").agg(F.min("e.near").alias("near")).select("id", F.least("id", "near").alias("to"))
        up = hook.select(F.col("id").alias("to"), F.col("to").alias("top"))
        jump = scratch.save(hook.join(up, "to").select("id", F.col("top").alias("to")))
        x, y = jump.select(F.col("id").alias("u"), F.col("to").alias("x")), jump.select(F.col("id").alias("v"), F.col("to").alias("y"))
        edges = scratch.save(edges.join(x, "u").join(y, "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        label = scratch.save(label.join(jump.select(F.col("id").alias("cluster"), "to"), "cluster", "left").select("entity", F.coalesce("to", "cluster").alias("cluster")))
    return label


def cluster(pairs: DataFrame, threshold: float) -> DataFrame:
    """(entity, cluster): average-linkage clusters of (a, b, similarity), unlisted pairs counting as 0, merged while two
    clusters are each other's nearest and at least ``threshold`` alike; a cluster is named by its smallest member.

    Every round merges all mutually nearest clusters at once, in the cluster: no component comes to one task. Ties are
    decided by the smaller names, so a round always merges the nearest pair of all. Similarities below the threshold
    count in averages and should be in ``pairs``.
    """
    scratch = Scratch(pairs.sparkSession, "cluster")
    edges = scratch.save(pairs.select("a", "b", F.col("similarity").alias("w")))
    sizes = scratch.save(edges.select(F.explode(F.array("a", "b")).alias("c")).distinct().withColumn("n", F.lit(1).cast("long")))
    member = scratch.save(sizes.select(F.col("c").alias("entity"), F.col("c").alias("cluster")))
    while True:
        na, nb = sizes.select(F.col("c").alias("a"), F.col("n").alias("na")), sizes.select(F.col("c").alias("b"), F.col("n").alias("nb"))
        alike = edges.join(na, "a").join(nb, "b").withColumn("s", F.col("w") / (F.col("na") * F.col("nb"))).where(F.col("s") >= threshold)
        ends = F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))
        near = alike.select("s", "a", "b", F.explode(ends).alias("x")).select("s", "a", "b", "x.*")
        nearest = near.groupBy("c").agg(F.min_by("o", F.struct((-F.col("s")).alias("s"), "a", "b")).alias("o"))
        mutual = nearest.alias("p").join(nearest.alias("q"), (F.col("p.o") == F.col("q.c")) & (F.col("q.o") == F.col("p.c"))).where("p.c > p.o")
        merges = scratch.save(mutual.select(F.col("p.c").alias("old"), F.col("p.o").alias("new")))
        if merges.isEmpty():
            return member

        def renamed(df: DataFrame, column: str, rules: DataFrame = merges) -> DataFrame:
            r = rules.select(F.col("old").alias(column), "new")
            return df.join(r, column, "left").withColumn(column, F.coalesce("new", column)).drop("new")

        moved = renamed(renamed(edges, "a"), "b").where("a <> b")
        edges = scratch.save(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")))
        sizes = scratch.save(renamed(sizes, "c").groupBy("c").agg(F.sum("n").alias("n")))
        member = scratch.save(renamed(member, "cluster"))


def cluster_entities(tokens: DataFrame, entity: str, token: str, spec: DataFrame, threshold: float) -> DataFrame:
    """(entity, cluster): ``cluster`` over all pairs with a token in common, alike as in ``similar_entities`` to nine digits.

    A merged cluster is never nearer to a third than the nearer of its parts, so clusters stay within the names linked
    by pairs of at least the threshold; lower similarities count only there. Each such group is clustered from its tokens in
    one task, without its pairs: many equally near names would else merge by one pair a round. Groups of more than
    ALONE names go through the rounds of ``cluster``.
    """
    scratch = Scratch(tokens.sparkSession, "alike")
    t = scratch.save(tokens.select(F.col(entity).alias("e"), F.col(token).alias("t")).distinct().join(spec.select(F.col(token).alias("t"), F.col("specificity").alias("s")), "t"))
    several = t.where("s > 0").groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t")
    every = t.join(several, "t", "left_semi").select(F.col("e").alias("entity")).distinct()

    # Similarities are rounded to nine digits.
    group = linked(similar_entities(tokens, entity, token, spec, threshold - 1e-9)).select(F.col("entity").alias("e"), F.col("cluster").alias("g"))
    sized = scratch.save(group.join(group.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g"))
    sets = t.groupBy("e").agg(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("n"), "t"))).alias("l"))
    sets = sets.select("e", F.transform("l", lambda x: x["t"]).alias("ts"), F.transform("l", lambda x: -x["n"]).alias("ws"))
    task = F.when(F.col("n") > TOGETHER, F.concat(F.lit("="), "g")).otherwise(F.pmod(F.xxhash64("g"), F.lit(64)).cast("string"))
    alone = sets.join(sized.where(F.col("n") <= ALONE), "e").withColumn("task", task)

    def clustered(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in rows.sort_values("e").groupby("g", sort=True):
            own = g["e"].to_numpy()
            held = np.concatenate(g["ts"].to_list())
            number, met = pd.factorize(held)
            weight = np.zeros(len(met))
            weight[number] = np.concatenate(g["ws"].to_list())
            sets = np.split(number, np.cumsum(g["ts"].map(len))[:-1])
            total = np.array([sum(w.tolist()) for w in g["ws"]])
            out.append(pd.DataFrame({"entity": own, "cluster": own[linkage.agglomerate(sets, weight, total, threshold)]}))
        return pd.concat(out)

    kind = dict(t.dtypes)["e"]
    found = alone.groupBy("task").applyInPandas(clustered, f"entity {kind}, cluster {kind}")
    if not sized.where(F.col("n") > ALONE).isEmpty():
        large = tokens.join(sized.where(F.col("n") > ALONE).select(F.col("e").alias(entity)), entity, "left_semi")
        found = found.unionByName(cluster(similar_entities(large, entity, token, spec, 1e-9).withColumn("similarity", F.round("similarity", 9)), threshold))
    return every.join(found, "entity", "left").select("entity", F.coalesce("cluster", "entity").alias("cluster"))
