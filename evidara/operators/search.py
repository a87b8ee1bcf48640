"""Captured search responses, result lists and the resources they register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara.functions import scalars


def position_relevance(position: Column) -> Column:
    """1, 0.95, 0.9, ... by position from 0, at least 0.1."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.05) * position)


def score_relevance(results: DataFrame, query: str, score: str, order: str, most: int) -> DataFrame:
    """The first ``most`` results of each query that have a URL, with ``relevance``: the score over the query's best.

    The best of a query is aggregated and joined, and first positions come from the results' own order, so a hot query
    needs no window over its rows besides the limit itself.
    """
    w = Window.partitionBy(query).orderBy(order)
    kept = results.where(F.col("url").isNotNull() & (F.col("url") != "")).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")
    best = kept.groupBy(F.col(query).alias("__q")).agg(F.max(score).alias("__m"))
    top = F.when(F.coalesce("__m", F.lit(0.0)) == 0, 1.0).otherwise(F.col("__m"))
    return kept.join(best, F.col(query).eqNullSafe(F.col("__q"))).withColumn("relevance", F.col(score) / top).drop("__q", "__m")


def summaries(xml: Column) -> Column:
    """Articles of a captured summary response: array of (id, title, journal, date, year as int, 0 if it is none)."""
    docs = F.regexp_extract_all(xml, F.lit(r"(?s)<DocSum>(.*?)</DocSum>"), 1)
    item = lambda d, name: F.nullif(F.regexp_extract(d, rf'(?s)<Item Name="{name}"[^>]*>([^<]*)</Item>', 1), F.lit(""))

    def one(d: Column) -> Column:
        pmid = F.regexp_extract(d, r"<Id>(\d+)</Id>", 1)
        year = F.coalesce(F.expr("null").cast("int"), F.regexp_extract(item(d, "PubDate"), r"^(\d{4})", 1).try_cast("int"), F.lit(0))
        return F.struct(pmid.alias("id"), item(d, "Title").alias("title"), item(d, "Source").alias("journal"), item(d, "PubDate").alias("date"), year.alias("year"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"))

    return F.transform(docs, one)


def found_ids(xml: Column) -> Column:
    """(ids, count) of a captured id search; a phrase that was not found makes both empty."""
    ids = F.regexp_extract_all(F.regexp_extract(xml, r"(?s)<IdList>(.*?)</IdList>", 1), F.lit(r"<Id>(\d+)</Id>"), 1)
    count = F.coalesce(F.regexp_extract(xml, r"<Count>(\d+)</Count>", 1).try_cast("int"), F.lit(0))
    lost = xml.contains("<PhraseNotFound>")
    return F.struct(F.when(lost, F.array().cast("array<string>")).otherwise(ids).alias("ids"), F.when(lost, 0).otherwise(count).alias("count"))


def sources(json: Column, most: int) -> Column:
    """The first ``most`` sources of a captured JSON response that have a URL and a title, with relevance by position."""
    parsed = F.from_json(json, "struct<sources:array<struct<metadata:struct<title:string,url:string>,content:string>>>")["sources"]
    taken = F.slice(F.coalesce(parsed, F.from_json(F.lit("[]"), "array<struct<metadata:struct<title:string,url:string>,content:string>>")), 1, most)
    rows = F.transform(taken, lambda s, i: F.struct(s["metadata"]["title"].alias("title"), s["metadata"]["url"].alias("url"), s["content"].alias("snippet"), position_relevance(i).alias("relevance")))
    return F.filter(rows, lambda r: (F.coalesce(r["url"], F.lit("")) != "") & (F.coalesce(r["title"], F.lit("")) != ""))


def first_results(results: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One result for each key, the first in order; ``hits`` counts them. Aggregated, so hot keys combine before the
    shuffle."""
    row = F.struct(*[F.col(c) for c in results.columns])
    one = results.groupBy(key.alias("__k")).agg(F.min_by(row, F.struct(*order)).alias("__r"), F.count(F.lit(1)).alias("hits"))
    return one.select("__r.*", "hits")


def register(urls: DataFrame, url: str, order: str, pool: DataFrame | None = None) -> DataFrame:
    """(doc_id, url): ids for URLs, without fragment, that the pool doesn't hold, numbered on from it in order of first
    sight. Numbers come from range partitions, not from one task."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    new = urls.where(F.col(url).isNotNull()).groupBy(scalars.without_fragment(F.col(url)).alias("url")).agg(F.min(order).alias("__o"))
    start = 0
    if pool is not None:
        new = new.join(pool.select("url"), "url", "left_anti")
        start = pool.count()
    ranked = running_sum(new.withColumn("__all", F.lit(0)), Scratch(urls.sparkSession, "register"), ["__all"], ["__o", "url"], None, "__k")
    return ranked.select(scalars.resource_id(F.col("__k") + start + 1, F.col("url")).alias("doc_id"), "url")


def batches(ranked: DataFrame, order: list[str], size: int, keys: list[str]) -> DataFrame:
    """Adds ``batch``: rows of a key in order, ``size`` in each. Numbered over range partitions, so hot keys spread."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    numbered = running_sum(ranked, Scratch(ranked.sparkSession, "batches"), keys, order, None, "__k")
    return numbered.withColumn("batch", F.floor(F.col("__k") / size)).drop("__k")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: an upsert log read as a table."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def redirected(urls: DataFrame, url: str, hops: DataFrame, most: int = 10) -> DataFrame:
    """(url, final_url): where up to ``most`` recorded redirects lead."""
    out = urls.select(F.col(url).alias("url")).distinct().withColumn("final_url", F.col("url"))
    step = hops.select(F.col("url").alias("__u"), F.col("target").alias("__t"))
    for _ in range(most):
        out = out.join(step, F.col("final_url") == F.col("__u"), "left").select("url", F.coalesce("__t", "final_url").alias("final_url"))
    return out


def with_cache(urls: DataFrame, url: str, cache: DataFrame) -> DataFrame:
    """Every URL with its cached content or null; duplicates in the list stay, the cache holds one row a URL."""
    return urls.join(cache, url, "left")


def clear(cache: DataFrame, patterns: DataFrame) -> DataFrame:
    """The cache without URLs that match one of a few patterns (checked to be at most 10 000, then sent to all tasks)."""
    rows = [r["pattern"] for r in patterns.select("pattern").where("pattern IS NOT NULL").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10000 patterns")
    hit = F.lit(False)
    for p in rows:
        hit = hit | scalars.matches_pattern(F.col("url"), F.lit(p))
    return cache.where(~hit)
