"""Fetched pages: captured model answers, full texts, the page cache as a log, dates, licences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara.functions import scalars
from evidara.operators.search import position_relevance

#: Texts of pages that doubt the reader, and one that promises a full text.
DOUBTS, FULL_TEXT = ("verifying you are human", "are you a robot"), "free full text"
#: A page under this length is short; a better one is longer by half.
SHORT_PAGE, LONGER = 3000, 1.5
#: Deeds of licences.
DEEDS = {
    "cc-by": "https://creativecommons.org/licenses/by/4.0/",
    "cc-by-sa": "https://creativecommons.org/licenses/by-sa/4.0/",
    "cc-by-nc": "https://creativecommons.org/licenses/by-nc/4.0/",
    "cc-by-nd": "https://creativecommons.org/licenses/by-nd/4.0/",
    "cc-by-nc-nd": "https://creativecommons.org/licenses/by-nc-nd/4.0/",
    "cc-by-nc-sa": "https://creativecommons.org/licenses/by-nc-sa/4.0/",
    "cc0": "https://creativecommons.org/publicdomain/zero/1.0/",
    "public-domain": "https://creativecommons.org/publicdomain/mark/1.0/",
}
#: Why a text without a licence can't be passed on.
NO_LICENCE = {"bronze": "free to read on the publisher's site but under no open licence", "green": "only a repository manuscript copy is free; no redistribution grant", "closed": "not open access"}
_ANSWER = "struct<type:string,content:array<struct<type:string,annotations:array<struct<type:string,url:string,title:string>>>>,action:struct<sources:array<struct<url:string>>>>"
_RESULT = "array<struct<title:string,url:string,relevance:double>>"


def answered(json: Column, most: int) -> Column:
    """The first ``most`` results of a captured answer: cited pages first, then searched ones that weren't cited, each URL
    once and without tracking, titled by the citation or else the host. Empty unless a search and a message are in it.

    The outputs may be the whole answer or stand under "output" or "outputs".
    """
    nested = F.from_json(json, f"struct<output:array<{_ANSWER}>,outputs:array<{_ANSWER}>>")
    outputs = F.coalesce(nested["outputs"], nested["output"], F.from_json(json, f"array<{_ANSWER}>"))
    last = lambda kind: F.try_element_at(F.filter(outputs, lambda o: o["type"] == kind), F.lit(-1))
    search, message = last("web_search_call"), last("message")
    notes = F.flatten(F.transform(F.filter(message["content"], lambda c: c["type"] == "output_text"), lambda c: F.coalesce(c["annotations"], F.array())))
    row = lambda u, t: F.struct(t.alias("title"), scalars.without_tracking(u).alias("url"))
    cited = F.transform(F.filter(notes, lambda n: (n["type"] == "url_citation") & (F.coalesce(n["url"], F.lit("")) != "")), lambda n: row(n["url"], F.nullif(n["title"], F.lit(""))))
    found = F.transform(F.filter(search["action"]["sources"], lambda s: F.coalesce(s["url"], F.lit("")) != ""), lambda s: row(s["url"], F.lit(None).cast("string")))
    none = F.array().cast("array<struct<title:string,url:string>>")
    both = F.concat(F.coalesce(cited, none), F.coalesce(found, none))
    fresh = F.filter(both, lambda x, i: ~F.exists(F.slice(both, F.lit(1), i), lambda y: y["url"] == x["url"]))
    kept = F.transform(F.slice(fresh, 1, most), lambda x, i: F.struct(F.coalesce(x["title"], scalars.host(x["url"])).alias("title"), x["url"].alias("url"), position_relevance(i).cast("double").alias("relevance")))
    return F.when(search.isNotNull() & message.isNotNull(), kept).otherwise(F.array().cast(_RESULT))


def scored(json: Column, most: int) -> Column:
    """The first ``most`` results of a captured JSON response that have a URL, with the score over the best as relevance."""
    rows = F.from_json(json, "struct<results:array<struct<title:string,url:string,content:string,score:double>>>")["results"]
    taken = F.filter(F.slice(F.coalesce(rows, F.from_json(F.lit("[]"), "array<struct<title:string,url:string,content:string,score:double>>")), 1, most), lambda r: F.coalesce(r["url"], F.lit("")) != "")
    best = F.array_max(F.transform(taken, lambda r: F.coalesce(r["score"], F.lit(0.0))))
    return F.transform(taken, lambda r: F.struct(r["title"].alias("title"), r["url"].alias("url"), r["content"].alias("snippet"), (F.coalesce(r["score"], F.lit(0.0)) / F.when(best == 0, 1.0).otherwise(best)).alias("relevance")))


def needs_retry(markdown: Column, html: Column, sections: Column) -> Column:
    """Whether a page is to be fetched again more carefully: it doubts the reader, or is short though a full text is
    promised, or is short or empty without a section of an article."""
    text = F.lower(F.concat(F.coalesce(markdown, F.lit("")), F.lit("\n"), F.coalesce(html, F.lit(""))))
    empty = F.coalesce(markdown, F.lit("")) == ""
    short = ~empty & (F.length(markdown) < SHORT_PAGE)
    doubts = text.contains(DOUBTS[0]) | text.contains(DOUBTS[1])
    return doubts | (short & text.contains(FULL_TEXT)) | ((short | empty) & ~F.coalesce(sections, F.lit(False)))


def headings_of(text: Column) -> Column:
    """Distinct lower-cased headings of a Markdown text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$"), 1), lambda h: F.lower(F.trim(h))))


def under_headings(text: Column) -> Column:
    """Characters of a Markdown text from its first heading on, without headings."""
    body = F.regexp_extract(text, r"(?s)(?:^|\n)(#{1,6}[ \t]+\S.*)$", 1)
    return F.length(F.regexp_replace(body, r"(?m)^#{1,6}[ \t]+.*$|\s+$", ""))


def is_superset(candidate: Column, base: Column, ignored: Sequence[str] = ()) -> Column:
    """Whether a text is longer by half, has all headings of the other but ``ignored`` ones, and no less under them."""
    missing = F.filter(F.array_except(headings_of(base), headings_of(candidate)), lambda h: ~h.isin(*ignored) if ignored else F.lit(True))
    return (F.length(candidate) >= F.length(base) * LONGER) & (F.size(missing) == 0) & (under_headings(candidate) >= under_headings(base))


def fullest(base: DataFrame, key: str, text: str, candidates: DataFrame, link: str, candidate: str, most: int = 3) -> DataFrame:
    """(key, link, text): the longest of the first ``most`` candidates of each page that are supersets of it; the page
    itself, without link, if none is."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(link)
    first = candidates.select(key, link, F.col(candidate).alias("__c")).withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most)
    fit = first.join(base.select(key, F.col(text).alias("__b")), key).where(is_superset(F.col("__c"), F.col("__b")))
    best = fit.groupBy(key).agg(F.max_by(F.struct(F.col(link).alias("l"), F.col("__c").alias("t")), F.struct(F.length("__c"), F.col(link))).alias("__x"))
    return base.join(best, key, "left").select(key, F.col("__x.l").alias(link), F.coalesce("__x.t", text).alias(text))


def full_text_links(html: Column, base: Column) -> Column:
    """Distinct absolute addresses linked in the list of full texts of a page."""
    block = F.regexp_extract(html, r'(?is)<div[^>]*class="[^"]*full-text-links-list[^"]*"[^>]*>(.*?)</div>', 1)
    links = F.array_distinct(F.regexp_extract_all(block, F.lit(r'(?i)<a\b[^>]*?href="([^"]+)"'), 1))
    root, folder = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1), F.regexp_extract(base, r"^([^?#]*/)", 1)
    return F.transform(links, lambda x: F.when(x.rlike("^[A-Za-z]+://"), x).when(x.startswith("/"), F.concat(root, x)).otherwise(F.concat(folder, x)))


def doi_of(html: Column) -> Column:
    """The first DOI among the usual fields of a page's head, else what follows doi.org/ in its canonical address."""
    field = lambda name: F.nullif(F.trim(F.regexp_extract(html, rf'(?i)<meta[^>]*name="{name}"[^>]*content="(?:doi:|https?://doi\.org/)?([^"]+)"', 1)), F.lit(""))
    link = F.nullif(F.regexp_extract(html, r'(?i)<link[^>]*rel="canonical"[^>]*href="[^"]*doi\.org/([^"?#]+)', 1), F.lit(""))
    return F.coalesce(*[field(n) for n in ("citation_doi", "dc.identifier", "prism.doi", "bepress_citation_doi")], link)


def first_known(rows: DataFrame, key: str, value: str, others: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``rows`` with ``value`` filled, where it is null, from the first other table (its key column given) that knows it."""
    out = rows
    for k, (other, on) in enumerate(others):
        known = other.where(F.col(on).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(on).alias(f"__k{k}")).agg(F.min(value).alias(f"__v{k}"))
        out = out.join(known, F.col(on if on in rows.columns else key) == F.col(f"__k{k}"), "left")
    filled = F.coalesce(value, *[f"__v{k}" for k in range(len(others))])
    return out.withColumn(value, filled).drop(*[f"__{c}{k}" for k in range(len(others)) for c in "kv"])


# --- the page cache as a log of what was stored, failed and cleared -------------------------------------------------


def stored(log: DataFrame, url: str, kind: str, order: Sequence[str]) -> DataFrame:
    """The last entry of each URL and kind of content."""
    row = F.struct(*[F.col(c) for c in log.columns])
    return log.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("__u"), F.col(kind).alias("__k")).agg(F.max_by(row, F.struct(*order)).alias("__r")).select("__r.*")


def put(log: DataFrame, rows: DataFrame, url: str, final: str) -> DataFrame:
    """The log with new content under its final URL and, where a redirect led there, under the one asked for as well."""
    at = F.array_distinct(F.array(F.col(url), F.coalesce(final, url)))
    return log.unionByName(rows.withColumn("__u", F.explode(at)).withColumn(url, F.col("__u")).select(*log.columns))


def cached_urls(log: DataFrame, url: str, kind: str | None = None, wanted: str | None = None) -> DataFrame:
    """(url): distinct URLs with content, of one kind if asked."""
    rows = log.where(F.col(kind) == wanted) if kind and wanted else log
    return rows.where(F.col(url).isNotNull()).select(url).distinct()


def source_kinds(log: DataFrame, url: str, kind: str, order: Sequence[str]) -> DataFrame:
    """(url, kind): the kind of content of each URL that comes first in ``order``."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(kind))
    return log.where(F.col(url).isNotNull() & (place > 0)).groupBy(url).agg(F.min_by(kind, place).alias(kind))


def failures(log: DataFrame, url: str, reason: str, order: str) -> DataFrame:
    """(url, reason): the last failure of each URL not cleared since; a null reason clears."""
    last = log.groupBy(url).agg(F.max_by(F.struct(F.col(reason).alias("r")), order).alias("__x"))
    return last.where("__x.r IS NOT NULL").select(url, F.col("__x.r").alias(reason))


def to_fetch(results: DataFrame, url: str, pool: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(urls, counts): URLs of results without content that haven't failed, and one row (total, cached, failed, open)."""
    every = results.where(F.col(url).isNotNull()).select(url).distinct()
    known = every.join(pool.select(url).distinct().withColumn("__c", F.lit(True)), url, "left").join(failed.select(url).distinct().withColumn("__f", F.lit(True)), url, "left")
    cached, bad = F.col("__c").isNotNull(), F.col("__f").isNotNull()
    counts = known.agg(F.count(F.lit(1)).alias("total"), F.count_if(cached).alias("cached"), F.count_if(~cached & bad).alias("failed"), F.count_if(~cached & ~bad).alias("open"))
    return known.where(~cached & ~bad).select(url), counts


def rehydrated(quotes: DataFrame, url: str, pool: DataFrame, content: Sequence[str]) -> DataFrame:
    """Quotes with the columns ``content`` of the resource their URL names; null where the pool doesn't hold it."""
    return quotes.join(pool.select(F.col(url).alias("__u"), *content), F.col(url) == F.col("__u"), "left").drop("__u")


# --- licences ------------------------------------------------------------------------------------------------------


def identifiers(rows: DataFrame, identifier: str) -> DataFrame:
    """(kind, values): 'kind:value' identifiers by kind, those without a value left out."""
    at = F.instr(F.col(identifier), ":")
    split = rows.where((at > 0) & (F.length(identifier) > at)).select(F.substring(F.col(identifier), F.lit(1), at - 1).alias("kind"), F.substring(F.col(identifier), at + 1, F.length(identifier)).alias("value"))
    return split.groupBy("kind").agg(F.array_sort(F.collect_set("value")).alias("values"))


def match_keys(kind: Column, value: Column) -> Column:
    """What a returned work can be asked for by: its identifier as it is, and bare of what leads to it."""
    bare = F.when(kind == "doi", F.regexp_replace(value, "^https://doi.org/", "")).otherwise(F.regexp_extract(value, "([^/]*)$", 1))
    return F.array_distinct(F.filter(F.array(bare, value), lambda x: F.coalesce(x, F.lit("")) != ""))


def licence(licences: Column, status: Column, error: Column) -> Column:
    """(verdict, licence, reason) of a work's licences, the first in order of the best class; of one without, its status."""
    found = scalars.licence_verdict(licences, error)
    name = found["licence"]
    without = F.coalesce(*[F.when(status == s, r) for s, r in NO_LICENCE.items()], F.concat(F.lit("no licence recorded (open-access status: "), F.coalesce(status, F.lit("unknown")), F.lit(")")))
    reason = F.when(error.isNotNull(), F.concat(F.lit("licence lookup failed ("), error, F.lit(")"))).when(found["verdict"] == "redistributable", F.concat(name, F.lit(" permits redistribution with attribution")))
    reason = reason.when(found["verdict"] == "share-alike", F.concat(name, F.lit(" permits redistribution only under its conditions"))).when(name.isNotNull(), F.concat(name, F.lit(" is not a recognised redistribution grant"))).otherwise(without)
    return F.struct(found["verdict"].alias("verdict"), name.alias("licence"), reason.alias("reason"))


def deed(name: Column) -> Column:
    """The address of a licence's deed, null if it has none."""
    known = F.create_map(*[F.lit(x) for pair in DEEDS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(name)))


def kept_lookups(rows: DataFrame, error: str) -> DataFrame:
    """Lookups worth keeping: a failure may pass."""
    return rows.where(F.col(error).isNull())
