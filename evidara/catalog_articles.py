"""Queries on texts beyond their keywords: redaction, quotes in context, chunks, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.catalog import SENTENCES, quoted
from evidara.operators import chunking, documents, keywords, redaction
from evidara.registry import query, table

SPANS = "q AS (SELECT DISTINCT doc_id, s.s AS s, s.e AS e FROM (SELECT doc_id, unnest(q.spans) AS s FROM (SELECT doc_id, unnest(quotes) AS q FROM mentions)))"


def spans(spark: SparkSession, folder: str) -> DataFrame:
    return quoted(spark, folder).select("doc_id", "s", "e").distinct()


def texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", "text")


def _redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redaction.redacted(texts(spark, folder), "doc_id", "text", spans(spark, folder), "s", "e")


@query()
def redacted_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return _redacted(spark, folder).select("doc_id", "shown_chars", "cut", "markdown")


@query(
    f"""WITH {SPANS} SELECT DISTINCT r.doc_id, CAST(length(text) AS INTEGER) AS source_chars, greatest(least(5000, CAST(floor(0.05 * length(text)) AS INTEGER)), least(300, CAST(length(text) AS INTEGER))) AS budget, true AS kept
    FROM q JOIN resources r ON r.doc_id = q.doc_id WHERE text <> ''"""
)
def redaction_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For each quoted text its budget, and whether what is shown keeps to it and stands in the text."""
    n = F.col("source_chars")
    budget = F.greatest(F.least(F.lit(5000), F.floor(n * 0.05).cast("int")), F.least(F.lit(300), n))
    plain = F.transform("passages", lambda p: F.regexp_replace(p["text"], "…$", ""))
    stands = F.forall(plain, lambda p: F.contains(F.col("text"), p))
    used = F.aggregate(plain, F.lit(0), lambda a, p: a + F.length(p))
    rows = _redacted(spark, folder).join(texts(spark, folder), "doc_id")
    return rows.select("doc_id", "source_chars", budget.alias("budget"), (stands & (used <= budget)).alias("kept"))


WHOLE = r"CASE WHEN regexp_matches(substr(text, {0}, 2), '^[\p{{L}}\p{{N}}]{{2}}$') THEN {1} ELSE 0 END"


@query(
    rf"""WITH {SPANS}, t AS (SELECT q.doc_id, s + 3 AS s, e - 2 AS e, text FROM q JOIN resources r ON r.doc_id = q.doc_id WHERE text IS NOT NULL AND e - s > 8)
    SELECT doc_id, s, e, s - {WHOLE.format('s', "length(regexp_extract(substr(text, 1, s), '[\\p{L}\\p{N}]*$'))")} AS low, e + {WHOLE.format('e', "length(regexp_extract(substr(text, e + 1), '^[\\p{L}\\p{N}]*'))")} AS high FROM t"""
)
def whole_words(spark: SparkSession, folder: str) -> DataFrame:
    """Quoted spans cut by a few characters, widened to whole words."""
    t = spans(spark, folder).where("e - s > 8").select("doc_id", (F.col("s") + 3).alias("s"), (F.col("e") - 2).alias("e")).join(texts(spark, folder), "doc_id")
    w = documents.words_around(F.col("text"), F.col("s"), F.col("e"))
    return t.select("doc_id", "s", "e", w["s"].cast("long").alias("low"), w["e"].cast("long").alias("high"))


def _quotes(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "mentions").select("mention_id", "doc_id", F.posexplode("quotes").alias("k", "q"))
    chunks = table(spark, folder, "resources").where("text IS NOT NULL AND size(chunks) > 0").select("doc_id", "text", "chunks")
    return m.select("mention_id", "doc_id", "k", "q.spans").where(F.size("spans") > 0).join(chunks, "doc_id")


QUOTES = "m AS (SELECT mention_id, doc_id, unnest(quotes) AS q, generate_subscripts(quotes, 1) - 1 AS k FROM mentions), x AS (SELECT mention_id, k, q.spans AS spans, text, chunks FROM m JOIN resources r ON r.doc_id = m.doc_id WHERE text IS NOT NULL AND len(chunks) > 0 AND len(q.spans) > 0)"
PART = "substr(text, chunks[{0}].start + 1, chunks[{0}].\"end\" - chunks[{0}].start)"


@query(f"WITH {QUOTES} SELECT mention_id, k, CAST(len(spans) AS INTEGER) AS occurrences, substr(text, spans[1].s + 1, spans[1].e - spans[1].s) AS first, substr(text, spans[2].s + 1, spans[2].e - spans[2].s) AS second FROM x")
def quote_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    q = _quotes(spark, folder)
    of = lambda n: documents.occurrence_text(F.col("text"), F.col("spans"), F.lit(n))
    return q.select("mention_id", F.col("k").cast("long").alias("k"), documents.occurrences(F.col("spans"), F.lit(1)).alias("occurrences"), of(0).alias("first"), of(1).alias("second"))


@query(
    f"""WITH {QUOTES}, h AS (SELECT *, list_filter(range(1, len(chunks) + 1), lambda i: len(list_filter(spans, lambda s: chunks[i].start < s.e AND s.s < chunks[i]."end")) > 0) AS hit FROM x)
    SELECT mention_id, k, array_to_string(list_transform(range(greatest(list_min(hit) - 1, 1), least(list_max(hit) + 1, len(chunks)) + 1), lambda i: {PART.format('i')}), chr(10)) AS around FROM h WHERE len(hit) > 0"""
)
def relevant_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks around each quote."""
    around = documents.relevant_text(F.col("text"), F.col("chunks"), F.col("spans"), 1)
    return _quotes(spark, folder).select("mention_id", F.col("k").cast("long").alias("k"), around.alias("around")).where("around IS NOT NULL")


@query(
    f"""WITH {QUOTES}, h AS (SELECT *, list_filter(range(1, len(chunks) + 1), lambda i: chunks[i].start < spans[1].e AND spans[1].s < chunks[i]."end") AS hit FROM x)
    SELECT mention_id, k, list_transform(hit, lambda j: md5(array_to_string(list_transform(range(greatest(j - 1, 1), least(j + 1, len(chunks)) + 1), lambda i: {PART.format('i')}), chr(10)))) AS contexts FROM h"""
)
def chunk_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of each touched chunk with its neighbours, for the first place of each quote."""
    got = documents.chunk_contexts(F.col("text"), F.col("chunks"), F.element_at("spans", 1), 1)
    return _quotes(spark, folder).select("mention_id", F.col("k").cast("long").alias("k"), F.transform(got, lambda t: F.md5(t)).alias("contexts"))


@query()
def quotes_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes with a slip put in, in the words of the text."""
    q = table(spark, folder, "mentions").select("mention_id", "doc_id", F.explode("quotes.query_text").alias("query_text")).where(F.length("query_text") >= 40)
    slipped = F.concat(F.substring("query_text", 1, 10), F.expr("substring(query_text, 12)"))
    rows = q.select("mention_id", slipped.alias("quote"), "doc_id").join(texts(spark, folder), "doc_id")
    return documents.corrections(rows, "quote", "text").select("mention_id", "quote", "corrected")


@query(
    rf"""WITH {SENTENCES}, v AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM p WHERE len(a) > 0),
    w AS (SELECT doc_id, i, trim(x) AS x, len(regexp_split_to_array(trim(x), '\s+')) AS n FROM v), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 100 AS k FROM w),
    g AS (SELECT doc_id, k, string_agg(x, ' ' ORDER BY i) AS text, CAST(sum(n) AS BIGINT) AS wordcount FROM b GROUP BY doc_id, k) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_no, text, wordcount FROM g"""
)
def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.sentence_chunks(table(spark, folder, "documents"), "doc_id", "text", 100)


@query()
def keywords_by_method(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.extract_all(table(spark, folder, "documents"), "doc_id", "text", ["tfidf", "rake", "yake"], 5)


@query(r"WITH t AS (SELECT event_id, event_type || ' x' AS term FROM events) SELECT lower(term) AS key, arg_min(term, event_id) AS term, CAST(1 AS DOUBLE) AS score FROM t GROUP BY key")
def terms_once(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "events").select("event_id", F.concat("event_type", F.lit(" x")).alias("term"))
    return keywords.deduplicated(terms, "term", "event_id")
