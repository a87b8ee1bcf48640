"""Queries on captured answers, the page cache, licences and the bookkeeping of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.catalog import ASSESSMENTS, assessments, quoted
from evidara.functions import scalars
from evidara.operators import bookkeeping, fetched, report, search
from evidara.registry import query, table


def results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_results").where("url IS NOT NULL")


HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"


@query(
    f"""WITH s AS (SELECT result_id, url, title FROM search_results WHERE url IS NOT NULL AND strpos(url, '?') = 0 AND strpos(url, '#') = 0)
    SELECT result_id, 0 AS place, coalesce(nullif(title, ''), {HOST}) AS title, url, CAST(1.0 AS DOUBLE) AS relevance FROM s
    UNION ALL SELECT result_id, 1, {HOST}, url || '?p=1', CAST(0.95 AS DOUBLE) FROM s"""
)
def model_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Results as captured answers: one page cited twice, once with tracking, and another one only searched."""
    s = results(spark, folder).where("instr(url, '?') = 0 AND instr(url, '#') = 0")
    note = lambda u: F.struct(F.lit("url_citation").alias("type"), u.alias("url"), F.col("title").alias("title"))
    source = lambda u: F.struct(u.alias("url"))
    tracked, other = F.concat("url", F.lit("?utm_source=x")), F.concat("url", F.lit("?p=1"))
    content = F.array(F.struct(F.lit("output_text").alias("type"), F.array(note(F.col("url")), note(tracked)).alias("annotations")))
    search = F.to_json(F.struct(F.lit("web_search_call").alias("type"), F.struct(F.array(source(F.col("url")), source(other)).alias("sources")).alias("action")))
    message = F.to_json(F.struct(F.lit("message").alias("type"), content.alias("content")))
    json = F.concat(F.lit('{"output":['), search, F.lit(","), message, F.lit("]}"))
    rows = s.select("result_id", F.posexplode(fetched.answered(json, 10)).alias("place", "x"))
    return rows.select("result_id", "place", "x.title", "x.url", F.round("x.relevance", 6).alias("relevance"))


@query(
    """WITH s AS (SELECT result_id, title, url, coalesce(relevance, 0) AS score FROM search_results WHERE url IS NOT NULL)
    SELECT result_id, url, CASE WHEN score = 0 THEN 0 ELSE 1 END::DOUBLE AS relevance FROM s UNION ALL SELECT result_id, url || '/b', CASE WHEN score = 0 THEN 0 ELSE 0.5 END FROM s"""
)
def scored_answers(spark: SparkSession, folder: str) -> DataFrame:
    row = lambda u, x: F.struct(F.col("title").alias("title"), u.alias("url"), F.col("snippet").alias("content"), x.alias("score"))
    score = F.coalesce("relevance", F.lit(0.0))
    json = F.to_json(F.struct(F.array(row(F.col("url"), score), row(F.lit(""), score * 9), row(F.concat("url", F.lit("/b")), score / 2)).alias("results")))
    rows = results(spark, folder).select("result_id", F.explode(fetched.scored(json, 5)).alias("x"))
    return rows.select("result_id", "x.url", "x.relevance")


# --- pages --------------------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, contains(lower(coalesce(text, '')), 'are you a robot') OR contains(lower(coalesce(text, '')), 'verifying you are human') OR (text <> '' AND length(text) < 3000 AND contains(lower(text), 'free full text'))
      OR ((coalesce(text, '') = '' OR length(text) < 3000) AND NOT regexp_matches(lower(coalesce(text, '')), 'abstract|methods')) AS retry FROM resources"""
)
def pages_to_retry(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "resources")
    sections = F.lower("text").rlike("abstract|methods")
    return r.select("doc_id", fetched.needs_retry(F.col("text"), F.lit(None).cast("string"), sections).alias("retry"))


HEADS = r"list_distinct(list_transform(regexp_extract_all({0}, '(?m)^#{{1,6}}[ \t]+(.+?)[ \t]*$', 1), lambda h: lower(trim(h))))"
UNDER = r"length(regexp_replace(regexp_extract({0}, '(?s)(?:^|\n)(#{{1,6}}[ \t]+\S.*)$', 1), '(?m)^#{{1,6}}[ \t]+.*$|\s+$', '', 'g'))"


@query(
    f"""WITH c AS (SELECT c.doc_id, chunk_id, c.text AS t, r.text AS b FROM chunk_data c JOIN resources r ON r.doc_id = c.doc_id WHERE c.text IS NOT NULL AND r.text IS NOT NULL)
    SELECT chunk_id, length(b) >= 1.5 * length(t) AND len(list_filter({HEADS.format('t')}, lambda h: NOT list_contains({HEADS.format('b')}, h))) = 0 AND {UNDER.format('b')} >= {UNDER.format('t')} AS fuller FROM c"""
)
def fuller_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the whole text of a resource supersedes each of its stored pieces."""
    r = table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", F.col("text").alias("b"))
    c = table(spark, folder, "chunk_data").where("text IS NOT NULL").join(r, "doc_id")
    return c.select("chunk_id", fetched.is_superset(F.col("b"), F.col("text")).alias("fuller"))


@query(r"SELECT result_id, url || '/pdf' AS first, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || '/full' AS second, 2 AS n FROM search_results WHERE url IS NOT NULL")
def full_text_links(spark: SparkSession, folder: str) -> DataFrame:
    link = lambda x: F.concat(F.lit('<a class="x" href="'), x, F.lit('">go</a>'))
    html = F.concat(F.lit('<a href="https://no.example/"></a><div class="a full-text-links-list">'), link(F.concat("url", F.lit("/pdf"))), link(F.lit("/full")), link(F.lit("/full")), F.lit("</div>"))
    got = fetched.full_text_links(html, F.col("url"))
    return results(spark, folder).select("result_id", F.element_at(got, 1).alias("first"), F.element_at(got, 2).alias("second"), F.size(got).alias("n"))


@query("SELECT doc_id, doi FROM resources")
def dois(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs read from heads of pages that name them in either way."""
    named = F.concat(F.lit('<head><meta name="citation_doi" content="doi:'), "doi", F.lit('"/></head>'))
    linked = F.concat(F.lit('<link rel="canonical" href="https://doi.org/'), "doi", F.lit('"/>'))
    return table(spark, folder, "resources").select("doc_id", fetched.doi_of(F.when(F.col("ord") % 2 == 0, named).otherwise(linked)).alias("doi"))


@query(
    """WITH k AS (SELECT site, min(publication_date) AS d FROM resources WHERE publication_date IS NOT NULL AND site IS NOT NULL GROUP BY site), l AS (SELECT licence, min(publication_date) AS d FROM resources WHERE publication_date IS NOT NULL AND licence IS NOT NULL GROUP BY licence)
    SELECT doc_id, coalesce(publication_date, l.d, k.d) AS publication_date FROM resources r LEFT JOIN l ON l.licence = r.licence LEFT JOIN k ON k.site = r.site"""
)
def dates_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Missing dates filled from tables that know them by one key, then another."""
    r = table(spark, folder, "resources")
    return fetched.first_known(r.select("doc_id", "site", "licence", "publication_date"), "doc_id", "publication_date", [(r, "licence"), (r, "site")]).select("doc_id", "publication_date")


# --- the page cache -----------------------------------------------------------------------------------------------


@query("SELECT url, backend, arg_max(result_id, (loaded_at, result_id)) AS result_id FROM search_results WHERE url IS NOT NULL GROUP BY url, backend")
def cache_content(spark: SparkSession, folder: str) -> DataFrame:
    log = results(spark, folder).select("url", "backend", "result_id", "loaded_at")
    return fetched.stored(log, "url", "backend", ["loaded_at", "result_id"]).select("url", "backend", "result_id")


@query("SELECT url, result_id FROM search_results WHERE url IS NOT NULL UNION ALL SELECT url, doc_id FROM resources UNION ALL SELECT 'https://moved.example/' || doc_id, doc_id FROM resources WHERE ord % 2 = 0")
def cache_put(spark: SparkSession, folder: str) -> DataFrame:
    """Pages stored under their own and, for every other one, the address they moved to."""
    log = results(spark, folder).select("url", F.col("result_id").alias("content"))
    new = table(spark, folder, "resources").select("url", F.col("doc_id").alias("content"), F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://moved.example/"), "doc_id")).alias("final"))
    return fetched.put(log, new, "url", "final").select("url", F.col("content").alias("result_id"))


@query("SELECT DISTINCT url FROM search_results WHERE url IS NOT NULL AND backend = 'litindex'")
def cached_of_kind(spark: SparkSession, folder: str) -> DataFrame:
    return fetched.cached_urls(results(spark, folder), "url", "backend", "litindex")


@query("SELECT url, CASE min(CASE backend WHEN 'litindex' THEN 1 WHEN 'openarchive' THEN 2 END) WHEN 1 THEN 'litindex' ELSE 'openarchive' END AS backend FROM search_results WHERE url IS NOT NULL AND backend IN ('litindex', 'openarchive') GROUP BY url")
def cache_source_kind(spark: SparkSession, folder: str) -> DataFrame:
    return fetched.source_kinds(results(spark, folder), "url", "backend", ["litindex", "openarchive"])


FAILURES = "f AS (SELECT url, CASE WHEN relevance < 0.5 THEN 'HTTP 500' END AS reason, result_id FROM search_results WHERE url IS NOT NULL), l AS (SELECT url, arg_max(CASE WHEN reason IS NULL THEN '-' ELSE reason END, result_id) AS reason FROM f GROUP BY url)"


def _failures(spark: SparkSession, folder: str) -> DataFrame:
    log = results(spark, folder).select("url", F.when(F.col("relevance") < 0.5, "HTTP 500").alias("reason"), "result_id")
    return fetched.failures(log, "url", "reason", "result_id")


@query(f"WITH {FAILURES} SELECT url, reason FROM l WHERE reason <> '-'")
def cache_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Failures recorded and cleared again: the last entry counts."""
    return _failures(spark, folder)


@query(f"WITH {FAILURES}, u AS (SELECT DISTINCT url FROM search_results WHERE url IS NOT NULL) SELECT url FROM u WHERE url NOT IN (SELECT url FROM resources) AND url NOT IN (SELECT url FROM l WHERE reason <> '-')")
def urls_to_fetch(spark: SparkSession, folder: str) -> DataFrame:
    return fetched.to_fetch(results(spark, folder), "url", table(spark, folder, "resources").select("url"), _failures(spark, folder))[0]


@query(
    f"""WITH {FAILURES}, u AS (SELECT DISTINCT url, url IN (SELECT url FROM resources) AS c, url IN (SELECT url FROM l WHERE reason <> '-') AS f FROM search_results WHERE url IS NOT NULL)
    SELECT count(*) AS total, count(*) FILTER (c) AS cached, count(*) FILTER (NOT c AND f) AS failed, count(*) FILTER (NOT c AND NOT f) AS open FROM u"""
)
def fetch_counts(spark: SparkSession, folder: str) -> DataFrame:
    return fetched.to_fetch(results(spark, folder), "url", table(spark, folder, "resources").select("url"), _failures(spark, folder))[1]


@query("SELECT result_id, r.doc_id, r.title AS page FROM search_results s LEFT JOIN resources r ON r.url = s.url WHERE s.url IS NOT NULL")
def quotes_rehydrated(spark: SparkSession, folder: str) -> DataFrame:
    pool = table(spark, folder, "resources").select("url", "doc_id", F.col("title").alias("page"))
    return fetched.rehydrated(results(spark, folder).select("result_id", "url"), "url", pool, ["doc_id", "page"]).select("result_id", "doc_id", "page")


# --- licences -----------------------------------------------------------------------------------------------------


@query("SELECT coalesce(licence, 'none') AS kind, list_sort(list(DISTINCT doi)) AS values FROM resources WHERE doi <> '' GROUP BY 1")
def identifiers_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.concat(F.coalesce("licence", F.lit("none")), F.lit(":"), F.coalesce("doi", F.lit("")))
    return fetched.identifiers(table(spark, folder, "resources").select(ids.alias("identifier")), "identifier")


@query("SELECT doc_id, [doi, 'https://doi.org/' || doi] AS keys FROM resources WHERE doi IS NOT NULL")
def licence_keys(spark: SparkSession, folder: str) -> DataFrame:
    value = F.concat(F.lit("https://doi.org/"), "doi")
    return table(spark, folder, "resources").where("doi IS NOT NULL").select("doc_id", fetched.match_keys(F.lit("doi"), value).alias("keys"))


FREE, BOUND = "('cc-by', 'cc-by-sa', 'cc0', 'public-domain', 'pd')", "('cc-by-nc', 'cc-by-nd', 'cc-by-nc-nd', 'cc-by-nc-sa')"


@query(
    f"""WITH s AS (SELECT site, list_sort(list(DISTINCT licence)) AS all_, min(licence) FILTER (licence IN {FREE}) AS free, min(licence) FILTER (licence IN {BOUND}) AS bound, min(licence) AS first FROM resources GROUP BY site)
    SELECT site, CASE WHEN free IS NOT NULL THEN 'redistributable' WHEN bound IS NOT NULL THEN 'share-alike' ELSE 'restricted' END AS verdict, coalesce(free, bound, first) AS licence,
      CASE WHEN free IS NOT NULL THEN free || ' permits redistribution with attribution' WHEN bound IS NOT NULL THEN bound || ' permits redistribution only under its conditions' WHEN first IS NOT NULL THEN first || ' is not a recognised redistribution grant' ELSE 'not open access' END AS reason FROM s"""
)
def site_licences(spark: SparkSession, folder: str) -> DataFrame:
    """What the licences seen on a site permit, and why."""
    s = table(spark, folder, "resources").groupBy("site").agg(F.collect_set("licence").alias("l"))
    return s.select("site", fetched.licence(F.col("l"), F.lit("closed"), F.lit(None).cast("string")).alias("x")).select("site", "x.verdict", "x.licence", "x.reason")


@query(
    "SELECT doc_id, CASE licence WHEN 'cc-by' THEN 'https://creativecommons.org/licenses/by/4.0/' WHEN 'cc-by-sa' THEN 'https://creativecommons.org/licenses/by-sa/4.0/' WHEN 'cc-by-nc' THEN 'https://creativecommons.org/licenses/by-nc/4.0/' WHEN 'cc-by-nd' THEN 'https://creativecommons.org/licenses/by-nd/4.0/' WHEN 'cc-by-nc-nd' THEN 'https://creativecommons.org/licenses/by-nc-nd/4.0/' WHEN 'cc-by-nc-sa' THEN 'https://creativecommons.org/licenses/by-nc-sa/4.0/' WHEN 'cc0' THEN 'https://creativecommons.org/publicdomain/zero/1.0/' WHEN 'public-domain' THEN 'https://creativecommons.org/publicdomain/mark/1.0/' END AS deed FROM resources"
)
def licence_deeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "resources").select("doc_id", fetched.deed(F.concat(F.lit(" "), F.upper("licence"))).alias("deed"))


# --- runs ---------------------------------------------------------------------------------------------------------


@query(
    """WITH m AS (SELECT chunk_id, unnest(map_entries(metadata)) AS e FROM chunk_data), a AS (SELECT chunk_id, e.key AS k, e.value AS v FROM m)
    SELECT coalesce(x.chunk_id, y.chunk_id - 1) AS chunk_id, coalesce(x.k, y.k) AS path, 'Config mismatch at ''' || coalesce(x.k, y.k) || ''': saved=' || coalesce(x.v, 'unset') || ', live=' || coalesce(y.v, 'unset') AS warning
    FROM a x FULL JOIN a y ON x.chunk_id = y.chunk_id - 1 AND x.k = y.k WHERE x.v IS DISTINCT FROM y.v"""
)
def changed_settings(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "chunk_data").select("chunk_id", "metadata")
    return bookkeeping.changed_settings(c, c.withColumn("chunk_id", F.col("chunk_id") - 1), ["chunk_id"], "metadata", "search").select("chunk_id", "path", "warning")


@query("SELECT doc_id, CASE WHEN len(chunks) > 0 THEN 'extraction' WHEN text IS NOT NULL THEN 'search' WHEN title IS NOT NULL THEN 'keywords' ELSE 'none' END AS stage, CASE WHEN len(chunks) > 0 THEN 3 WHEN text IS NOT NULL THEN 2 WHEN title IS NOT NULL THEN 1 ELSE 0 END AS next FROM resources")
def stages_reached(spark: SparkSession, folder: str) -> DataFrame:
    present = {"keywords": F.col("title").isNotNull(), "search": F.col("text").isNotNull(), "extraction": F.coalesce(F.size("chunks") > 0, F.lit(False))}
    stage = bookkeeping.stage_reached(present)
    return table(spark, folder, "resources").select("doc_id", stage.alias("stage"), bookkeeping.resume_at(bookkeeping.STAGES, stage).alias("next"))


@query("SELECT p_partkey, p_size % 3 AS major, p_size % 5 AS minor, p_size % 3 <> 1 OR (p_size % 3 = 0 AND p_size % 5 <> 2) AS breaking FROM part")
def breaking_versions(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").withColumn("major", F.col("p_size") % 3).withColumn("minor", F.col("p_size") % 5)
    new = report.version(F.concat(F.lit("v"), F.col("major"), F.lit("."), F.col("minor"), F.lit(".0#x")))
    return p.select("p_partkey", "major", "minor", bookkeeping.is_breaking(report.version(F.lit("v1.2.0")), new).alias("breaking"))


@query(f"WITH {ASSESSMENTS} SELECT (SELECT count(DISTINCT doc_id) FROM mentions) AS documents, (SELECT count(*) FROM (SELECT DISTINCT kind, name FROM mentions)) AS entities, (SELECT count(*) FROM mentions) AS mentions, count(*) AS pairs, count(*) FILTER (polarity = 'positive') AS accepted FROM a")
def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    pairs = assessments(spark, folder).withColumn("accepted", F.col("polarity") == "positive")
    return bookkeeping.run_totals(table(spark, folder, "mentions"), "kind", "name", "doc_id", pairs, "accepted")


@query("SELECT kind, count(*) AS co_mentions, count(DISTINCT doc_id) AS documents FROM mentions GROUP BY kind")
def sweep_totals(spark: SparkSession, folder: str) -> DataFrame:
    return bookkeeping.sweep_totals(table(spark, folder, "mentions"), "kind")


@query("SELECT doc_id, CAST(split_part(doc_id, '_', 1) AS BIGINT) AS number, row_number() OVER (ORDER BY CAST(split_part(doc_id, '_', 1) AS BIGINT), doc_id) = CAST(split_part(doc_id, '_', 1) AS BIGINT) AS in_place FROM resources")
def pool_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The pool in order of its numbers; an id is implied only where the number is the place."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    rows = bookkeeping.pool_rows(table(spark, folder, "resources").select("doc_id", "url"), "doc_id")
    placed = running_sum(rows.withColumn("all", F.lit(0)), Scratch(spark, "places"), ["all"], ["number", "doc_id"], None, "place")
    return placed.select("doc_id", "number", (F.col("place") + 1 == F.col("number")).alias("in_place"))


@query("SELECT doc_id AS id, url FROM resources")
def pool_saved_and_read(spark: SparkSession, folder: str) -> DataFrame:
    """The pool saved as JSON and read again."""
    saved = bookkeeping.saved_pool(table(spark, folder, "resources").select("doc_id", "url", "title", "doi"), "doc_id", ["title", "doi"])
    one = F.concat(F.lit('{"resources":['), "json", F.lit("]}"))
    rows = saved.select("number", F.explode(bookkeeping.read_pool(one, "title:string,doi:string")).alias("r")).select("number", "r.id", "r.url")
    return rows.select(F.concat(F.col("number").cast("string"), F.lit("_"), F.split_part("id", F.lit("_"), F.lit(2))).alias("id"), "url")


# --- captured responses and scalar expressions ---------------------------------------------------------------------


@query("SELECT result_id, [substr(result_id, 2), '7'] AS ids, 2 AS n FROM search_results")
def captured_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids and their count read from captured id searches."""
    xml = F.concat(F.lit("<eSearchResult><Count>2</Count><IdList><Id>"), F.expr("substring(result_id, 2)"), F.lit("</Id><Id>7</Id></IdList></eSearchResult>"))
    return table(spark, folder, "search_results").select("result_id", search.found_ids(xml).alias("x")).select("result_id", "x.ids", F.col("x.count").alias("n"))


@query(
    """SELECT ord, CAST(ord AS VARCHAR) AS id, nullif(title, '') AS title, coalesce(TRY_CAST(regexp_extract(publication_date, '^(\\d{4})', 1) AS INTEGER), 0) AS year FROM resources WHERE NOT regexp_matches(coalesce(title, ''), '[<>&]')"""
)
def captured_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Articles read from captured summaries."""
    item = lambda name, value: F.concat(F.lit(f'<Item Name="{name}" Type="String">'), F.coalesce(value, F.lit("")), F.lit("</Item>"))
    xml = F.concat(F.lit("<DocSum><Id>"), "ord", F.lit("</Id>"), item("Title", F.col("title")), item("PubDate", F.col("publication_date")), F.lit("</DocSum>"))
    r = table(spark, folder, "resources").where(~F.coalesce("title", F.lit("")).rlike("[<>&]"))
    return r.select("ord", F.explode(search.summaries(xml)).alias("s")).select("ord", "s.id", "s.title", "s.year")


@query("SELECT result_id, url, CAST(CASE WHEN place = 0 THEN 1.0 ELSE 0.95 END AS DOUBLE) AS relevance FROM (SELECT result_id, url, 0 AS place FROM search_results WHERE url <> '' AND title <> '' UNION ALL SELECT result_id, url || '/2', 1 FROM search_results WHERE url <> '' AND title <> '')")
def captured_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources of captured answers with relevance by position."""
    source = lambda u: F.struct(F.struct(F.col("title").alias("title"), u.alias("url")).alias("metadata"), F.col("snippet").alias("content"))
    json = F.to_json(F.struct(F.array(source(F.col("url")), source(F.concat("url", F.lit("/2"))), source(F.lit(""))).alias("sources")))
    rows = table(spark, folder, "search_results").where("url <> '' AND title <> ''").select("result_id", F.explode(search.sources(json, 5)).alias("s"))
    return rows.select("result_id", "s.url", F.col("s.relevance").cast("double").alias("relevance"))


@query("SELECT result_id, url || '?p=1&q=a' AS bare, url AS plain FROM search_results WHERE url IS NOT NULL AND strpos(url, '?') = 0 AND strpos(url, '#') = 0")
def untracked_urls(spark: SparkSession, folder: str) -> DataFrame:
    s = results(spark, folder).where("instr(url, '?') = 0 AND instr(url, '#') = 0")
    tracked = F.concat("url", F.lit("?utm_source=x&p=1&fbclid=y&empty=&q=a"))
    return s.select("result_id", scalars.without_tracking(tracked).alias("bare"), scalars.without_tracking(F.concat("url", F.lit("?gclid=1"))).alias("plain"))


@query("WITH q AS (SELECT doc_id, name, s.s AS s, s.e AS e FROM (SELECT doc_id, name, unnest(q.spans) AS s FROM (SELECT doc_id, name, unnest(quotes) AS q FROM mentions))) SELECT q.doc_id, s, e, substr(text, greatest(s - 30, 0) + 1, s - greatest(s - 30, 0)) || '**' || substr(text, s + 1, e - s) || '**' || substr(text, e + 1, 30) AS context FROM (SELECT DISTINCT doc_id, s, e FROM q) q JOIN resources r ON r.doc_id = q.doc_id WHERE text IS NOT NULL")
def quote_contexts(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", "text")
    q = quoted(spark, folder).select("doc_id", "s", "e").distinct().join(texts, "doc_id")
    return q.select("doc_id", "s", "e", scalars.context(F.col("text"), F.col("s"), F.col("e"), 30).alias("context"))


@query(
    r"""SELECT mention_id, (length(name) - length(replace(name, ',', '')) >= 2) OR (length(name) - length(replace(name, ',', '')) = 1 AND (regexp_matches(name, '\([^)]*\)\s*$') OR contains(lower(name), ', and '))) AS list,
      NOT (length(name) < 3 OR regexp_matches(name, '[()]') OR regexp_matches(name, '^\d') OR regexp_matches(name, '[,;]')) AND length(regexp_replace(name, '[^\p{L}]', '', 'g')) >= CASE WHEN length(name) <= 4 THEN 1 ELSE 2 END AS form FROM mentions"""
)
def name_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Which names are lists, and which can stand for an entity by themselves."""
    return table(spark, folder, "mentions").select("mention_id", scalars.is_list(F.col("name")).alias("list"), scalars.is_valid_form(F.col("name")).alias("form"))


@query("SELECT term_id, name, kind, 'a b' AS note FROM entity_terms WHERE NOT regexp_matches(name, '[#&]')")
def term_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Reference terms written as lines and read again."""
    t = table(spark, folder, "entity_terms").where(~F.col("name").rlike("[#&]"))
    line = F.concat("name", F.lit(" # remark &kind="), "kind", F.lit(", &note=a b, &none="))
    return t.select("term_id", scalars.term_line(line).alias("t")).select("term_id", "t.name", "t.kind", F.col("t.attributes")["note"].alias("note"))


@query("SELECT p_partkey, CASE WHEN p_partkey < 26 THEN chr(CAST(65 + p_partkey AS INTEGER)) WHEN p_partkey < 702 THEN chr(CAST(64 + p_partkey // 26 AS INTEGER)) || chr(CAST(65 + p_partkey % 26 AS INTEGER)) END AS label FROM part WHERE p_partkey < 702")
def alpha_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").where("p_partkey < 702").select("p_partkey", scalars.alpha_label(F.col("p_partkey")).alias("label"))


@query("SELECT p_partkey, p_size AS run, p_size % 9 AS major, CAST(p_partkey AS INTEGER) AS minor, 3 AS patch, p_brand AS hash FROM part")
def version_parts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat("p_size", F.lit("v"), F.col("p_size") % 9, F.lit("."), "p_partkey", F.lit(".3#"), "p_brand")
    return table(spark, folder, "part").select("p_partkey", report.version(text).alias("v")).select("p_partkey", "v.*")


@query("SELECT DISTINCT kind AS first, other AS second FROM (SELECT a.kind, b.kind AS other FROM entity_terms a JOIN entity_terms b ON a.kind <> b.kind OR a.kind = 'gene')")
def kinds_permitted(spark: SparkSession, folder: str) -> DataFrame:
    """Which kinds of the reference may pair, where genes are listed twice."""
    kinds = table(spark, folder, "entity_terms").agg(F.array_sort(F.collect_set("kind")).alias("k"))
    allowed = kinds.select(F.explode(scalars.permitted_kinds(F.concat("k", F.array(F.lit("gene"))))).alias("first", "others"))
    return allowed.select("first", F.explode("others").alias("second"))
