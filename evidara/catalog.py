"""All core queries by name, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions import names, scalars
from evidara.operators import articles, decisions, documents, entities, evidence, islands, keywords, pipeline, report, search
from evidara.registry import QUERIES, SQL, Query, query, table
from evidara.streaming import events as log

#: The year that ages are counted from, so that results don't depend on the day.
AS_OF = 2000


def assessments(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders as assessments of (part, supplier) pairs by documents (orders)."""
    line, order = table(spark, folder, "lineitem"), table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    rows = line.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate").join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    polarity = F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_linestatus") == "O", "positive").when(F.col("l_returnflag") == "A", "neutral").otherwise("irrelevant")
    return rows.select(
        F.col("l_partkey").alias("e1"), F.col("l_suppkey").alias("e2"), F.col("l_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), (1 + F.col("l_linenumber") % 9).alias("overall"), (1 + F.col("l_linenumber") % 5).alias("relevance"),
        F.col("l_quantity").alias("quoted"), polarity.alias("polarity"), F.col("l_returnflag").alias("factor"), F.concat("l_returnflag", "l_linestatus").alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_shipdate",
    )


ASSESSMENTS = """a AS (SELECT l_partkey e1, l_suppkey e2, l_orderkey doc, year(o_orderdate) AS y, 1 + l_linenumber % 9 AS overall, 1 + l_linenumber % 5 AS relevance, l_quantity quoted,
  CASE WHEN l_returnflag = 'R' THEN 'negative' WHEN l_linestatus = 'O' THEN 'positive' WHEN l_returnflag = 'A' THEN 'neutral' ELSE 'irrelevant' END AS polarity,
  l_returnflag factor, l_returnflag || l_linestatus AS label, l_orderkey * 10 + l_linenumber AS ord, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PAIR = f"""WITH {ASSESSMENTS}, d AS (SELECT e1, e2, doc, max(y) AS y FROM a GROUP BY ALL),
 w AS (SELECT e1, e2, count(*) AS doc_count, sum(1.0 / power(greatest({AS_OF} - y, 0) + 1, 0.75)) AS age_w FROM d GROUP BY ALL),
 s AS (SELECT *, row_number() OVER (PARTITION BY e1, e2 ORDER BY relevance * (1 - exp(-quoted / 200.0)) DESC, ord) AS k, count(*) OVER (PARTITION BY e1, e2) AS row_count FROM a),
 t AS (SELECT e1, e2, max(row_count) AS row_count, avg(relevance) FILTER (k <= 3) AS substantiated FROM s GROUP BY ALL),
 p AS (SELECT w.*, row_count, substantiated FROM w JOIN t USING (e1, e2))"""


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.pair_entries(assessments(spark, folder), ["e1", "e2"], "doc", "year", "relevance", "quoted", AS_OF, "ord")


# --- pairs and evidence -------------------------------------------------------------------------------------------


@query(f"{PAIR} SELECT e1, e2, doc_count, row_count, round(age_w, 6) AS age_w, round(substantiated, 6) AS substantiated FROM p")
def pair_entries(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).select("e1", "e2", "doc_count", "row_count", F.round("age_w", 6).alias("age_w"), F.round("substantiated", 6).alias("substantiated"))


@query(
    f"""{PAIR}, q AS (SELECT e1, e2, doc_count, round(age_w, 6) AS age_w, row_count FROM p)
    SELECT e1, e2, rank() OVER (ORDER BY age_w DESC) + (count(*) OVER (PARTITION BY age_w) - 1) / 2.0 + rank() OVER (ORDER BY row_count DESC) + (count(*) OVER (PARTITION BY row_count) - 1) / 2.0 AS rank_sum FROM q"""
)
def pair_rank(spark: SparkSession, folder: str) -> DataFrame:
    rounded = entries(spark, folder).withColumn("age_w", F.round("age_w", 6))
    return evidence.rank_sum(rounded, ["age_w", "row_count"], "rank_sum").select("e1", "e2", "rank_sum")


@query(
    f"""WITH {ASSESSMENTS}, m AS (SELECT e1, CAST(quantile_disc(overall, 0.5) AS INTEGER) AS overall FROM a GROUP BY e1),
    c AS (SELECT e1, factor, count(*) AS n, min(ord) AS o FROM a GROUP BY ALL), f AS (SELECT e1, arg_max(factor, (n, -o, factor)) AS factor FROM c GROUP BY e1)
    SELECT e1, overall, factor FROM m JOIN f USING (e1)"""
)
def evidence_agg(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.aggregate_evidence(assessments(spark, folder), ["e1"], "overall", ["factor"], "ord").withColumn("overall", F.col("overall").cast("int"))


@query(
    f"WITH {ASSESSMENTS} SELECT e1, e2, " + ", ".join(f"count(*) FILTER (polarity = '{p}') AS n_{p}, coalesce(max(overall) FILTER (polarity = '{p}'), 0) AS best_{p}" for p in evidence.POLARITIES) + " FROM a GROUP BY e1, e2"
)
def pair_spread(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.spread(assessments(spark, folder), ["e1", "e2"], "polarity", "overall")


@query(f"WITH {ASSESSMENTS} SELECT doc FROM a GROUP BY doc HAVING bool_and(polarity = 'irrelevant')")
def all_irrelevant(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.all_irrelevant(assessments(spark, folder), ["doc"], "polarity")


@query(
    f"""WITH {ASSESSMENTS}, o(a, b) AS (VALUES ('RF', 'NO'), ('AF', 'NF')), e AS (SELECT a, b FROM o UNION SELECT b, a FROM o),
    l AS (SELECT DISTINCT e1, label, polarity FROM a), s AS (SELECT e1, bool_or(polarity = 'positive') AND bool_or(polarity = 'negative') AS b FROM l GROUP BY e1),
    c AS (SELECT DISTINCT x.e1 FROM l x JOIN e ON x.label = e.a JOIN l z ON z.e1 = x.e1 AND z.label = e.b)
    SELECT s.e1, b OR c.e1 IS NOT NULL AS contentious FROM s LEFT JOIN c ON c.e1 = s.e1"""
)
def contentious_pairs(spark: SparkSession, folder: str) -> DataFrame:
    opposed = spark.createDataFrame([("RF", "NO"), ("AF", "NF")], "a string, b string")
    return evidence.contentious(assessments(spark, folder), ["e1"], "polarity", "label", opposed)


@query(
    f"""WITH {ASSESSMENTS}, s AS (SELECT * FROM a WHERE overall >= 7), n AS (SELECT e1, count(*) AS strong FROM s GROUP BY e1 HAVING count(*) >= 2),
    c AS (SELECT e1, label, count(*) AS k, min(ord) AS o FROM s GROUP BY ALL) SELECT e1, strong, arg_max(label, (k, -o, label)) AS label FROM n JOIN c USING (e1) GROUP BY e1, strong"""
)
def strong_labels(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.strong_labels(assessments(spark, folder), ["e1"], "overall", "label", "ord")


@query(f"WITH {ASSESSMENTS}, c AS (SELECT label, count(*) AS n FROM a GROUP BY label) SELECT label, n, row_number() OVER (ORDER BY n DESC, label) AS place FROM c")
def label_counts(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    counted = assessments(spark, folder).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "label")))  # a handful of labels


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000)")
def filter_prune(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    keep = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 150000)
    return evidence.prune(orders, keep, table(spark, folder, "customer"), "c_custkey").select("c_custkey", "c_name")


@query("SELECT kind, count(DISTINCT name) AS names, count(*) AS n FROM mentions GROUP BY kind")
def stats(spark: SparkSession, folder: str) -> DataFrame:
    return evidence.totals(table(spark, folder, "mentions"), "kind", "name")


@query(f"WITH {ASSESSMENTS} SELECT DISTINCT least(e1, e2) AS first, greatest(e1, e2) AS second FROM a")
def assessed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    a = assessments(spark, folder)
    return a.select(F.least("e1", "e2").alias("first"), F.greatest("e1", "e2").alias("second")).distinct()


@query("SELECT doc_id, row_number() OVER (PARTITION BY site ORDER BY coalesce(publication_date, '') DESC, coalesce(len(chunks), 0), ord) AS place FROM resources")
def by_date(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each document on its site: newest first, undated last, fewer spans first. The descending date is turned into
    an ascending key by mirroring its characters, so the rank can be counted over range partitions."""
    from evidara.plans.lineage import Scratch
    from evidara.plans.ranking import running_sum

    mirrored = F.rpad(F.translate(F.coalesce("publication_date", F.lit("")), "-0123456789", ";9876543210"), 30, "~")
    k = F.when(F.col("chunks").isNull(), 0).otherwise(F.size("chunks"))
    r = table(spark, folder, "resources").select("doc_id", "site", mirrored.alias("down"), k.alias("k"), "ord")
    placed = running_sum(r, Scratch(spark, "dates"), ["site"], ["down", "k", "ord"], None, "before")
    return placed.select("doc_id", (F.col("before") + 1).alias("place"))


@query("SELECT doc_id, coalesce(coalesce(try_strptime(CASE WHEN regexp_full_match(publication_date[:10], '\\d{4}-\\d{2}-\\d{2}') THEN publication_date[:10] END, '%Y-%m-%d'), try_strptime(CASE WHEN regexp_full_match(publication_date[:10], '\\d{8}') THEN publication_date[:10] END, '%Y%m%d')).year(), 0) AS y FROM resources")
def publication_years(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "resources").select("doc_id", F.coalesce(evidence.publication_year(F.col("publication_date")), F.lit(0)).cast("long").alias("y"))


# --- intervals ----------------------------------------------------------------------------------------------------

QUOTED = "q AS (SELECT doc_id, name, s.s AS s, s.e AS e FROM (SELECT doc_id, name, unnest(q.spans) AS s FROM (SELECT doc_id, name, unnest(quotes) AS q FROM mentions)))"


def quoted(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "mentions").select("mention_id", "doc_id", "name", F.explode("quotes").alias("q"))
    return m.select("mention_id", "doc_id", "name", "q.query_text", F.explode("q.spans").alias("x")).select("mention_id", "doc_id", "name", "query_text", "x.s", "x.e")


def _runs(source: str, gap: int, keys: str = "doc_id") -> str:
    return f"r AS (SELECT *, sum(o) OVER (PARTITION BY {keys} ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) - 1 AS island FROM (SELECT *, CASE WHEN m IS NULL OR s > m + {gap} THEN 1 ELSE 0 END AS o FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {source})))"


@query(f"WITH {QUOTED}, {_runs('q', 200)} SELECT doc_id, island::BIGINT AS island, min(s) AS start, max(e) AS \"end\", list_sort(list(DISTINCT name)) AS entities FROM r GROUP BY doc_id, island HAVING count(DISTINCT name) >= 2")
def proximal_sets(spark: SparkSession, folder: str) -> DataFrame:
    return islands.proximal_sets(quoted(spark, folder), "doc_id", "name", "s", "e", 200)


@query(f"WITH {QUOTED}, {_runs('q', 60)} SELECT doc_id, island::BIGINT AS island, min(s) AS s, max(e) AS e, count(*) AS spans FROM r GROUP BY doc_id, island")
def merged_spans(spark: SparkSession, folder: str) -> DataFrame:
    return islands.merged_spans(quoted(spark, folder), ["doc_id"], "s", "e", 60)


@query(f"WITH x AS (SELECT l_suppkey, l_partkey, l_orderkey, datediff('day', TIMESTAMP '1970-01-01', l_shipdate) AS s, datediff('day', TIMESTAMP '1970-01-01', l_shipdate) + l_linenumber AS e FROM lineitem), {_runs('x', 1, 'l_suppkey')} SELECT l_suppkey, island::BIGINT AS island, min(s) AS start, max(e) AS \"end\", count(DISTINCT (l_partkey, l_orderkey)) AS pairs FROM r GROUP BY l_suppkey, island")
def regions(spark: SparkSession, folder: str) -> DataFrame:
    days = F.datediff("l_shipdate", F.lit("1970-01-01"))
    x = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", days.alias("s"), (days + F.col("l_linenumber")).alias("e"))
    return islands.regions(x, "l_suppkey", "s", "e", "l_partkey", "l_orderkey")


@query(
    f"""WITH {QUOTED}, d AS (SELECT DISTINCT doc_id, name, s FROM q)
    SELECT a.doc_id, a.name AS first, b.name AS second, a.s AS pos1, b.s AS pos2 FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.name < b.name AND abs(a.s - b.s) <= 150"""
)
def co_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return islands.co_mentions(quoted(spark, folder).select("doc_id", "name", "s").distinct(), "doc_id", "name", "s", 150)


@query(
    """WITH m AS (SELECT mention_id, unnest(quotes) AS q FROM mentions)
    SELECT mention_id, q.query_text AS query_text, len(list_filter(q.spans, lambda x: x.s <= q.spans[1].s + 10 AND q.spans[1].s + 10 <= x.e AND x.s <= q.spans[1].e AND q.spans[1].e <= x.e)) > 0 AS covered
    FROM m WHERE len(q.spans) > 0"""
)
def coverage(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "mentions").select("mention_id", F.explode("quotes").alias("q")).where(F.size("q.spans") > 0)
    first = F.element_at("q.spans", 1)
    return m.select("mention_id", "q.query_text", islands.covered(first["s"] + 10, first["e"], F.col("q.spans")).alias("covered"))


@query(
    f"""WITH {QUOTED}, c AS (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) - 1 AS k FROM resources)
    SELECT q.doc_id, q.s, q.e, CAST(min(k) FILTER (c['start'] <= q.s AND q.s < c['end']) AS INTEGER) AS chunk, count(*) FILTER (c['start'] < q.e AND q.s < c['end']) AS touched
    FROM (SELECT DISTINCT doc_id, s, e FROM q) q JOIN c ON c.doc_id = q.doc_id GROUP BY q.doc_id, q.s, q.e"""
)
def chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "resources").where(F.size("chunks") > 0).select("doc_id", "chunks")
    q = quoted(spark, folder).select("doc_id", "s", "e").distinct().join(chunks, "doc_id")
    c = F.col("chunks")
    return q.select("doc_id", "s", "e", islands.chunk_of(c, F.col("s")).alias("chunk"), F.size(islands.chunks_of(c, F.col("s"), F.col("e"))).cast("long").alias("touched"))


@query(
    f"""WITH {QUOTED}, c AS (SELECT doc_id, c.start AS pos, k FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS k FROM resources WHERE text IS NOT NULL)), d AS (SELECT DISTINCT q.doc_id, s FROM q JOIN resources r ON r.doc_id = q.doc_id WHERE len(chunks) > 0)
    SELECT d.doc_id, d.s, d.s + coalesce(arg_max(k, (pos, k)) FILTER (pos <= d.s), 0) AS at FROM d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id, d.s"""
)
def as_of_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes shifted by the number of the last chunk that starts at or before them, as if each began with a mark."""
    numbered = F.transform("chunks", lambda c, i: F.struct(c["start"].alias("pos"), (i + 1).alias("delta")))
    entries = table(spark, folder, "resources").where("size(chunks) > 0").select("doc_id", F.array_sort(numbered).alias("entries"))
    q = quoted(spark, folder).select("doc_id", "s").distinct().join(entries, "doc_id")
    return q.select("doc_id", "s", islands.as_of(F.col("entries"), F.col("s")).cast("long").alias("at"))


# --- entities -----------------------------------------------------------------------------------------------------


@query("SELECT name AS canonical, list_sort(list(DISTINCT a) FILTER (a IS NOT NULL)) AS aliases FROM (SELECT name, unnest(CASE WHEN len(coalesce(aliases, [])) = 0 THEN [NULL] ELSE aliases END) AS a FROM mentions) GROUP BY name")
def global_aliases(spark: SparkSession, folder: str) -> DataFrame:
    got = entities.global_aliases(table(spark, folder, "mentions"), "name", "aliases")
    return got.select("canonical", F.when(F.size("aliases") > 0, F.col("aliases")).alias("aliases"))


@query("SELECT name AS canonical, arg_min(kind, mention_id) AS kind FROM mentions GROUP BY name")
def first_kind(spark: SparkSession, folder: str) -> DataFrame:
    return entities.first_kind(table(spark, folder, "mentions"), "name", "kind", "mention_id")


@query()
def variant_map(spark: SparkSession, folder: str) -> DataFrame:
    return entities.variant_map(table(spark, folder, "mentions"), "name", "aliases")


@query()
def contested_forms(spark: SparkSession, folder: str) -> DataFrame:
    return entities.contested_forms(table(spark, folder, "mentions"), "name", "aliases")


@query()
def entity_match(spark: SparkSession, folder: str) -> DataFrame:
    known = entities.variant_map(table(spark, folder, "entity_terms").withColumn("aliases", F.array().cast("array<string>")), "name", "aliases")
    return entities.match_exact(table(spark, folder, "mentions"), "name", known)


@query()
def fuzzy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return entities.fuzzy_pairs(comparable_names(spark, folder), "norm")


@query(
    """WITH f AS (SELECT DISTINCT f FROM (SELECT source_norm f FROM merge_rules UNION ALL SELECT target_norm FROM merge_rules) WHERE f <> '')
    SELECT p.f AS parent, c.f AS child FROM f p JOIN f c ON p.f <> c.f AND contains(' ' || c.f || ' ', ' ' || p.f || ' ')"""
)
def substring_pairs(spark: SparkSession, folder: str) -> DataFrame:
    forms = table(spark, folder, "merge_rules").select(F.explode(F.array("source_norm", "target_norm")).alias("form"))
    return entities.substring_pairs(forms, "form")


@query(
    """WITH RECURSIVE v AS (SELECT * FROM merge_rules WHERE target_norm IS NOT NULL AND source_norm <> target_norm),
    n AS (SELECT kind, source_norm AS s, arg_max(target_norm, (event, rule_id)) AS t FROM v GROUP BY kind, source_norm),
    w AS (SELECT kind, s, t AS spot, [s] AS seen FROM n
          UNION ALL SELECT w.kind, w.s, n.t, list_append(w.seen, w.spot) FROM w JOIN n ON n.kind = w.kind AND n.s = w.spot WHERE NOT list_contains(w.seen, w.spot))
    SELECT kind AS scope, s AS source, arg_max(spot, len(seen)) AS target FROM w GROUP BY kind, s"""
)
def merge_chain(spark: SparkSession, folder: str) -> DataFrame:
    return entities.final_targets(table(spark, folder, "merge_rules"), "kind", "source_norm", "target_norm", ["event", "rule_id"])


@query(
    """WITH v AS (SELECT * FROM merge_rules WHERE target_norm IS NOT NULL AND source_norm <> target_norm),
    n AS (SELECT kind, source_norm AS s, arg_max(target_norm, (event, rule_id)) AS t FROM v GROUP BY kind, source_norm)
    SELECT m.mention_id, coalesce(n.t, m.name) AS name FROM mentions m LEFT JOIN n ON n.kind = m.kind AND n.s = lower(m.name)"""
)
def rules_applied(spark: SparkSession, folder: str) -> DataFrame:
    rules = entities.latest_rules(table(spark, folder, "merge_rules"), "kind", "source_norm", "target_norm", ["event", "rule_id"])
    m = table(spark, folder, "mentions").withColumn("norm", F.lower("name"))
    return entities.apply_targets(m, "kind", "norm", "name", rules).select("mention_id", "name")


@query(
    """WITH m AS (SELECT DISTINCT ON (mention_id) * FROM mentions WHERE regexp_full_match(trim(name), '[a-z]+')), l AS (SELECT doc_id, trim(name) AS norm, arg_min(name, (ord, mention_id)) AS name, arg_min(kind, (ord, mention_id)) AS kind,
      list(aliases ORDER BY ord, mention_id) AS a, string_agg(reasoning, ' | ' ORDER BY ord, mention_id) AS reasoning FROM m GROUP BY ALL), u AS (SELECT doc_id, norm, unnest(a) AS a, generate_subscripts(a, 1) AS i FROM l),
    v AS (SELECT doc_id, norm, unnest(a) AS x, i * 1000 + generate_subscripts(a, 1) AS i FROM u), w AS (SELECT doc_id, norm, x, min(i) AS i FROM v GROUP BY ALL), g AS (SELECT doc_id, norm, list(x ORDER BY i) AS aliases FROM w GROUP BY ALL)
    SELECT l.doc_id, l.norm, name, kind, coalesce(aliases, []) AS aliases, coalesce(reasoning, '') AS reasoning FROM l LEFT JOIN g USING (doc_id, norm)"""
)
def grouped_extractions(spark: SparkSession, folder: str) -> DataFrame:
    plain = table(spark, folder, "mentions").where(F.trim("name").rlike("^[a-z]+$")).withColumn("ord", F.struct("ord", "mention_id"))
    return entities.group_extractions(plain, "doc_id", "name", "kind", "aliases", "reasoning", "ord")


@query(
    r"""WITH c AS (SELECT lower(name) AS k, name, length(regexp_replace(name, '[^\p{Lu}]', '', 'g')) AS u, length(regexp_replace(name, '[^\p{Ll}]', '', 'g')) AS l FROM mentions)
    SELECT k AS key, arg_max(name, (l * u, u, -l, name)) AS name FROM c GROUP BY k"""
)
def best_form(spark: SparkSession, folder: str) -> DataFrame:
    return entities.best_form(table(spark, folder, "mentions").withColumn("key", F.lower("name")), "key", "name")


PART_WORDS = "t AS (SELECT DISTINCT p_partkey AS e, unnest(string_split(p_name, ' ')) AS token FROM part)"


@query(f"WITH {PART_WORDS}, w AS (SELECT token, count(*)::DOUBLE AS weight FROM t WHERE token <> '' GROUP BY token) SELECT token, weight, round(ln(((SELECT sum(weight) FROM w) + 1) / (weight + 1)), 6) AS specificity FROM w")
def specificity(spark: SparkSession, folder: str) -> DataFrame:
    return _part_spec(spark, folder).withColumn("specificity", F.round("specificity", 6))


def _part_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("e"), F.explode(F.split("p_name", " ")).alias("token")).where("token <> ''").distinct()


def _part_spec(spark: SparkSession, folder: str) -> DataFrame:
    return entities.specificity(_part_words(spark, folder), "e", "token", F.lit(1.0))


def _name_tokens(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "merge_rules").select(F.col("source_norm").alias("e")).where("e IS NOT NULL").distinct()
    return terms.select("e", F.explode(names.tokens_of(F.col("e"))).alias("token"))


@query()
def similar_names(spark: SparkSession, folder: str) -> DataFrame:
    return _similar_names(spark, folder, 0.3)


@query()
def name_clusters(spark: SparkSession, folder: str) -> DataFrame:
    from evidara.plans.lineage import Scratch

    # Averages count every pair with a token in common, however little alike.
    tokens = Scratch(spark, "tokens").save(_name_tokens(spark, folder))
    return entities.cluster_entities(tokens, "e", "token", entities.specificity(tokens, "e", "token", F.lit(1.0)), 0.3)


def _similar_names(spark: SparkSession, folder: str, threshold: float) -> DataFrame:
    tokens = _name_tokens(spark, folder)
    spec = entities.specificity(tokens, "e", "token", F.lit(1.0))
    return entities.similar_entities(tokens, "e", "token", spec, threshold).withColumn("similarity", F.round("similarity", 9))


@query("SELECT DISTINCT a.l_orderkey AS doc, least(a.l_partkey, b.l_partkey) AS a, greatest(a.l_partkey, b.l_partkey) AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x: F.transform(F.filter("p", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return parts.select("doc", F.explode(pairs).alias("e")).select("doc", "e.a", "e.b")  # an order has at most seven lines


# --- scalar functions ---------------------------------------------------------------------------------------------


@query("SELECT url, substr(sha256(regexp_replace(url, '#.*$', '')), 1, 16) AS h FROM search_results WHERE url IS NOT NULL")
def url_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "search_results").where("url IS NOT NULL").select("url", scalars.url_hash(F.col("url")).alias("h"))


POWERS = ", ".join(f"{36**k}::UBIGINT" for k in range(12, -1, -1))


@query(
    f"""WITH h AS (SELECT result_id, CAST('0x' || substr(sha256(regexp_replace(url, '#.*$', '')), 1, 16) AS UBIGINT) AS n FROM search_results WHERE url IS NOT NULL),
    d AS (SELECT result_id, ltrim(array_to_string(list_transform([{POWERS}], lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(1 + (n // p) % 36 AS INTEGER), 1)), ''), '0') AS h FROM h)
    SELECT result_id, h, '7_' || substr(lpad(h, greatest(8, length(h))::INTEGER, '0'), 1, 8) AS rid FROM d"""
)
def resource_ids(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "search_results").where("url IS NOT NULL")
    return s.select("result_id", scalars.url_hash36(F.col("url")).alias("h"), scalars.resource_id(F.lit(7), F.col("url")).alias("rid"))


@query(r"SELECT result_id, regexp_replace(url, '#.*$', '') AS bare, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM search_results WHERE url IS NOT NULL")
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "search_results").where("url IS NOT NULL")
    return s.select("result_id", scalars.without_fragment(F.col("url")).alias("bare"), scalars.host(F.col("url")).alias("host"))


@query(r"SELECT mention_id, replace(replace(replace(name, 'ae', 'e'), 'oe', 'e'), 'our', 'or') AS folded, trim(regexp_replace(name, '\s+\([a-zA-Z0-9_\s-]+\)\s*$', '')) AS bare FROM mentions")
def spellings(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "mentions")
    return m.select("mention_id", scalars.fold_spelling(F.col("name")).alias("folded"), scalars.without_kind(F.col("name")).alias("bare"))


@query("SELECT mention_id, [doc_id] AS ids FROM mentions")
def citations(spark: SparkSession, folder: str) -> DataFrame:
    """Documents cited by the reasons of mentions, each of which ends with its document."""
    text = F.concat(F.coalesce("reasoning", F.lit("")), F.lit(" ["), F.col("doc_id"), F.lit("; see ["), F.col("doc_id"), F.lit("]]"))
    return table(spark, folder, "mentions").select("mention_id", scalars.citation_ids(text).alias("ids"))


@query("SELECT doc_id, coalesce(licence, '') AS licence, CASE WHEN licence IN ('cc-by', 'cc-by-sa', 'cc0', 'public-domain', 'pd') THEN 'redistributable' WHEN licence IN ('cc-by-nc', 'cc-by-nd', 'cc-by-nc-nd', 'cc-by-nc-sa') THEN 'share-alike' ELSE 'restricted' END AS verdict FROM resources")
def licence_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    v = scalars.licence_verdict(F.array("licence"), F.lit(None).cast("string"))
    return table(spark, folder, "resources").select("doc_id", F.coalesce("licence", F.lit("")).alias("licence"), v["verdict"].alias("verdict"))


@query("SELECT lower(name) AS form, count(DISTINCT name) > 0 AS alike FROM mentions WHERE name IS NOT NULL GROUP BY 1")
def case_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Whether names that differ in case only match each other."""
    forms = table(spark, folder, "mentions").where("name IS NOT NULL").groupBy(F.lower("name").alias("form")).agg(F.array_sort(F.collect_set("name")).alias("n"))
    return forms.select("form", names.all_match_of(F.col("n")).alias("alike"))


@query(r"SELECT result_id, regexp_matches(lower(regexp_extract(url, '^([^?#]*)', 1)), '\.pdf$|/pdf/|/pdf$') AS pdf, trim(substr(regexp_replace(regexp_replace(lower(query), '[^\w\s-]', '', 'g'), '[\s-]+', '_', 'g'), 1, 80), '_') AS slug FROM search_results WHERE url IS NOT NULL AND query IS NOT NULL")
def url_kinds(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "search_results").where("url IS NOT NULL AND query IS NOT NULL")
    return s.select("result_id", scalars.is_pdf(F.col("url")).alias("pdf"), scalars.slug(F.col("query")).alias("slug"))


@query("SELECT doc_id, CAST(ord AS VARCHAR) AS id, CASE WHEN ord % 2 = 0 THEN 'pmid' ELSE 'pmcid' END AS kind FROM resources WHERE ord % 2 = 0 UNION ALL SELECT doc_id, 'PMC' || ord, 'pmcid' FROM resources WHERE ord % 2 = 1")
def pubmed_ids(spark: SparkSession, folder: str) -> DataFrame:
    url = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "ord", F.lit("/?x"))).otherwise(F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), "ord"))
    return table(spark, folder, "resources").select("doc_id", scalars.pubmed_id(url).alias("x")).select("doc_id", "x.id", "x.kind")


@query("SELECT rule_id, least({'kind': kind, 'name': source_norm}, {'kind': kind, 'name': target_norm}).name AS first, greatest({'kind': kind, 'name': source_norm}, {'kind': kind, 'name': target_norm}).name AS second FROM merge_rules WHERE kind IS NOT NULL AND source_norm IS NOT NULL AND target_norm IS NOT NULL")
def pair_keys(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "merge_rules").where("kind IS NOT NULL AND source_norm IS NOT NULL AND target_norm IS NOT NULL")
    k = scalars.pair_key(F.col("source_norm"), F.col("kind"), F.col("target_norm"), F.col("kind"))
    return r.select("rule_id", k["first"]["name"].alias("first"), k["second"]["name"].alias("second"))


@query()
def comparable_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mentions").select("name").distinct().withColumn("norm", names.comparable_of(F.col("name")))


@query("SELECT DISTINCT source_norm AS a, target_norm AS b, damerau_levenshtein(source_norm, target_norm) AS distance FROM merge_rules WHERE source_norm IS NOT NULL AND target_norm IS NOT NULL")
def osa(spark: SparkSession, folder: str) -> DataFrame:
    """Edits between the two names of each rule."""
    r = table(spark, folder, "merge_rules").where("source_norm IS NOT NULL AND target_norm IS NOT NULL").select(F.col("source_norm").alias("a"), F.col("target_norm").alias("b")).distinct()
    return r.withColumn("distance", names.osa_of(F.col("a"), F.col("b")).cast("long"))


# --- documents ----------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT m.mention_id, m.doc_id, unnest(m.quotes).query_text AS query_text FROM mentions m)
    SELECT mention_id, query_text, strpos(r.text, query_text) - 1 AS at FROM q JOIN resources r USING (doc_id) WHERE r.text IS NOT NULL"""
)
def quote_starts(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "mentions").select("mention_id", "doc_id", F.explode("quotes").alias("q")).select("mention_id", "doc_id", "q.query_text")
    texts = table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", "text")
    return q.join(texts, "doc_id").select("mention_id", "query_text", F.coalesce(documents.quote_start(F.col("query_text"), F.col("text")), F.lit(-1)).cast("long").alias("at"))


@query(
    """WITH q AS (SELECT DISTINCT mention_id, doc_id, unnest(quotes).query_text AS query_text FROM mentions), x AS (SELECT mention_id, query_text, text FROM q JOIN resources r USING (doc_id) WHERE text IS NOT NULL AND query_text <> '' AND contains(text, query_text))
    SELECT mention_id, query_text, list_filter(range(0, length(text)), lambda i: text[i + 1:i + length(query_text)] = query_text AND text[i + 1] = query_text[1]) AS places FROM x"""
)
def quotes_verbatim(spark: SparkSession, folder: str) -> DataFrame:
    """Every place of each quote that stands verbatim in its text."""
    found = quotes_located(spark, folder).where("how = 'verbatim'").dropDuplicates(["mention_id", "query_text"])
    return found.select("mention_id", "query_text", F.transform("spans", lambda x: x["s"].cast("long")).alias("places"))


@query()
def quotes_located(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "mentions").select("mention_id", "doc_id", F.explode("quotes").alias("q")).select("mention_id", "doc_id", "q.query_text")
    texts = table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", "text")
    return documents.located(q.join(texts, "doc_id"), "query_text", "text").select("mention_id", "query_text", "how", "spans")


@query(r"SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(length(regexp_extract(l, '^\s*(#{1,6})\s+\S', 1)) AS INTEGER) AS level, trim(regexp_replace(l, '^\s*#+\s*|\s*#*\s*$', '', 'g')) AS heading FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM resources WHERE text IS NOT NULL) WHERE regexp_matches(l, '^\s*#{1,6}\s+\S')")
def headings(spark: SparkSession, folder: str) -> DataFrame:
    return documents.headings(table(spark, folder, "resources"), "doc_id", "text").where("level < 7").select("doc_id", "line_no", "level", "heading")


def _like(parts: tuple[str, ...]) -> str:
    return "|".join(parts)


def _opens(patterns: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


HEADS = r"h AS (SELECT trim(regexp_replace(l, '^\s*#+\s*|\s*#*\s*$', '', 'g')) AS heading FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM resources WHERE text IS NOT NULL) WHERE regexp_matches(l, '^\s*#{1,6}\s+\S'))"
KIND = f"""CASE WHEN regexp_matches(x, '{_opens(articles.PAYWALL)}') THEN 'paywall' WHEN regexp_matches(x, '{_like(articles.RELEVANT)}') THEN 'relevant'
    WHEN regexp_matches(x, '{_like(articles.IRRELEVANT)}') OR regexp_matches(x, '{_opens(articles.SITE)}') THEN 'irrelevant' ELSE 'neutral' END"""


@query(f"WITH {HEADS}, c AS (SELECT heading, lower(heading) AS x, count(*) AS n FROM h GROUP BY heading) SELECT heading, n, {KIND} AS kind FROM c")
def heading_classes(spark: SparkSession, folder: str) -> DataFrame:
    return documents.headings(table(spark, folder, "resources"), "doc_id", "text").where("level < 7").groupBy("heading", "kind").agg(F.count(F.lit(1)).alias("n"))




@query(
    f"""WITH {HEADS}, c AS (SELECT heading, lower(heading) AS x, count(*) AS n FROM h GROUP BY heading)
    SELECT heading, n, {KIND} AS kind FROM c"""
)
def heading_kinds(spark: SparkSession, folder: str) -> DataFrame:
    marked = documents.headings(table(spark, folder, "resources"), "doc_id", "text").where("level < 7")
    return marked.groupBy("heading").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", articles.kind_column(F.col("heading")))


@query()
def refined_articles(spark: SparkSession, folder: str) -> DataFrame:
    return articles.refined(table(spark, folder, "resources").select("doc_id", "text"), "text").select("doc_id", "refined")


@query()
def core_articles(spark: SparkSession, folder: str) -> DataFrame:
    return documents.without_apparatus(table(spark, folder, "resources"), "doc_id", "text")


@query(
    f"""WITH {QUOTED}, v AS (SELECT q.doc_id, q.s, least(q.e, length(text)) AS e FROM q JOIN resources r ON r.doc_id = q.doc_id WHERE text IS NOT NULL AND q.s >= 0 AND q.e > q.s AND q.s < length(text)), {_runs('v', 60)},
    m AS (SELECT doc_id, island, min(s) AS s, max(e) AS e FROM r GROUP BY ALL), b AS (SELECT m.*, text, CAST(floor(greatest(least(5000.0, length(text) * 0.05), least(300, length(text)))) AS BIGINT) AS budget, coalesce(sum(m.e - m.s) OVER (PARTITION BY m.doc_id ORDER BY m.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM m JOIN resources t ON t.doc_id = m.doc_id)
    SELECT doc_id, island::BIGINT AS island, s, e, CASE WHEN budget - used < e - s THEN regexp_replace(substr(text, s + 1, CAST(budget - used AS INTEGER)), '\\s+\\S*$', '') || '…' ELSE substr(text, s + 1, e - s) END AS passage FROM b WHERE used < budget"""
)
def redacted(spark: SparkSession, folder: str) -> DataFrame:
    return documents.skeletons(quoted(spark, folder), "doc_id", "s", "e", table(spark, folder, "resources"), "text")


@query(
    rf"""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '(?m)^#+[ \t]+(.+?)[ \t]*$', 1) AS h FROM resources)
    SELECT doc_id, CASE WHEN coalesce(regexp_replace(text, '\s', '', 'g'), '') = '' THEN 'EMPTY' WHEN length(text) <= 3500 AND regexp_matches(text, '(?im)^#+[ \t]*abstract\b')
      AND len(list_filter(h[2:], lambda x: NOT regexp_matches(trim(x), '(?i)^(?:{"|".join(documents.BESIDE_ABSTRACT)})\b'))) = 0 THEN 'ABSTRACT' ELSE 'FULL_TEXT' END AS kind FROM h"""
)
def source_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "resources").select("doc_id", documents.source_kind(F.col("text")).alias("kind"))


STOP = ", ".join(f"'{w}'" for w in keywords.STOPWORDS)


@query(
    rf"""WITH p AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \t\n\r') <> '') AS a, text FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc, CASE WHEN len(a) > 1 THEN a ELSE list_filter(regexp_split_to_array(text, '[,;]'), lambda s: trim(s, E' \t\n\r') <> '') END AS a FROM p),
    s AS (SELECT doc, unnest(a) AS x, generate_subscripts(a, 1) AS s FROM c)
    SELECT doc AS doc_id, count(*) AS sentences FROM s GROUP BY doc"""
)
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    split = F.filter(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"\s", "") != "")
    parts = F.when(F.size(split) > 1, split).otherwise(F.filter(F.split("text", "[,;]"), lambda s: F.regexp_replace(s, r"\s", "") != ""))
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.size(parts).cast("long").alias("sentences")).where("sentences > 0")


SENTENCES = r"""p AS (SELECT doc_id, text, list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '\s', '', 'g') <> '') AS a FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a ELSE list_filter(regexp_split_to_array(text, '[,;]'), lambda s: regexp_replace(s, '\s', '', 'g') <> '') END AS a FROM p),
    s AS (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS s FROM c)"""
BEST = "SELECT doc_id, keyword, round(score, 9) AS score FROM (SELECT doc_id, keyword, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, keyword) AS k FROM z) WHERE k <= 10"


@query(
    rf"""WITH {SENTENCES}, w AS (SELECT doc_id, s, list_filter(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({STOP})) AS w FROM s),
    g AS (SELECT doc_id, s, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS keyword FROM w WHERE len(w) > 0),
    t AS (SELECT doc_id, s, keyword, count(*) AS tf FROM g GROUP BY ALL), d AS (SELECT doc_id, keyword, count(*) AS df FROM t GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n FROM w WHERE len(w) > 0 GROUP BY doc_id),
    x AS (SELECT doc_id, s, keyword, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM t JOIN d USING (doc_id, keyword) JOIN n USING (doc_id)), y AS (SELECT doc_id, keyword, sum(x / l) AS v FROM x JOIN (SELECT doc_id, s, sqrt(sum(x * x)) AS l FROM x GROUP BY ALL) USING (doc_id, s) GROUP BY ALL),
    z AS (SELECT doc_id, keyword, v / max(v) OVER (PARTITION BY doc_id) AS score FROM y) {BEST}"""
)
def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.extract(table(spark, folder, "documents"), "doc_id", "text", "tfidf", 10).withColumn("score", F.round("score", 9))


@query(
    rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_''-]+|[^\p{{L}}\p{{N}}_\s''-]+') AS t FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t), b AS (SELECT *, w IN ({STOP}) OR NOT regexp_matches(w, '[\p{{L}}\p{{N}}_]') AS stop FROM u),
    r AS (SELECT doc_id, w, i, sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r, stop FROM b), h AS (SELECT doc_id, r, string_agg(w, ' ' ORDER BY i) AS keyword, list(w ORDER BY i) AS ws FROM r WHERE NOT stop GROUP BY doc_id, r),
    f AS (SELECT doc_id, unnest(ws) AS w, len(ws) AS d FROM h), v AS (SELECT doc_id, w, sum(d) / count(*) AS v FROM f GROUP BY ALL), k AS (SELECT DISTINCT doc_id, keyword, ws FROM h), e AS (SELECT doc_id, keyword, unnest(ws) AS w FROM k),
    y AS (SELECT doc_id, keyword, sum(v) AS v FROM e JOIN v USING (doc_id, w) GROUP BY ALL), z AS (SELECT doc_id, keyword, v / max(v) OVER (PARTITION BY doc_id) AS score FROM y) {BEST}"""
)
def rake(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.extract(table(spark, folder, "documents"), "doc_id", "text", "rake", 10).withColumn("score", F.round("score", 9))


@query()
def yake(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.extract(table(spark, folder, "documents"), "doc_id", "text", "yake", 10).withColumn("score", F.round("score", 9))


@query()
def clean_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return keywords.clean(rake(spark, folder), "keyword", "score")


# --- search and cache ---------------------------------------------------------------------------------------------


@query(
    """WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY result_id) AS n FROM search_results WHERE url <> '') WHERE n <= 20)
    SELECT result_id, relevance / CASE WHEN coalesce(max(relevance) OVER (PARTITION BY query), 0) = 0 THEN 1 ELSE max(relevance) OVER (PARTITION BY query) END AS relevance FROM k"""
)
def search_scores(spark: SparkSession, folder: str) -> DataFrame:
    return search.score_relevance(table(spark, folder, "search_results"), "query", "relevance", "result_id", 20).select("result_id", "relevance")


@query("SELECT regexp_replace(url, '#.*$', '') AS u, min(result_id) AS result_id, count(*) AS hits FROM search_results GROUP BY u")
def first_results(spark: SparkSession, folder: str) -> DataFrame:
    bare = scalars.without_fragment(F.col("url"))
    got = search.first_results(table(spark, folder, "search_results"), bare, [F.col("result_id")])
    return got.select(bare.alias("u"), "result_id", "hits")


@query("WITH n AS (SELECT regexp_replace(url, '#.*$', '') AS url, min(result_id) AS o FROM search_results WHERE url IS NOT NULL GROUP BY 1) SELECT url, CAST(row_number() OVER (ORDER BY o, url) AS BIGINT) AS number FROM n WHERE url NOT IN (SELECT url FROM resources)")
def registered(spark: SparkSession, folder: str) -> DataFrame:
    pool = table(spark, folder, "resources").select("url")
    new = search.register(table(spark, folder, "search_results"), "url", "result_id", pool)
    return new.select("url", (F.split_part("doc_id", F.lit("_"), F.lit(1)).cast("long") - pool.count()).alias("number"))


@query("SELECT query, CAST(floor((row_number() OVER (PARTITION BY query ORDER BY relevance DESC NULLS LAST, result_id) - 1) / 50) AS BIGINT) AS batch, result_id FROM search_results")
def result_batches(spark: SparkSession, folder: str) -> DataFrame:
    ranked = table(spark, folder, "search_results").select("query", "result_id", F.coalesce(-F.col("relevance"), F.lit(1.0)).alias("down"))
    got = search.batches(ranked, ["down", "result_id"], 50, ["query"])
    return got.select("query", F.col("batch").cast("long").alias("batch"), "result_id")


@query("SELECT url, arg_max(result_id, (loaded_at, result_id)) AS result_id FROM search_results WHERE url IS NOT NULL GROUP BY url")
def latest_per_url(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "search_results").where("url IS NOT NULL").select("url", "result_id", "loaded_at")
    return search.latest(rows, ["url"], ["loaded_at", "result_id"]).select("url", "result_id")


@query("SELECT result_id FROM search_results WHERE url IS NOT NULL AND NOT (lower(url) LIKE '%rasaranu%' OR lower(url) LIKE 'http://%')")
def cleared_cache(spark: SparkSession, folder: str) -> DataFrame:
    patterns = spark.createDataFrame([("Rasaranu",), ("http://*",)], "pattern string")
    return search.clear(table(spark, folder, "search_results").where("url IS NOT NULL"), patterns).select("result_id")


@query("SELECT s.result_id, r.doc_id FROM search_results s LEFT JOIN resources r ON r.url = s.url WHERE s.url IS NOT NULL")
def cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    cache = table(spark, folder, "resources").select("url", "doc_id")
    return search.with_cache(table(spark, folder, "search_results").where("url IS NOT NULL").select("result_id", "url"), "url", cache).select("result_id", "doc_id")


@query("SELECT DISTINCT topic FROM documents WHERE topic IS NOT NULL EXCEPT SELECT topic FROM documents WHERE lang = 'fr'")
def open_goals(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("topic IS NOT NULL")
    return d.select("topic").distinct().join(d.where("lang = 'fr'").select("topic"), "topic", "left_anti")


# --- stages -------------------------------------------------------------------------------------------------------


@query()
def swept_co_mentions(spark: SparkSession, folder: str) -> DataFrame:
    found = pipeline.positions(table(spark, folder, "mentions"), "doc_id", "name", "aliases", table(spark, folder, "resources"), "text")
    known = pipeline.co_located(quoted(spark, folder), "doc_id", "name", "s", "e", 0)
    return pipeline.sweep(found, "doc_id", "name", known, 100)


@query()
def consolidated_names(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.consolidate(table(spark, folder, "mentions"), "name", "aliases", 0.5)


@query(
    f"""WITH {ASSESSMENTS}, o(a, b) AS (VALUES ('RF', 'NO'), ('AF', 'NF')), e AS (SELECT a, b FROM o UNION SELECT b, a FROM o), s AS (SELECT * FROM a WHERE overall >= 7),
    m AS (SELECT e1, quantile_disc(overall, 0.5) AS m, quantile_disc(relevance, 0.5) AS r FROM a GROUP BY e1), h AS (SELECT e1, count(*) AS strong, quantile_disc(relevance, 0.5) AS h FROM s GROUP BY e1),
    c AS (SELECT e1, label, count(*) AS k, min(ord) AS o FROM a GROUP BY ALL), f AS (SELECT e1, arg_max(label, (k, -o, label)) AS label FROM c GROUP BY e1),
    d AS (SELECT e1, label, count(*) AS k, min(ord) AS o FROM s GROUP BY ALL), g AS (SELECT e1, arg_max(label, (k, -o, label)) AS best FROM d GROUP BY e1),
    x AS (SELECT DISTINCT p.e1 FROM s p JOIN e ON p.label = e.a JOIN s q ON q.e1 = p.e1 AND q.label = e.b),
    j AS (SELECT m.e1, m, r, h, coalesce(strong, 0) >= 2 AND x.e1 IS NULL AS sure, strong, f.label, g.best FROM m JOIN f USING (e1) LEFT JOIN h USING (e1) LEFT JOIN g USING (e1) LEFT JOIN x USING (e1))
    SELECT e1, sure OR m >= 5 AS accepted, CASE WHEN sure THEN best ELSE label END AS label, CAST(CASE WHEN sure AND strong >= 3 THEN 0.95 WHEN sure THEN 0.85 ELSE 0.5 END AS DOUBLE) AS confidence, CAST(coalesce(h, r) AS INTEGER) AS relevance FROM j"""
)
def judged_pairs(spark: SparkSession, folder: str) -> DataFrame:
    opposed = spark.createDataFrame([("RF", "NO"), ("AF", "NF")], "a string, b string")
    return pipeline.judge(assessments(spark, folder), ["e1"], "overall", "label", "relevance", "ord", opposed).withColumn("relevance", F.col("relevance").cast("int"))


@query(
    """WITH RECURSIVE c AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, text) AS k FROM chunk_data WHERE text IS NOT NULL), d AS (SELECT r.doc_id, r.text AS t FROM resources r WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM c)),
    w AS (SELECT doc_id, 0 AS k, 0 AS pos, CAST([] AS STRUCT("start" INTEGER, "end" INTEGER)[]) AS spans FROM d
      UNION ALL SELECT w.doc_id, c.k, CASE WHEN f > 0 AND length(c.text) > 0 THEN w.pos + f - 1 + length(c.text) ELSE w.pos END, CASE WHEN f > 0 AND length(c.text) > 0 THEN list_append(spans, {'start': (w.pos + f - 1)::INTEGER, 'end': (w.pos + f - 1 + length(c.text))::INTEGER}) ELSE spans END
      FROM (SELECT w.*, strpos(substr(d.t, w.pos + 1), n.text) AS f FROM w JOIN d USING (doc_id) JOIN c n ON n.doc_id = w.doc_id AND n.k = w.k + 1) w JOIN c ON c.doc_id = w.doc_id AND c.k = w.k + 1)
    SELECT doc_id, list_transform(arg_max(spans, k), lambda x: x['start']) AS starts, list_transform(arg_max(spans, k), lambda x: x['end']) AS ends FROM w GROUP BY doc_id"""
)
def chunk_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where the stored pieces of each text stand in it."""
    item = F.struct("chunk_no", "text")
    pieces = table(spark, folder, "chunk_data").where("text IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    texts = table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", F.col("text").alias("t"))
    return pieces.join(texts, "doc_id").select("doc_id", pipeline.chunk_places(F.transform("c", lambda x: x["text"]), F.col("t")).alias("spans")).select("doc_id", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


@query("WITH x AS (SELECT label, 1 + vec_id % 3 AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, round(sum(w * v::DOUBLE) / sum(w), 5) AS v FROM x GROUP BY label, i) SELECT label, list(v ORDER BY i) AS embedding FROM m GROUP BY label")
def mean_vectors(spark: SparkSession, folder: str) -> DataFrame:
    got = pipeline.weighted_mean(table(spark, folder, "embeddings"), ["label"], "embedding", 1 + F.col("vec_id") % 3)
    return got.withColumn("embedding", F.transform("embedding", lambda x: F.round(x, 5)))


@query(
    f"""WITH {QUOTED}, {_runs('q', 200)}, p AS (SELECT DISTINCT doc_id, island, name FROM r)
    SELECT DISTINCT a.doc_id, a.name AS first, b.name AS second FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.island = b.island AND a.name < b.name"""
)
def co_located(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.co_located(quoted(spark, folder), "doc_id", "name", "s", "e", 200)


@query(
    f"""WITH {QUOTED}, {_runs('q', 200)}, k AS (SELECT name, arg_min(kind, mention_id) AS kind FROM mentions GROUP BY name), p AS (SELECT DISTINCT doc_id, island, name FROM r)
    SELECT DISTINCT a.doc_id, a.name AS first, b.name AS second FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.island = b.island AND a.name < b.name JOIN k x ON x.name = a.name JOIN k y ON y.name = b.name WHERE x.kind <> y.kind OR x.kind = 'gene'"""
)
def permitted_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Entities quoted near each other whose kinds may pair: different ones, and genes with genes."""
    kinds = entities.first_kind(table(spark, folder, "mentions"), "name", "kind", "mention_id")
    allowed = scalars.permitted_kinds(F.array(*[F.lit(k) for k in ("gene", "gene", *(r["kind"] for r in kinds.select("kind").where("kind <> 'gene'").distinct().collect()))]))
    return pipeline.permitted(pipeline.co_located(quoted(spark, folder), "doc_id", "name", "s", "e", 200), "first", "second", kinds, allowed)


@query(
    """WITH m AS (SELECT chunk_id, unnest(map_entries(metadata)) AS e FROM chunk_data), a AS (SELECT chunk_id, e.key AS k, e.value AS v FROM m)
    SELECT coalesce(x.chunk_id, y.chunk_id - 1) AS chunk_id, coalesce(x.k, y.k) AS path, x.v AS saved, y.v AS live FROM a x FULL JOIN a y ON x.chunk_id = y.chunk_id - 1 AND x.k = y.k WHERE x.v IS DISTINCT FROM y.v"""
)
def metadata_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata of each chunk against that of the next one."""
    c = table(spark, folder, "chunk_data").select("chunk_id", "metadata")
    return pipeline.map_diff(c, c.withColumn("chunk_id", F.col("chunk_id") - 1), ["chunk_id"], "metadata")


@query("SELECT mention_id, list_distinct(coalesce(aliases, [])).len()::BIGINT AS n FROM mentions")
def alias_counts(spark: SparkSession, folder: str) -> DataFrame:
    distinct = F.array_distinct(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: x.isNotNull()))
    return table(spark, folder, "mentions").select("mention_id", F.size(distinct).cast("long").alias("n"))


@query("SELECT r.doc_id, count(m.mention_id) AS n FROM resources r LEFT JOIN mentions m ON m.doc_id = r.doc_id AND m.kind IN ('gene', 'disease') GROUP BY r.doc_id")
def kinds_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Mentions of the wanted kinds in every document, those without any included."""
    kept = table(spark, folder, "mentions").where(F.col("kind").isin("gene", "disease")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, folder, "resources").select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("WITH n AS (SELECT kind, source_norm AS a, target_norm AS b FROM merge_rules WHERE source_norm <> target_norm), s AS (SELECT kind, a, b FROM n UNION SELECT kind, b, a FROM n) SELECT kind, a, count(*) AS neighbours FROM s GROUP BY kind, a")
def neighbour_sets(spark: SparkSession, folder: str) -> DataFrame:
    n = table(spark, folder, "merge_rules").where("source_norm <> target_norm").select("kind", F.col("source_norm").alias("a"), F.col("target_norm").alias("b"))
    return n.unionByName(n.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("kind", "a").agg(F.count(F.lit(1)).alias("neighbours"))


# --- reports ------------------------------------------------------------------------------------------------------


@query("SELECT query, result_id, round(1 / (1 + exp(-relevance)), 9) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC NULLS LAST, result_id) AS k FROM search_results) WHERE k <= 5 AND relevance IS NOT NULL")
def reranked_results(spark: SparkSession, folder: str) -> DataFrame:
    got = report.reranked(table(spark, folder, "search_results"), ["query"], "relevance", "result_id", 5)
    return got.where("relevance IS NOT NULL").select("query", "result_id", F.round("probability", 9).alias("probability"))


@query("SELECT coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, coalesce(topic, '-') AS topic, CAST(sum(n_chars) AS BIGINT) AS tokens, count(*) AS calls, grouping(lang) * 4 + grouping(source) * 2 + grouping(topic) AS level FROM documents GROUP BY ROLLUP (lang, source, topic)")
def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    got = report.usage(table(spark, folder, "documents"), "lang", "source", "topic", "n_chars")
    return got.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in ("lang", "source", "topic")], "tokens", "calls", F.col("level").cast("long").alias("level"))


@query("SELECT mention_id AS k, doc_id, doc_id IN (SELECT doc_id FROM resources WHERE text IS NOT NULL) AS known FROM mentions")
def cited_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that reasons of mentions cite, and whether their texts are there."""
    texts = table(spark, folder, "mentions").select(F.col("mention_id").alias("k"), F.concat(F.coalesce("reasoning", F.lit("")), F.lit(" ["), F.col("doc_id"), F.lit("]")).alias("t"))
    return report.cited(texts, "k", "t", table(spark, folder, "resources").where("text IS NOT NULL"), "doc_id")


@query(f"WITH {ASSESSMENTS}, l AS (SELECT e1, doc, label, min(ord) AS o, count(*) AS c FROM a GROUP BY ALL) SELECT e1, doc, list(label ORDER BY o, label) AS labels, CAST(sum(c) AS BIGINT) AS n FROM l GROUP BY e1, doc")
def document_groups(spark: SparkSession, folder: str) -> DataFrame:
    return report.document_groups(assessments(spark, folder), ["e1"], "doc", "label", "ord")


@query(f"WITH {QUOTED}, {_runs('q', -1)} SELECT doc_id, arg_max(s, (e - s, -s)) AS s, arg_max(e, (e - s, -s)) AS e, count(*) AS merged FROM r GROUP BY doc_id, island")
def overlapping_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return report.overlapping_quotes(quoted(spark, folder), ["doc_id"], "s", "e")


@query(
    f"""WITH {QUOTED}, d AS (SELECT DISTINCT q.doc_id, s, e, text, text[201:] AS kept FROM q JOIN resources r ON r.doc_id = q.doc_id WHERE text IS NOT NULL)
    SELECT doc_id, s, e, CAST(strpos(kept, substr(text, s + 1, e - s)) - 1 AS BIGINT) AS new_start FROM d"""
)
def relocated_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes looked up in the texts without their first 200 characters; -1 where they are gone."""
    texts = table(spark, folder, "resources").where("text IS NOT NULL").select("doc_id", F.col("text").alias("old"), F.expr("substring(text, 201)").alias("new"))
    spans = quoted(spark, folder).select("doc_id", "s", "e").distinct().join(texts, "doc_id")
    return report.relocated(spans, "old", "new", "s", "e").select("doc_id", "s", "e", F.coalesce("new_start", F.lit(-1)).cast("long").alias("new_start"))


@query("SELECT DISTINCT s.url FROM search_results s WHERE s.url IN (SELECT url FROM resources WHERE doi IS NOT NULL AND licence = 'closed') OR s.url IN (SELECT url FROM resources WHERE text IS NULL)")
def previously_failed(spark: SparkSession, folder: str) -> DataFrame:
    """Pages found again that were never fetched, or whose DOI leads to a closed text."""
    r = table(spark, folder, "resources")
    doi = F.concat(F.lit("https://doi.org/"), F.col("doi"))
    hops = r.where("doi IS NOT NULL").select("url", doi.alias("target"))
    closed = r.where("doi IS NOT NULL AND licence = 'closed'").select(doi.alias("url"), F.lit("HTTP 403").alias("reason"))
    failures = closed.unionByName(r.where("text IS NULL").select("url", F.lit("HTTP 500").alias("reason")))
    return report.previously_failed(table(spark, folder, "search_results").where("url IS NOT NULL"), "url", hops, failures, 2)


@query("SELECT 'search' AS stage, CAST(row_number() OVER (ORDER BY result_id) - 1 AS BIGINT) AS place, result_id AS description FROM search_results UNION ALL SELECT 'extract', CAST(row_number() OVER (ORDER BY mention_id) - 1 AS BIGINT), name FROM mentions UNION ALL SELECT 'search', count(*), 'end of stage' FROM search_results UNION ALL SELECT 'extract', count(*), 'end of stage' FROM mentions")
def stage_events(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "search_results").select(F.substring("result_id", 2, 20).cast("long").alias("o"), F.col("result_id").alias("description"))
    m = table(spark, folder, "mentions").select(F.col("mention_id").alias("o"), F.col("name").alias("description"))
    return report.stage_events({"search": s, "extract": m}, "o")


# --- decisions and events -----------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT kind, source_norm, arg_max(decided_by, (event, rule_id)) AS d FROM merge_rules GROUP BY kind, source_norm)
    SELECT m.mention_id, coalesce(d.d, 'skip') AS decision, d.kind IS NOT NULL AS hit FROM mentions m LEFT JOIN d ON d.kind = m.kind AND d.source_norm = lower(m.name)"""
)
def decisions_replayed(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder).select("mention_id", "decision", "hit")


def _replayed(spark: SparkSession, folder: str) -> DataFrame:
    key = lambda k, n: decisions.input_key(F.col(k), n)
    recorded = table(spark, folder, "merge_rules").select(key("kind", F.col("source_norm")).alias("key"), F.col("decided_by").alias("decision"), F.struct("event", "rule_id").alias("event"))
    asked = table(spark, folder, "mentions").select("mention_id", "kind", key("kind", F.lower("name")).alias("key"))
    return decisions.replay(asked, "key", recorded, F.lit("skip"))


@query(
    """WITH d AS (SELECT DISTINCT kind, source_norm FROM merge_rules), x AS (SELECT m.kind, d.kind IS NOT NULL AS hit FROM mentions m LEFT JOIN d ON d.kind = m.kind AND d.source_norm = lower(m.name))
    SELECT kind, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM x GROUP BY kind"""
)
def decision_hits(spark: SparkSession, folder: str) -> DataFrame:
    return decisions.hit_counts(_replayed(spark, folder), "kind")


@query("SELECT event_id, seq FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS seq FROM events) WHERE seq >= 100")
def event_log(spark: SparkSession, folder: str) -> DataFrame:
    return log.since(log.numbered(table(spark, folder, "events").select("event_id", "ts"), ["ts", "event_id"]), 100).select("event_id", "seq")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000")
def event_tail(spark: SparkSession, folder: str) -> DataFrame:
    numbered = log.numbered(table(spark, folder, "events").select("event_id", "ts", "event_type"), ["ts", "event_id"])
    return log.tail(numbered, ["event_type"]).select("event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return log.windowed_counts(table(spark, folder, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT event_id, event_type FROM events")
def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All events once, through a stream that is drained into the shared folder."""
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{{events}}.parquet").select("event_id", "event_type")
    return log.drained(spark, stream, "events")


@query(
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS o FROM events),
    y AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, k"""
)
def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return log.sessions(table(spark, folder, "events"), "ts", "user_id")


# ------------------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return pair_rank(spark, folder)


def queries() -> dict[str, Query]:
    from evidara import catalog_articles, catalog_pairs, catalog_sources  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)


