"""The pN_ queries and their SQL."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.llm import boilerplate, components, confusables, dictionary, mixing, nearest, packing, residue, splitting

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.group_linked(_read(spark, folder, "merge_rules"), "kind", "source_norm", "target_norm")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.find_furniture(_read(spark, folder, "resources"))


def p3_articles(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.keep_articles(_read(spark, folder, "resources").select("doc_id", "url", "title", "text")).select("doc_id", "article")


def p3_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of furniture alignments shared."""
    return boilerplate.evidence(_read(spark, folder, "resources"))


MENTION = {"id_col": "mention_id", "exact": ["doc_id", "kind"], "written": ["name"], "bags": ["aliases"]}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = dictionary.format_groups(_read(spark, folder, "mentions"), **MENTION)
    return groups.where("first_id <> mention_id").select("first_id", "mention_id")


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return dictionary.collapse(_read(spark, folder, "mentions"), **MENTION).select("mention_id", "doc_id", "kind", "name", "copies")


def _chunk_pieces(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = splitting.size_limit(_read(spark, folder, "size_limits"), "chunk")
    return splitting.split_chunks(_read(spark, folder, "resources"), limit, overlap)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_pieces(spark, folder).where("piece_no = 0").select("doc_id", "chunk_no")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _chunk_pieces(spark, folder)


def p4_chunk_data(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = splitting.size_limit(_read(spark, folder, "size_limits"), "chunk")
    return splitting.split_oversized(_read(spark, folder, "chunk_data"), ["chunk_id"], "text", limit, overlap)


def _rebuilt(pieces: DataFrame, keys: list[str], limit: int, overlap: int) -> DataFrame:
    """For each cut text the digest of what its pieces make without their overlaps, and whether limit and overlap are kept."""
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "text")))
    rows = pieces.groupBy(*keys).agg(ordered.alias("p"))
    own = F.transform("p", lambda p, i: F.when(i == 0, p["text"]).otherwise(F.substring(p["text"], F.lit(overlap + 1), F.length(p["text"]))))
    fits = F.forall("p", lambda p: (F.length(p["text"]) <= limit) & (p["end"] - p["start"] == F.length(p["text"])))
    meets = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.element_at("p", i + 1)["start"] == F.element_at("p", i)["end"] - overlap)
    return rows.select(*keys, F.md5(F.array_join(own, "")).alias("digest"), (fits & meets & (F.size("p") > 1)).alias("kept"))


def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    """Every oversized span put together again from its pieces."""
    limit, overlap = splitting.size_limit(_read(spark, folder, "size_limits"), "chunk")
    return _rebuilt(_chunk_pieces(spark, folder), ["doc_id", "chunk_no"], limit, overlap)


def p4_chunks_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = splitting.size_limit(_read(spark, folder, "size_limits"), "chunk")
    return _rebuilt(p4_chunk_data(spark, folder), ["chunk_id"], limit, overlap)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    terms = _read(spark, folder, "entity_terms")
    alias = confusables.find_look_alikes(_read(spark, folder, "mentions"), "mention_id", "aliases", terms, whole=True)
    words = confusables.find_look_alikes(_read(spark, folder, "resources"), "doc_id", "text", terms, whole=False)
    named = [d.select(F.lit(t).alias("table_name"), "record_id", "term_id") for t, d in (("mentions", alias), ("resources", words))]
    return named[0].unionByName(named[1])


def p5_unified_aliases(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.unify_texts(_read(spark, folder, "mentions").select("mention_id", "aliases"), "aliases")


def p5_unified_texts(spark: SparkSession, folder: str) -> DataFrame:
    return confusables.unify_texts(_read(spark, folder, "resources").select("doc_id", "text"), "text")


def _near(spark: SparkSession, folder: str, find: Callable[..., tuple[DataFrame, DataFrame]]) -> list[tuple[str, DataFrame, DataFrame]]:
    results = _read(spark, folder, "search_results").select("result_id", F.lower(F.concat("title", F.lit(" "), "url")).alias("text"))
    pages = _read(spark, folder, "resources").select("doc_id", "text")
    return [
        ("resources", *find(pages, "doc_id", "text", nearest.Units("words", 3), 0.6)),
        ("search_results", *find(results, "result_id", "text", nearest.Units("characters", 4), 0.6)),
    ]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [nearest.near_pairs(m, p).select(F.lit(t).alias("table_name"), "id_a", "id_b") for t, m, p in _near(spark, folder, nearest.near_groups)]
    return found[0].unionByName(found[1])


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with the smallest id of its group: records linked directly or through others."""
    found = _near(spark, folder, nearest.near_links)
    named = lambda k: reduce(DataFrame.unionByName, [f[k].withColumn("table_name", F.lit(f[0])) for f in found])
    linked = components.group_linked(named(2), "table_name", "rep_a", "rep_b")
    heads = linked.select("table_name", F.col("entity_name").alias("rep"), "group_name")
    groups = named(1).join(heads, ["table_name", "rep"], "left")
    return groups.select("table_name", F.col("id").alias("record_id"), F.coalesce("group_name", "rep").alias("group_id"))


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    capacity, _ = splitting.size_limit(_read(spark, folder, "size_limits"), "container")
    return packing.pack(_read(spark, folder, "documents"), "doc_id", "text", capacity)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    loads = p7_containers(spark, folder).groupBy("container_id").agg(F.sum("size").alias("load"))
    return loads.agg(F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("most"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For each document whether its pieces follow each other from its beginning to its end, and for each whether no
    container holds more than the capacity and no text is cut that fits."""
    capacity, _ = splitting.size_limit(_read(spark, folder, "size_limits"), "container")
    placed = p7_containers(spark, folder)
    loads = placed.groupBy("container_id").agg(F.sum("size").alias("load"))
    cut = F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "size", "load")))
    rows = placed.join(loads, "container_id").groupBy("doc_id").agg(cut.alias("p"))
    whole = (F.element_at("p", 1)["start"] == 0) & F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: (i == 1) | (F.get("p", i - 1)["start"] == F.get("p", i - 2)["end"]))
    needed = (F.size("p") == 1) | (F.aggregate("p", F.lit(0), lambda n, x: n + x["size"]) > capacity)
    return rows.select("doc_id", F.element_at("p", -1)["end"].alias("characters"), (whole & needed & F.forall("p", lambda x: x["load"] <= capacity)).alias("kept"))


def p8_kept(spark: SparkSession, folder: str) -> DataFrame:
    """For each source whether its tokens are those of its share, but for rounding to blocks and a last block that is short
    once a pass, and whether no block is used beyond its cap."""
    weights = _read(spark, folder, "source_weights")
    shares = p8_shares(spark, folder).join(weights.select("source", "max_repeats"), "source")
    slack = shares.agg(F.sum("tokens").alias("total"), F.sum((F.col("max_repeats") + 1) * mixing.BLOCK_TOKENS).alias("slack"))
    off = F.abs(F.col("tokens") - F.col("target_share") * F.col("total"))
    met = off <= (F.col("max_repeats") + 1) * mixing.BLOCK_TOKENS + F.col("target_share") * F.col("slack")
    rows = shares.join(slack)  # one row
    return rows.select("source", "target_share", met.alias("share_met"), (F.col("most_uses") <= F.col("max_repeats")).alias("cap_kept"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_read(spark, folder, "documents"), _read(spark, folder, "source_weights"), "doc_id", "text", "source")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.reached(p8_mix(spark, folder), _read(spark, folder, "source_weights"), "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(_read(spark, folder, "documents"), "doc_id", "text").select("doc_id").distinct()


def p9_clean(spark: SparkSession, folder: str) -> DataFrame:
    return residue.exclude_residue(_read(spark, folder, "documents"), "doc_id", "text").select("doc_id", "lang", "source", "n_chars")


P2_FORM = r"lower(upper(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g')))"

ORACLE = {
    "p1_found": """
        WITH RECURSIVE l AS (
          SELECT DISTINCT kind, source_norm a, target_norm b FROM merge_rules WHERE source_norm <> target_norm
          UNION SELECT DISTINCT kind, target_norm, source_norm FROM merge_rules WHERE source_norm <> target_norm
        ), reach AS (
          SELECT DISTINCT kind, a AS entity_name, a AS other FROM l
          UNION SELECT r.kind, r.entity_name, l.b FROM reach r JOIN l ON l.kind = r.kind AND l.a = r.other
        )
        SELECT kind, entity_name, min(other) AS group_name FROM reach GROUP BY kind, entity_name""",
    "p2_found": f"""
        WITH f AS (
          SELECT mention_id, doc_id, kind, {P2_FORM.format("coalesce(name, '')")} AS n,
            list_sort(list_transform(coalesce(aliases, []), lambda x: {P2_FORM.format("coalesce(x, '')")})) AS al
          FROM mentions
        ), g AS (SELECT mention_id, min(mention_id) OVER (PARTITION BY doc_id, kind, n, al) AS first_id FROM f)
        SELECT first_id, mention_id FROM g WHERE first_id <> mention_id""",
    "p2_collapsed": f"""
        WITH f AS (
          SELECT *, {P2_FORM.format("coalesce(name, '')")} AS n,
            list_sort(list_transform(coalesce(aliases, []), lambda x: {P2_FORM.format("coalesce(x, '')")})) AS al
          FROM mentions
        ), g AS (SELECT mention_id, doc_id, kind, name, min(mention_id) OVER w AS first_id, count(*) OVER w AS copies FROM f
                 WINDOW w AS (PARTITION BY doc_id, kind, n, al))
        SELECT mention_id, doc_id, kind, name, copies FROM g WHERE first_id = mention_id""",
    "p4_found": """
        WITH s AS (
          SELECT doc_id, text, CASE WHEN len(coalesce(chunks, [])) > 0 THEN chunks ELSE [{'start': 0, 'end': length(text)}] END AS c
          FROM resources WHERE text IS NOT NULL
        ), e AS (SELECT doc_id, text, unnest(c) AS p, generate_subscripts(c, 1) - 1 AS chunk_no FROM s)
        SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no FROM e
        WHERE least(p['end'], length(text)) - p['start'] > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk')""",
}

ORACLE["p4_rebuilt"] = """
    WITH s AS (
      SELECT doc_id, text, CASE WHEN len(coalesce(chunks, [])) > 0 THEN chunks ELSE [{'start': 0, 'end': length(text)}] END AS c
      FROM resources WHERE text IS NOT NULL
    ), e AS (SELECT doc_id, text, unnest(c) AS p, generate_subscripts(c, 1) - 1 AS chunk_no FROM s)
    SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, md5(substr(text, p['start'] + 1, least(p['end'], length(text)) - p['start'])) AS digest, true AS kept FROM e
    WHERE least(p['end'], length(text)) - p['start'] > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk')"""
ORACLE["p4_chunks_rebuilt"] = """
    SELECT chunk_id, md5(text) AS digest, true AS kept FROM chunk_data
    WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'chunk')"""

ORACLE["p7_kept"] = "SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, true AS kept FROM documents WHERE text IS NOT NULL"
ORACLE["p8_kept"] = "SELECT source, target_share, true AS share_met, true AS cap_kept FROM source_weights"

#: SQL for the pairs of p6.
NEAR = r"""
    w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM resources WHERE text IS NOT NULL),
    s AS (SELECT result_id, lower(title || ' ' || url) AS s FROM search_results WHERE title IS NOT NULL AND url IS NOT NULL),
    u AS (SELECT 'resources' AS t, doc_id AS id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM w
          UNION ALL SELECT 'search_results', result_id, unnest(list_distinct(list_transform(range(1, length(s) - 2), lambda i: substr(s, i, 4)))) FROM s),
    n AS (SELECT t, id, count(*) AS n FROM u GROUP BY t, id),
    p AS (SELECT a.t, a.id AS id_a, b.id AS id_b, count(*) AS c FROM u a JOIN u b ON a.t = b.t AND a.g = b.g AND a.id < b.id GROUP BY ALL),
    f AS (SELECT p.t AS table_name, id_a, id_b FROM p JOIN n x ON x.t = p.t AND x.id = id_a JOIN n y ON y.t = p.t AND y.id = id_b WHERE c >= 0.6 * (x.n + y.n - c))"""
ORACLE["p6_found"] = f"WITH {NEAR} SELECT * FROM f"
ORACLE["p6_groups"] = f"""
    WITH RECURSIVE {NEAR},
    d AS (SELECT 'resources' AS t, doc_id AS id, lower(text) AS k FROM resources WHERE text IS NOT NULL
          UNION ALL SELECT 'search_results', result_id, s FROM s),
    e AS (SELECT table_name AS t, id_a AS a, id_b AS b FROM f UNION SELECT table_name, id_b, id_a FROM f
          UNION SELECT x.t, x.id, y.id FROM d x JOIN d y ON x.t = y.t AND x.k = y.k),
    reach AS (SELECT t, id, id AS other FROM d UNION SELECT r.t, r.id, e.b FROM reach r JOIN e ON e.t = r.t AND e.a = r.other)
    SELECT t AS table_name, id AS record_id, min(other) AS group_id FROM reach GROUP BY t, id"""


def _unified(value: str) -> str:
    """SQL for the unified form of a text, letter by letter."""
    single, gone, several = {}, [], []
    for code, form in confusables._TABLE.items():
        if len(form) == 1:
            single[chr(code)] = form
        elif not form:
            gone.append(chr(code))
        elif form.isascii() and form.isalpha():
            several.append((chr(code), form))
    for code in (*range(0x250, 0x590), *range(0x13A0, 0x1400), *range(0x1D00, 0x1D80), *range(0x2C80, 0x2D00), *range(0xA4D0, 0xA500), *range(0xA720, 0xA800), 0x131):
        letters = unicodedata.normalize("NFD", chr(code))
        if letters[0] in confusables._TO_LATIN and letters[0] not in confusables.SYMBOLS:
            form = unicodedata.normalize("NFC", "".join(confusables._TO_LATIN.get(c, c) for c in letters))
            single |= {chr(code): form} if len(form) == 1 else {}
    out = value
    for a, b in several:
        if 0xFB00 <= ord(a) <= 0xFB06:
            out = f"replace({out}, '{a}', '{b}')"
    quoted = lambda x: x.replace("'", "''")
    out = f"nfc_normalize(translate({out}, '{quoted(''.join(single) + ''.join(gone))}', '{quoted(''.join(single.values()))}'))"
    for a in sorted(confusables.SYMBOLS & set(confusables._TO_LATIN)):
        b = confusables._TO_LATIN[a]
        out = rf"regexp_replace(regexp_replace({out}, '([a-z]){a}', '\1{b}', 'g'), '{a}([a-z])', '{b}\1', 'g')"
    return out


def _places(text: str, name: str) -> str:
    """SQL for the number of places where ``name`` stands in ``text`` as whole words."""
    spaced = rf"regexp_replace({text}, '([^\p{{L}}\p{{N}}\p{{M}}])', '\1\1', 'g')"
    return rf"len(regexp_extract_all(' ' || {spaced} || ' ', '[^\p{{L}}\p{{N}}\p{{M}}]' || regexp_escape(regexp_replace({name}, '([^\p{{L}}\p{{N}}\p{{M}}])', '\1\1', 'g')) || '[^\p{{L}}\p{{N}}\p{{M}}]'))"


ORACLE["p5_found"] = f"""
    WITH t AS (SELECT term_id, name, {_unified("name")} AS form FROM entity_terms WHERE name IS NOT NULL AND name <> ''),
    a AS (SELECT mention_id, unnest(aliases) AS raw FROM mentions),
    r AS (SELECT doc_id, text AS raw, {_unified("text")} AS u FROM resources WHERE text IS NOT NULL)
    SELECT DISTINCT 'mentions' AS table_name, CAST(mention_id AS VARCHAR) AS record_id, term_id FROM a JOIN t ON {_unified("raw")} = form AND raw <> name
    UNION ALL SELECT 'resources', doc_id, term_id FROM r JOIN t ON contains(u, form) AND raw <> u
    WHERE {_places("u", "form")} > {_places("raw", "name")}"""

ORACLE["p5_unified_aliases"] = f"SELECT mention_id, list_transform(aliases, lambda x: {_unified('x')}) AS aliases FROM mentions"
ORACLE["p5_unified_texts"] = f"SELECT doc_id, {_unified('text')} AS text FROM resources"


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_collapsed, p3_found, p3_articles, p3_evidence, p4_found, p4_pieces, p4_chunk_data, p4_rebuilt, p4_chunks_rebuilt, p5_found, p5_unified_aliases, p5_unified_texts, p6_found, p6_groups, p7_containers, p7_fill, p7_kept, p8_mix, p8_shares, p8_kept, p9_found, p9_clean)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
