import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidara.functions import names
from evidara.operators import bookkeeping, chunking, documents, entities, evidence, fetched, filters, keywords, relations


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- filters


def test_options_and_levels():
    assert filters.options(["accepted:yes", "evidence=7+", "gene:A=B", "accepted:no"]) == {"accepted": "no", "evidence": "7+", "gene": "A=B"}
    assert [filters.level(v) for v in ("any", "7", "7+", " 9 ")] == [1, 7, 7, 9]
    for bad in ("0", "10", "x", "", "+"):
        with pytest.raises(ValueError):
            filters.level(bad)
    for bad in (["noseparator"], [":x"], ["key:"]):
        with pytest.raises(ValueError):
            filters.options(bad)


def test_filters_are_parsed_and_checked():
    assert filters.parse({"on-topic": "OFF", "Accepted": "True", "evidence": "any", "Gene": "BRCA"}) == filters.Filters("yes", 1, "fail", (("gene", "brca"),))
    for bad in ({"accepted": "perhaps"}, {"subject": "x"}, {"thing": "y"}):
        with pytest.raises(ValueError):
            filters.parse(bad, ["gene"])


def test_predicate(spark):
    rows = [(1, True, 8, None, "gene", "A", "drug", "B"), (2, False, 8, True, "gene", "a", "drug", "C"), (3, None, 3, False, "gene", "X", "gene", "A"), (4, True, None, True, "drug", "A", "drug", "A")]
    df = spark.createDataFrame(rows, "i int, ok boolean, o int, t boolean, k1 string, n1 string, k2 string, n2 string")
    kept = lambda **f: {r["i"] for r in df.where(filters.predicate(filters.Filters(**f), F.col("ok"), F.col("o"), F.col("t"), [(F.col("k1"), F.col("n1")), (F.col("k2"), F.col("n2"))])).collect()}
    assert kept() == {1, 2, 3} and kept(accepted="yes") == {1} and kept(accepted="no") == {2, 3} and kept(level=5) == {1, 2}
    assert kept(trust="pass") == {2} and kept(trust="fail") == {3} and kept(trust="unjudged") == {1}
    assert kept(entities=(("gene", "a"),)) == {1, 2, 3} and kept(entities=(("gene", "a"), ("drug", "b"))) == {1}


def test_pruning_and_totals(spark):
    pairs = spark.createDataFrame([(1, 2, True), (3, 4, False)], "a int, b int, ok boolean")
    rows = spark.createDataFrame([(1, 2, "d1", 2), (3, 4, "d2", 5), (1, 2, None, 1)], "a int, b int, doc string, q int")
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc string")
    kept, of, left = filters.pruned(pairs, F.col("ok"), rows, ["a", "b"], docs, "doc")
    assert kept.count() == 1 and of.count() == 2 and [r["doc"] for r in left.collect()] == ["d1"]
    named = kept.withColumn("k", F.lit("x"))
    assert filters.totals(named, "ok", [("k", "a"), ("k", "b")], of, "q").first().asDict() == {"pairs": 1, "accepted": 1, "rejected": 0, "entities": 2, "quotes": 3}
    assert filters.totals(named.limit(0), "ok", [("k", "a")], of.limit(0), "q").first().asDict() == {"pairs": 0, "accepted": 0, "rejected": 0, "entities": 0, "quotes": 0}


# --- relations


def test_labels(spark):
    rules = spark.createDataFrame([("A", "B", "positive", 1), ("B", "C", "negative", 2), ("A", "D", None, 3), ("E", None, "neutral", 4)], "o string, c string, p string, n int")
    got = {r["label"]: r["polarity"] for r in relations.polarities(rules, "o", "c", "p", "n").collect()}
    assert got == {"A": "positive", "B": "negative", "C": "negative", "E": "neutral"}
    used = spark.createDataFrame([("a ",), ("B",), ("Z",), (None,)], "l string")
    changed = {r["l"]: r["rewritten"] for r in relations.consolidated(used, "l", rules, "o", "c", "n").collect()}
    assert changed == {"D": True, "C": True, "Z": False, None: False}
    assert {r["l"] for r in relations.unclassified(used, "l", rules, "o").collect()} == {"a ", "Z"}
    assert {r["l"]: r["polarity"] for r in relations.with_polarity(used.where("l = 'Z'"), "l", relations.polarities(rules, "o", "c", "p", "n")).collect()} == {"Z": "neutral"}


def test_co_mention_kinds(spark):
    found = spark.createDataFrame([("d", "x", 5, 8), ("d", "x", 5, 50), ("d", "y", 1, 2)], "doc string, n string, p int, q int")
    spans = spark.createDataFrame([("d", "x", 0, 10), ("d", "x", 40, 60)], "doc string, n string, s int, e int")
    assert [r["kind"] for r in relations.co_mention_kind(found, ["doc", "n"], "p", "q", spans).orderBy("n", "q").collect()] == ["covered", "uncovered_region", "no_existing_assessment"]


def test_decisions_by_number_and_token(spark):
    pairs = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b")], "number int, token string, pair string")
    asked = spark.createDataFrame([(1, 1, "t1"), (2, 1, "t2"), (3, 2, None), (4, None, "t1"), (5, 9, "zz")], "d int, number int, token string")
    got = {r["d"]: (r["pair"], r["conflict"]) for r in relations.decided_pairs(asked, "number", "token", pairs).collect()}
    assert got == {1: ("a", False), 2: ("b", True), 3: ("b", False), 4: ("a", False)}


def test_overlap_and_groups(spark):
    arrays = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    both = lambda a, an, b, bn: one(spark, relations.tokens_overlap(arrays(*a), arrays(*an), arrays(*b), arrays(*bn)))[0]
    assert both(["pah", "idiopathic"], [], ["pulmonary", "arterial", "hypertension"], ["pah"]) and not both(["a"], [], ["b"], ["c"])
    assert both(["a", "b"], [], ["a", "c"], []) and not both(["a", "b", "c", "d"], [], ["a", "x", "y", "z"], [])
    groups = spark.createDataFrame([(1, ["b", "a"], "k", 0.5), (2, ["a", "b"], "k", 0.9), (3, ["a", "b"], "k", 0.9), (4, ["a", "b"], "j", 0.1)], "o int, m array<string>, k string, s double")
    assert {r["o"] for r in relations.distinct_groups(groups, "m", "k", "s", "o").collect()} == {2, 4}


# --- matching


def test_matching_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    known = sorted({word(rng.randrange(6, 26)) for _ in range(60)})
    asked = set(rng.sample(known, 10))
    for k in known:
        x = list(k)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(x))
            x[i : i + 1] = rng.choice([[], [rng.choice("abcde")], [x[i], rng.choice("abcde")]])
        asked.add("".join(x))
    frame = spark.createDataFrame([(k, []) for k in known], "name string, aliases array<string>")
    got = {r["name"]: (r["canonical"], r["how"]) for r in entities.match(spark.createDataFrame([(a,) for a in asked], "name string"), "name", entities.variant_map(frame, "name", "aliases")).collect()}
    want = {}
    for a in asked:
        if a in known:
            want[a] = (a, "exact")
            continue
        scores = []
        for k in known:
            d, short = names.osa(a, k), min(len(a), len(k))
            if short and d <= 1 + short // 10 and 1 - d / short >= 0.7 and (names.obvious_variant(a, k) or short >= 10 and d > 1):
                scores.append((1 - d / short, k))
        scores.sort(key=lambda x: (-x[0], x[1]))
        if scores and (len(scores) == 1 or scores[0][0] - scores[1][0] >= 2 * (1 - scores[0][0])):
            want[a] = (scores[0][1], "fuzzy")
    assert got == want and sum(h == "fuzzy" for _, h in want.values()) > 5


# --- evidence


def test_three_best_rows_of_a_hot_pair(spark):
    rng = random.Random(5)
    rows = [(1, 2, i, 2000, rng.randrange(1, 6), rng.randrange(1, 400), i) for i in range(3000)] + [(1, 3, 1, None, 2, 10, 0)]
    df = spark.createDataFrame(rows, "a int, b int, doc int, y int, r int, q int, o int")
    got = {r["b"]: r for r in evidence.pair_entries(df, ["a", "b"], "doc", "y", "r", "q", 2000, "o").collect()}
    import math

    best = sorted((x for x in rows if x[1] == 2), key=lambda x: (-x[4] * (1 - math.exp(-x[5] / 200)), x[6]))[:3]
    assert got[2]["row_count"] == 3000 and got[2]["substantiated"] == sum(x[4] for x in best) / 3 and got[3]["age_w"] == 0
    assert evidence.pair_entries(df.limit(0), ["a", "b"], "doc", "y", "r", "q", 2000, "o").count() == 0


# --- pages, licences, runs


def test_answers(spark):
    cite = '{"type":"message","content":[{"type":"output_text","annotations":[{"type":"url_citation","url":"https://a.example/x?utm_source=q","title":""},{"type":"url_citation","url":"https://a.example/x","title":"T"},{"type":"other","url":"https://no.example"}]},{"type":"refusal"}]}'
    call = '{"type":"web_search_call","action":{"sources":[{"url":"https://b.example/"},{"url":""},{"url":"https://a.example/x"}]}}'
    df = spark.createDataFrame([(f"[{call},{cite}]",), (f'{{"output":[{cite}]}}',), ("not json",), (None,)], "j string")
    got = [r["x"] for r in df.select(fetched.answered(F.col("j"), 5).alias("x")).collect()]
    assert [(x["title"], x["url"], round(x["relevance"], 2)) for x in got[0]] == [("a.example", "https://a.example/x", 1.0), ("b.example", "https://b.example/", 0.95)]
    assert got[1:] == [[], [], []] or got[1:] == [[], None, None]


def test_pages(spark):
    long = "x" * 4000
    cases = [(long, None, False, False), ("", None, True, False), ("", None, False, True), ("short", "Free Full Text", True, True), ("short", "", True, False), (long, "Are you a robot?", True, True), (None, None, None, True)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, m string, h string, s boolean, want boolean")
    assert [r for r in df.select("i", fetched.needs_retry(F.col("m"), F.col("h"), F.col("s")).alias("r"), "want").collect() if r["r"] != r["want"]] == []
    base = spark.createDataFrame([("p", "# A\nsome text"), ("q", "# B\ntext")], "k string, t string")
    other = spark.createDataFrame([("p", "l1", "# A\nsome text " + "more " * 9), ("p", "l2", "# A\nsome text " + "more " * 20), ("p", "l3", "# C\n" + "x" * 500), ("p", "l4", "# A\n" + "more " * 900)], "k string, l string, c string")
    got = {r["k"]: (r["l"], len(r["t"])) for r in fetched.fullest(base, "k", "t", other, "l", "c").collect()}
    assert got["p"][0] == "l2" and got["q"] == (None, 8)


def test_cache_log(spark):
    log = spark.createDataFrame([("u", "md", "1", 1), ("u", "md", "2", 2), ("u", "pdf", "3", 1), (None, "md", "4", 9)], "url string, kind string, content string, t int")
    assert {(r["url"], r["kind"], r["content"]) for r in fetched.stored(log, "url", "kind", ["t"]).collect()} == {("u", "md", "2"), ("u", "pdf", "3")}
    new = spark.createDataFrame([("a", "md", "5", 1, "b"), ("c", "md", "6", 1, None)], "url string, kind string, content string, t int, final string")
    assert fetched.put(log, new, "url", "final").count() == 4 + 3
    bad = spark.createDataFrame([("u", "x", 1), ("u", None, 2), ("v", None, 1), ("v", "y", 3)], "url string, reason string, t int")
    assert {(r["url"], r["reason"]) for r in fetched.failures(bad, "url", "reason", "t").collect()} == {("v", "y")}
    urls, counts = fetched.to_fetch(spark.createDataFrame([("u",), ("v",), ("w",), ("w",), (None,)], "url string"), "url", log.where("url = 'u'"), fetched.failures(bad, "url", "reason", "t"))
    assert [r["url"] for r in urls.collect()] == ["w"] and counts.first().asDict() == {"total": 3, "cached": 1, "failed": 1, "open": 1}


def test_licences(spark):
    cases = [(["cc-by-nc", "cc-by"], None, None, "redistributable", "cc-by"), (["x", None, "cc-by-nd"], None, None, "share-alike", "cc-by-nd"), (["b", "a"], None, None, "restricted", "a"), ([], "bronze", None, "restricted", None), ([], None, None, "restricted", None), (["cc-by"], None, "http-500", "unknown", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l array<string>, s string, e string, v string, n string")
    rows = df.select("v", "n", fetched.licence(F.col("l"), F.col("s"), F.col("e")).alias("x")).collect()
    assert all(r["x"]["verdict"] == r["v"] and r["x"]["licence"] == r["n"] and r["x"]["reason"] for r in rows)
    assert one(spark, fetched.match_keys(F.lit("doi"), F.lit("https://doi.org/10.1/a")), fetched.match_keys(F.lit("pmid"), F.lit("https://x/123")))[:] == (["10.1/a", "https://doi.org/10.1/a"], ["123", "https://x/123"])


def test_runs(spark):
    version = lambda x: F.struct(*[F.lit(v).alias(n) for v, n in zip(x, ("major", "minor", "patch"), strict=True)])
    breaks = lambda a, b: one(spark, bookkeeping.is_breaking(version(a), version(b)))[0]
    assert breaks((1, 2, 0), (2, 0, 0)) and breaks((0, 1, 0), (0, 2, 0)) and not breaks((1, 2, 0), (1, 9, 9)) and not breaks((0, 1, 0), (0, 1, 5))
    stages = lambda *have: one(spark, bookkeeping.stage_reached({s: F.lit(h) for s, h in zip(bookkeeping.STAGES, have, strict=True)}))[0]
    assert [stages(True, True, False), stages(False, False, False), stages(True, False, True)] == ["search", "none", "extraction"]
    assert all(t.count() == 0 for t in bookkeeping.empty_result(spark).values())
    pool = spark.createDataFrame([("2_zzzzzzzz", "https://b.example/", None), ("1_xxxxxxxx", "https://a.example/", "T")], "doc string, url string, title string")
    saved = [r["json"] for r in bookkeeping.saved_pool(pool, "doc", ["title"]).collect()]
    assert saved == ['{"id":"1_xxxxxxxx","url":"https://a.example/","title":"T"}', '{"id":"2_zzzzzzzz","url":"https://b.example/"}']
    read = one(spark, bookkeeping.read_pool(F.lit('[{"url":"https://a.example/"},{"id":"7_q","url":"u"}]'), "title:string"))[0]
    assert [r["id"].split("_")[0] for r in read] == ["1", "7"]


# --- texts


def test_quotes_in_the_words_of_the_text(spark):
    text = "The drug lowered the expression of hepatocellular markers, which two readers confirmed twice. Nothing else."
    assert documents.corrected("lowered the very expression of hepatocellular markers", text) == "lowered the expression of hepatocellular markers"
    assert documents.corrected("Nothing else", text) == "Nothing else" and documents.corrected("quite another thing altogether", text) is None
    assert documents.whole_words("one two", 5, 6) == (4, 7) and documents.whole_words("one two", 0, 3) == (0, 3) and documents.whole_words("", 0, 0) == (0, 0)
    df = spark.createDataFrame([("one twö three", 5, 6), ("one twö three", 3, 4), ("one", 0, 3)], "t string, s int, e int")
    assert [tuple(r[0]) for r in df.select(documents.words_around(F.col("t"), F.col("s"), F.col("e"))).collect()] == [(4, 7), (3, 4), (0, 3)]


def test_chunks_of_sentences(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    df = spark.createDataFrame([("a", text), ("b", None), ("c", " "), ("d", "one")], "d string, t string")
    rows = chunking.sentence_chunks(df, "d", "t", 30).orderBy("d", "chunk_no").collect()
    mine = [r for r in rows if r["d"] == "a"]
    assert " ".join(r["text"] for r in mine) == text and [r["chunk_no"] for r in mine] == list(range(len(mine))) and max(r["wordcount"] for r in mine) < 35
    assert {r["d"] for r in rows} == {"a", "d"}


def test_terms(spark):
    df = spark.createDataFrame([("Signaling pathways", 2, 0.5), ("signaling pathway", 1, 0.1), ("Kinases", 3, 0.9), (None, 0, 0.3)], "t string, o int, s double")
    assert {(r["t"], r["score"]) for r in keywords.deduplicated(df, "t", "o", "s").collect()} == {("signaling pathway", 0.1), ("Kinases", 0.9)}
    docs = spark.createDataFrame([(1, "Alpha beta binds gamma delta. Alpha beta blocks it."), (2, ""), (3, None), (4, "the of")], "d int, t string")
    got = keywords.extract_all(docs, "d", "t", ["tfidf", "rake", "yake"], 2).collect()
    assert {r["d"] for r in got} == {1} and {r["method"] for r in got} == {"tfidf", "rake", "yake"} and len(got) == 6


def test_scratch_tables_are_cleared(spark):
    from pathlib import Path

    from evidara.plans import lineage

    scratch = lineage.Scratch(spark, "cleared")
    assert scratch.save(spark.range(5)).count() == 5
    folder = Path(scratch.folder.removeprefix("file:").replace("//", "/"))
    assert folder.exists()
    lineage.clear(spark)
    assert not folder.exists()


def test_neighbours_of_a_large_class(spark):
    n = 30000  # the pairs of the one class would be 450,000,000
    classes = spark.range(n).select(F.col("id").alias("near"), F.lit("same").alias("name")).unionByName(spark.createDataFrame([(n, "other"), (n + 1, None)], "near long, name string"))
    edges = spark.createDataFrame([("s", 1, 5), ("s", 1, 7), ("s", 1, 7), ("s", 2, 5), ("s", 2, 7), ("s", 2, n), ("s", 2, n + 1), ("t", 1, 5), ("t", 3, 7), (None, 4, 5), (None, 4, 7)], "scope string, anchor long, near long")
    pairs = relations.neighbours_of_class(edges, "scope", "anchor", "near", classes, "name")
    assert [tuple(r) for r in pairs.collect()] == [("s", 5, 7, 1.0, 2)]


def test_shared_pairs_of_characters_in_long_texts(spark):
    def slow(form, plain, s, size):
        piece = plain[s : s + size]
        need, has = (Counter(x[k : k + 2] for k in range(len(x) - 1)) for x in (form, piece))
        return sum((need & has).values())

    rng = random.Random(3)
    for _ in range(200):
        plain = "".join(rng.choice("aab é") for _ in range(rng.randrange(60)))
        form, size = "".join(rng.choice("aabé") for _ in range(rng.randrange(12))), rng.randrange(1, 14)
        starts = sorted(rng.sample(range(len(plain)), len(plain) // 2))
        assert documents._shared_bigrams(form, plain, starts, size) == [slow(form, plain, s, size) for s in starts]
    words = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(50_000))
    plain, starts = words, list(range(0, len(words), 6))
    began = time.process_time()
    assert all(documents._shared_bigrams(words[k : k + 100], plain, starts, 100)[k // 6] == 99 for k in range(0, 6000, 600))
    assert time.process_time() - began < 1.2
