import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from evidara.functions import names, scalars
from evidara.operators import decisions, documents, entities, evidence, islands, keywords, search
from evidara.plans.lineage import Scratch
from evidara.plans.ranking import running_sum
from evidara.sources import readers
from evidara.sources.captured import captured_search
from evidara.streaming import events as log


def test_running_sum_over_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 7}", i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    got = {r["id"]: r["s"] for r in running_sum(df, Scratch(spark, "t"), ["k"], ["id"], "v", "s").collect()}
    total, want = defaultdict(int), {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        want[i] = total[k]
        total[k] += v
    assert got == want


def test_fractional_ranks_average_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 5), (4, 1)], "id int, v int")
    assert {r["id"]: r["r"] for r in evidence.fractional_ranks(df, "v", "r").collect()} == {2: 1.0, 1: 2.5, 3: 2.5, 4: 4.0}


def test_median_mode_and_spread(spark):
    df = spark.createDataFrame([(1, 3, "b", "positive"), (2, 4, "a", ""), (3, 9, "a", None), (4, 1, "b", "negative")], "ord int, overall int, f string, polarity string").withColumn("k", F.lit(1))
    got = evidence.aggregate_evidence(df, ["k"], "overall", ["f"], "ord").first()
    assert (got["overall"], got["f"]) == (3, "b")
    s = evidence.spread(df, ["k"], "polarity", "overall").first()
    assert (s["n_irrelevant"], s["best_irrelevant"], s["n_positive"], s["n_neutral"], s["best_neutral"]) == (2, 9, 1, 0, 0)


def test_fuzzy_pairs_against_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdeghijkmnoprt ") for _ in range(rng.randrange(4, 30))).strip() for _ in range(60)]
    forms = set(base)
    for b in base:
        for _ in range(2):
            c = list(b)
            for _ in range(rng.randrange(1, 4)):
                k = rng.randrange(len(c))
                c[k : k + 1] = rng.choice([[], [rng.choice("abcde")], [c[k], rng.choice("xyz")]])
                if len(c) < 3:
                    break
            forms.add("".join(c))
        forms.add(b + rng.choice(["s", "es", ""]))
    forms = sorted({names.comparable(f) for f in forms if f.strip()} - {""})
    want = {(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if names.names_match(a, b)[0] and names.names_match(a, b)[1] > 0}
    got = {(r["a"], r["b"]) for r in entities.fuzzy_pairs(spark.createDataFrame([(f,) for f in forms], "form string"), "form").collect()}
    assert got <= want and len(want) > 40
    assert want - got == set()


def test_chains_and_circles(spark):
    rules = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x"), ("s", "s"), ("n", None)] + [(f"l{i}", f"l{i + 1}") for i in range(40)]
    df = spark.createDataFrame([("k", s, t, i) for i, (s, t) in enumerate(rules)], "kind string, s string, t string, event int")
    got = {r["source"]: r["target"] for r in entities.final_targets(df, "kind", "s", "t", ["event"]).collect()}
    assert got["a"] == "c" and got["x"] == "x" and got["y"] == "y" and got["w"] == "x" and got["l0"] == "l40" and "s" not in got and "n" not in got
    assert entities.final_targets(df.limit(0), "kind", "s", "t", ["event"]).count() == 0


def average_linkage(pairs, threshold):
    sim = {frozenset(p[:2]): p[2] for p in pairs}
    groups = [frozenset([x]) for x in {x for p in pairs for x in p[:2]}]
    while True:
        best = None
        for i, g in enumerate(groups):
            for h in groups[i + 1 :]:
                s = sum(sim.get(frozenset([x, y]), 0) for x in g for y in h) / len(g) / len(h)
                if s >= threshold:
                    a, b = sorted((min(g), min(h)))
                    if best is None or (-s, a, b) < best[0]:
                        best = ((-s, a, b), g, h)
        if not best:
            return {x: min(g) for g in groups for x in g}
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]


def test_clusters_against_the_greedy_definition(spark):
    rng = random.Random(9)
    pairs = [(f"n{i:02d}", f"n{j:02d}", round(rng.random(), 6)) for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.35]
    got = {r["entity"]: r["cluster"] for r in entities.cluster(spark.createDataFrame(pairs, "a string, b string, similarity double"), 0.3).collect()}
    assert got == average_linkage(pairs, 0.3)


def test_similarity_prefixes_lose_no_pair(spark):
    rng = random.Random(2)
    tokens = {f"e{i}": {rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 5))} for i in range(60)}
    df = spark.createDataFrame([(e, t) for e, ts in tokens.items() for t in ts], "e string, token string")
    spec = entities.specificity(df, "e", "token", F.lit(1.0))
    s = {r["token"]: r["specificity"] for r in spec.collect()}
    weight = lambda ts: sum(s[t] for t in ts)
    want = {(a, b) for a in tokens for b in tokens if a < b and weight(tokens[a] & tokens[b]) >= 0.5 * min(weight(tokens[a]), weight(tokens[b])) - 1e-12 and tokens[a] & tokens[b]}
    got = {(r["a"], r["b"]) for r in entities.similar_entities(df, "e", "token", spec, 0.5).collect()}
    assert {p for p in want if abs(weight(tokens[p[0]] & tokens[p[1]]) - 0.5 * min(weight(tokens[p[0]]), weight(tokens[p[1]]))) > 1e-9} <= got <= want


def test_islands_budget_and_lookups(spark):
    df = spark.createDataFrame([("d", 0, 5), ("d", 1, 2), ("d", 7, 9), ("d", 20, 21), ("e", 3, 4)], "doc string, s int, e int")
    got = {(r["doc"], r["s"], r["e"], r["spans"]) for r in islands.merged_spans(df, ["doc"], "s", "e", 2).collect()}
    assert got == {("d", 0, 9, 3), ("d", 20, 21, 1), ("e", 3, 4, 1)}
    part = islands.within_budget(df.withColumn("n", F.col("e") - F.col("s")), ["doc"], ["s", "e"], "n", F.lit(6)).collect()
    assert [(r["doc"], r["s"], r["taken"]) for r in sorted(part, key=lambda r: (r["doc"], r["s"]))] == [("d", 0, 5), ("d", 1, 1), ("e", 3, 1)]
    free = {(r["s"], r["e"]) for r in islands.longest_first(df.where("doc = 'd'"), ["doc"], "s", "e").collect()}
    assert free == {(0, 5), (7, 9), (20, 21)}
    pos = spark.createDataFrame([("d", "x", 1), ("d", "y", 5), ("d", "y", 90), ("d", "z", 12), ("e", "x", 5)], "doc string, name string, p int")
    assert {tuple(r) for r in islands.co_mentions(pos, "doc", "name", "p", 7).collect()} == {("d", "x", "y", 1, 5), ("d", "y", "z", 5, 12)}


def test_scalars(spark):
    one = spark.range(1).select(
        scalars.without_tracking(F.lit("https://x.org/a?utm_source=q&id=3&gclid=1&e=#f")).alias("u"), scalars.without_tracking(F.lit("https://x.org/a?utm_term=q")).alias("u2"), scalars.singular(F.lit("gene studies boxes diseases loss")).alias("s"),
        scalars.alpha_label(F.lit(0)).alias("a"), scalars.alpha_label(F.lit(27)).alias("b"), scalars.alpha_label(F.lit(702)).alias("c"), scalars.term_line(F.lit("BRCA1 # a gene &kind=gene, &note=two words")).alias("t"), scalars.term_line(F.lit("  # x")).alias("t2"),
        scalars.permitted_kinds(F.array(F.lit("g"), F.lit("d"), F.lit("g"))).alias("k"), scalars.is_list(F.lit("a, b, and c")).alias("l"), scalars.is_valid_form(F.lit("ab")).alias("v"), scalars.without_suffix(F.lit("TGF signaling pathway")).alias("w"),
        scalars.matches_pattern(F.lit("https://X.org/pdf/1.pdf"), F.lit("*.PDF")).alias("m"), scalars.matches_pattern(F.lit("https://x.org"), F.lit("y")).alias("m2"), scalars.url_hash36(F.lit("https://x.org/#a")).alias("h"), scalars.url_hash36(F.lit("https://x.org/")).alias("h2"),
        scalars.citation_ids(F.lit("see [1_abcd1234, 2_efgh5678] and [1_abcd1234] [x_1]")).alias("ids"), scalars.resource_id(F.lit(7), F.lit("https://x.org")).alias("rid"),
    ).first()
    assert (one["u"], one["u2"], one["s"]) == ("https://x.org/a?id=3#f", "https://x.org/a", "gene study box disease loss")
    assert (one["a"], one["b"], one["c"]) == ("A", "AB", "AAA")
    assert one["t"].asDict() == {"name": "BRCA1", "kind": "gene", "attributes": {"note": "two words"}} and one["t2"] is None
    assert one["k"] == {"g": ["g", "d"], "d": ["g"]} and one["l"] and not one["v"] and one["w"] == "TGF" and one["m"] and not one["m2"]
    assert one["h"] == one["h2"] and one["ids"] == ["1_abcd1234", "2_efgh5678"] and one["rid"].startswith("7_") and len(one["rid"]) == 10


def test_quotes_are_located():
    text = "We saw that TGF-β binds here. Later, the naïve cells grew slowly over many weeks in culture."
    assert documents.locate("binds here", text) == ("verbatim", [(18, 28)])
    how, spans = documents.locate("tgf beta binds ... naive cells", text)
    assert how == "normal" and [text[a:b] for a, b in spans] == ["TGF-β binds", "naïve cells"]
    assert documents.locate("cells grew slowly over very many weeks in cultures", text)[0] == "fuzzy"
    assert documents.locate("nothing of the kind", text) == ("none", []) and documents.locate("", text)[0] == "none"
    assert documents.shift_headings("# a\n## b\ntext", 3) == "### a\n#### b\ntext"


def test_sections_and_redaction(spark):
    text = "# T\n## Methods\nm\n## References\n1. r\n### Sub\nx\n## Discussion\nd"
    df = spark.createDataFrame([("a", text), ("b", None)], "doc string, text string")
    got = {r["doc"]: r["text"] for r in documents.without_apparatus(df, "doc", "text").collect()}
    assert got["a"] == "# T\n## Methods\nm\n## Discussion\nd" and got["b"] in (None, "")
    assert {(r["heading"], r["kind"]) for r in documents.headings(df, "doc", "text").collect()} >= {("Methods", "relevant"), ("References", "irrelevant"), ("T", "neutral")}
    body = "word " * 4000
    quotes = spark.createDataFrame([("a", 0, 400), ("a", 420, 900), ("a", 5000, 5400), ("a", -1, 4), ("a", 9, 9)], "doc string, s int, e int")
    rows = documents.skeletons(quotes, "doc", "s", "e", spark.createDataFrame([("a", body)], "doc string, text string"), "text").collect()
    assert sum(len(r["passage"]) for r in rows) <= 0.05 * len(body) + 1 and rows[-1]["passage"]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "Lipid storage rose. Lipid storage fell in the liver. The liver grew."), (2, None), (3, "single words, only commas; here")], "doc_id int, text string")
    best = {r["doc_id"]: r["keyword"] for r in keywords.extract(df, "doc_id", "text", "tfidf", 1).collect()}
    assert best[1] in ("liver", "lipid", "storage", "lipid storage") and set(best) == {1, 3}
    got = {(r["doc_id"], r["keyword"]): r["score"] for r in keywords.extract(df, "doc_id", "text", "rake").collect()}
    assert got[(1, "lipid storage rose")] == 1.0
    text = "The BRCA1 gene matters. BRCA1 repairs breaks. Cells divide. We thank many people for the repairs of BRCA1."
    scores = {r["keyword"]: r["score"] for r in keywords.extract(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), "doc_id", "text", "yake").collect()}
    assert scores["brca1"] > scores["people"] > 0 and "the" not in scores and all(0 < v < 1 for v in scores.values())
    terms = spark.createDataFrame([("BMP pathway", 0.5), ("BMPs", 0.9), ("ab", 1.0), ("12 34", 1.0)], "keyword string, score double")
    assert [(r["key"], r["keyword"]) for r in keywords.clean(terms, "keyword", "score").collect()] == [("bmp", "BMPs")]


def test_captured_responses(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"query": "q", "results": [{"title": "t", "url": "u", "score": 2}, {"title": "no url"}]}))
    (tmp_path / "b.json").write_text("not json")
    assert [tuple(r) for r in captured_search(spark, str(tmp_path)).collect()] == [("q", 0, "t", "u", None, 2.0)]
    xml = "<eSummaryResult><DocSum><Id>12</Id><Item Name=\"Title\" Type=\"String\">A t.</Item><Item Name=\"PubDate\" Type=\"Date\">2019 May</Item></DocSum></eSummaryResult>"
    row = spark.range(1).select(F.explode(search.summaries(F.lit(xml))).alias("s")).first()["s"]
    assert (row["id"], row["title"], row["year"], row["url"]) == ("12", "A t.", 2019, "https://pubmed.ncbi.nlm.nih.gov/12/")
    ids = spark.range(1).select(search.found_ids(F.lit("<Count>2</Count><IdList><Id>1</Id><Id>2</Id></IdList>")).alias("f")).first()["f"]
    assert ids["ids"] == ["1", "2"] and ids["count"] == 2
    js = json.dumps({"sources": [{"metadata": {"title": "T", "url": "u"}, "content": "c"}, {"metadata": {"title": "", "url": "v"}}]})
    assert [r["url"] for r in spark.range(1).select(F.explode(search.sources(F.lit(js), 5)).alias("s")).select("s.*").collect()] == ["u"]


def test_files(spark, tmp_path):
    (tmp_path / "terms.txt").write_text("A # x &kind=gene\n\n# only a remark\nB\n")
    assert {r["name"] for r in readers.term_list(spark, str(tmp_path / "terms.txt")).collect()} == {"A", "B"}
    (tmp_path / "run.json").write_text(json.dumps({"topic": "t", "resources": [{"doc_id": "1_a", "url": "u", "text": None}], "judgments": [{"entity1": "a", "entity2": "b", "accepted": True}], "usage": {"x": 3}}, indent=1))
    tables = readers.run_file(spark, str(tmp_path / "run.json"))
    readers.save_run(tables, str(tmp_path / "out"), "search")
    back = readers.load_run(spark, str(tmp_path / "out"), "search", "resources", "judgments")
    assert back["resources"].first()["doc_id"] == "1_a" and back["judgments"].first()["accepted"]


def test_decisions_log_and_redirects(spark):
    asked = spark.createDataFrame([("k1",), ("k2",)], "key string")
    recorded = spark.createDataFrame([("k1", "merge", 1), ("k1", "skip", 2)], "key string, decision string, event int")
    got = {r["key"]: (r["decision"], r["hit"]) for r in decisions.replay(asked, "key", recorded, F.lit("none")).collect()}
    assert got == {"k1": ("skip", True), "k2": ("none", False)}
    hops = spark.createDataFrame([("a", "b"), ("b", "c")], "url string, target string")
    assert {r["url"]: r["final_url"] for r in search.redirected(spark.createDataFrame([("a",), ("z",)], "url string"), "url", hops, 3).collect()} == {"a": "c", "z": "z"}
    seen = log.numbered(spark.createDataFrame([(i,) for i in range(50)], "t int"), ["t"])
    assert [r["t"] for r in log.since(seen, 47).orderBy("t").collect()] == [47, 48, 49]


def test_opposed_labels_and_versions(spark):
    from evidara.operators import report

    rules = spark.createDataFrame([("inhibits growth", ["Promotes growths", None]), ("promotes growth", None), ("binds", ["no such label"]), ("alone", ["alone"])], "label string, opposites array<string>")
    assert {tuple(r) for r in report.opposition(rules, "label", "opposites").collect()} == {("inhibits growth", "promotes growth"), ("promotes growth", "inhibits growth")}
    v = spark.range(1).select(report.version(F.lit("3v1.20.0#ab")).alias("a"), report.version(F.lit("1.2")).alias("b")).first()
    assert tuple(v["a"]) == (3, 1, 20, 0, "ab") and v["b"] is None


def test_fuzzy_pairs_with_swaps(spark):
    rng = random.Random(12)
    forms = {"abcdefghijkl", "abcedfghixkl"}
    for n in (10, 12, 15, 21, 26):
        for _ in range(6):
            base = "".join(rng.choice("abcdeghijkmnoprt") for _ in range(n))
            c, k = list(base), 0
            for _ in range(1 + n // 10):
                k = rng.randrange(n - 1)
                c[k : k + 2] = c[k : k + 2][::-1]
            forms |= {base, "".join(c)}
    forms = sorted({names.comparable(f) for f in forms} - {""})
    want = {(a, b) for i, a in enumerate(forms) for b in forms[i + 1 :] if names.names_match(a, b)[0] and names.names_match(a, b)[1] > 0}
    got = {(r["a"], r["b"]) for r in entities.fuzzy_pairs(spark.createDataFrame([(f,) for f in forms], "form string"), "form").collect()}
    assert got == want and ("abcdefghijkl", "abcedfghixkl") in got


def test_names_of_one_form_are_all_consolidated(spark):
    from evidara.operators import pipeline

    writings = ["TGF beta", "TGF-beta", "tgf-beta", "TGF Beta", "Tgf beta", "TGF-Beta"]
    rows = [(w, []) for w in writings] + [("TGF-beta", []), ("hepatocyte", [])]
    got = {tuple(r) for r in pipeline.consolidate(spark.createDataFrame(rows, "name string, aliases array<string>"), "name", "aliases", 0.5).collect()}
    assert got == {(w, "TGF-beta") for w in writings if w != "TGF-beta"}


def test_name_clusters_average_over_all_pairs(spark, monkeypatch):
    from evidara import catalog

    rng = random.Random(0)
    tokens = {f"n{i:02d}": set(rng.sample("abcdefghijklmnopqrst", rng.randrange(2, 7))) for i in range(16)}
    df = spark.createDataFrame([(e, t) for e, ts in tokens.items() for t in ts], "e string, token string")
    monkeypatch.setattr(catalog, "_name_tokens", lambda spark, folder: df)
    s = {r["token"]: r["specificity"] for r in entities.specificity(df, "e", "token", F.lit(1.0)).collect()}
    weight = lambda ts: sum(s[t] for t in ts)
    pairs = [(a, b, round(weight(tokens[a] & tokens[b]) / min(weight(tokens[a]), weight(tokens[b])), 9)) for a in tokens for b in tokens if a < b and tokens[a] & tokens[b]]
    assert any(p[2] < 0.3 for p in pairs)
    got = {r["entity"]: r["cluster"] for r in catalog.name_clusters(spark, "").collect()}
    cut = average_linkage([p for p in pairs if p[2] >= 0.3], 0.3)
    assert got == average_linkage(pairs, 0.3) and any(got[k] != cut[k] for k in cut)


def test_equally_near_names_take_no_round_each(spark, monkeypatch):
    from evidara import catalog

    rows = [(f"n{i:02d}", t) for i in range(60) for t in ("related", "disorder", f"own{i}")] + [("x", "related"), ("y", "elsewhere")]
    df = spark.createDataFrame(rows, "e string, token string")
    monkeypatch.setattr(catalog, "_name_tokens", lambda spark, folder: df)
    saved, real = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: saved.append(1) or real(self, df))
    got = {r["entity"]: r["cluster"] for r in catalog.name_clusters(spark, "").collect()}
    assert got == {**{f"n{i:02d}": "n00" for i in range(60)}, "x": "n00"} and len(saved) < 25


def test_clusters_from_tokens_against_the_greedy_definition(spark, monkeypatch):
    from evidara.functions import linkage

    rng = random.Random(11)
    tokens = {f"n{i:02d}": set(rng.sample("abcdefgh", rng.randrange(1, 4))) | ({f"own{i}"} if i % 3 else set()) for i in range(24)}
    df = spark.createDataFrame([(e, t) for e, ts in tokens.items() for t in ts], "e string, token string")
    spec = entities.specificity(df, "e", "token", F.lit(1.0))
    pairs = [(r["a"], r["b"], round(r["similarity"], 9)) for r in entities.similar_entities(df, "e", "token", spec, 1e-9).collect()]
    want = average_linkage(pairs, 0.5)
    monkeypatch.setattr(linkage, "KEPT", 3)
    for alone in (entities.ALONE, 2):
        monkeypatch.setattr(entities, "ALONE", alone)
        assert {r["entity"]: r["cluster"] for r in entities.cluster_entities(df, "e", "token", spec, 0.5).collect()} == want
    assert 3 < len(set(want.values())) < 20


def test_quotes_everywhere_with_slips_and_shorthand(spark):
    text = "aaa binds. The hepatocellular carcinoma grew. ISCA1 is needed. It binds."
    rows = [(1, "binds", text), (2, "aa", text), (3, "hepatocelular carcinma", text), (4, "ISCA1,2", text), (5, "grew", text), (6, None, text)]
    got = {r["id"]: (r["how"], [tuple(s) for s in r["spans"]]) for r in documents.located(spark.createDataFrame(rows, "id int, q string, t string"), "q", "t").collect()}
    assert got[1] == ("verbatim", [(4, 9), (66, 71)]) and got[2] == ("verbatim", [(0, 2), (1, 3)]) and got[5][0] == "verbatim" and got[6] == ("none", [])
    assert got[3][0] == "fuzzy" and text[got[3][1][0][0] :].startswith("hepatocellular") and got[4][0] == "shorthand" and text[slice(*got[4][1][0])] == "ISCA1"


def test_forms_with_a_common_ending_are_no_candidates(spark):
    rng = random.Random(5)
    forms = ["".join(rng.choice("abcdeghijkmnoprt") for _ in range(14)) + " complex" for _ in range(200)]
    forms += [forms[0][1:], forms[1][:3] + "x" + forms[1][3:]]
    df = spark.createDataFrame([(f,) for f in forms], "f string")
    assert entities._met(df, df).count() < 100
    assert {(r["a"], r["b"]) for r in entities.fuzzy_pairs(df, "f").collect()} == {tuple(sorted((forms[0], forms[-2]))), tuple(sorted((forms[1], forms[-1])))}


def test_consolidated_names_with_a_common_ending(spark, monkeypatch):
    from evidara.operators import pipeline

    rng, met, real = random.Random(6), [], entities._met
    words = ["".join(rng.choice("abcdeghijkmnoprt") for _ in range(14)) + " complex" for _ in range(200)]
    monkeypatch.setattr(entities, "_met", lambda f, asked: met.append(real(f, asked)) or met[-1])
    df = spark.createDataFrame([(w, []) for w in [*words, words[0][1:], words[0]]], "name string, aliases array<string>")
    pipeline.consolidate(df, "name", "aliases", 0.5)
    assert len(met) == 1 and met[0].count() < 100
