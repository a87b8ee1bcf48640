from pyspark.sql import functions as F

from evidara.operators import articles


def test_core_of_a_page():
    page = "Sign in or register\n# Site menu\nx\n# The title\nAuthors\n## Abstract\nWe saw things. " + "Body text. " * 40 + "\n## Share\nlinks\n## Methods\nDone well.\nFollow us on Twitter\n### Statistics\nt-test\n## References\n1. A\n## About us\nz"
    got = articles.refine(page)
    assert got.startswith("# The title") and "## Methods\nDone well.\n### Statistics\nt-test" in got
    assert not any(x in got for x in ("Share", "References", "Twitter", "Site menu", "About us"))


def test_pay_walls_guards_and_plain_texts():
    assert articles.refine("# Sign in\nto read\n## Purchase access\n$30") == "" and articles.refine("no headings\nat all") == "no headings\nat all"
    # A text that is no study stays whole where less than half would be left.
    assert articles.refine("# A thing\ntext\n## Funding\nmoney") == "# A thing\ntext\n## Funding\nmoney"
    assert articles.refine("# A thing\n" + "text " * 20 + "\n## Funding\nmoney") == "# A thing\n" + ("text " * 20).strip()
    long = "# Essay\n" + "Words. " * 300 + "\n## Summary\nShort.\n## References\n1."
    assert "Words." in articles.refine(long)


def test_kinds_agree_in_both_engines(spark):
    heads = ["Abstract", "References", "Log in to continue", "Statistical analysis", "Cookie policy", "Articles & Issues", "Musings", "", "Data availability", "Follow-up", "Supplementary files"]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    assert [r["k"] for r in df.select(articles.kind_column(F.col("h")).alias("k")).collect()] == [articles.kind_of(h) for h in heads]


def test_nulls_stay(spark):
    df = spark.createDataFrame([(None,), ("",), ("# T\n## Abstract\na\n## References\nb",)], "text string")
    assert [r["refined"] for r in articles.refined(df, "text").collect()] == [None, "", "# T\n\n## Abstract\na"]


def kinds(*names):
    return [h.kind for h in articles.in_context(articles.heads_of([f"## {n}" for n in names]))]


def test_kinds_by_context():
    assert kinds("Abstract", "Methods", "Results", "Competing interests", "About us") == ["relevant", "relevant", "relevant", "relevant", "irrelevant"]
    assert kinds("Musings", "About us", "Contact", "Newsletter") == ["neutral", "neutral", "neutral", "irrelevant"]


def start(text):
    return articles.second_start(articles.heads_of(text.split("\n")))


def test_pages_shown_twice():
    assert start("# A\n## Abstract\nx\n# A\n## Abstract\nx\n## Methods\ny") == 3
    assert start("# A\n## Abstract\nx\n# Full text\n## Methods\ny") == 3
    assert start("# A\n## Abstract\nx\n# Sign in\n## Methods\ny") == 0
    assert start("## Abstract\nx\n## Summary\nz\n## Abstract\nx") == 4 and start("## Abstract\nx") == 0


def test_what_stands_between_title_and_opening():
    study = "The study of patients with the disease showed that treatment of the gene has a result in clinical research of this kind, again and again."
    body = "\n## Abstract\n" + "We saw it. " * 30
    assert study in articles.refine(f"# T\n{study}{body}")
    authors = "A. Bee, Department of Things, University of Here, received in May, accepted in June and published in July of the same year, see the outline there."
    assert authors not in articles.refine(f"# T\n{authors}{body}")
    assert "One line." in articles.refine(f"# T\n## Study design overview\nOne line.{body}")
    assert "One line." not in articles.refine(f"# T\n## Nothing\nOne line.{body}")


def test_tails_references_and_labels():
    text = "# T\n## Abstract\n" + "We saw it. " * 30 + "\n## References\n1\n## Appendix\nmore\n## Share\nx\n## Oddments\ny"
    got = articles.refine(text)
    assert "## Appendix\nmore" in got and not any(x in got for x in ("References", "Share", "Oddments"))
    labelled = "# The treatment of things\nlinks\nAbstract\n" + "We saw it. " * 30 + "\nTerms of use\nz"
    assert articles.refine(labelled).endswith("We saw it.") and "links" not in articles.refine(labelled)
    assert articles.without_site(["Text.", "Related articles:", "One", "Methods", "Two", "Share on Facebook"]) == "Text.\nMethods\nTwo"


def test_headings_found():
    assert [(h.at, h.level, h.name) for h in articles.heads_of(["# A {#id}", "text", "###B", "#", "####### no"])] == [(0, 1, "a"), (2, 3, "b")]
