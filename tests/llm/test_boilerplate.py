import random

import pytest

from evidara.llm import boilerplate
from evidara.llm.boilerplate import align, describe, evidence, find_furniture, keep_articles

SCHEMA = "doc_id string, url string, title string, text string, site string, host string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my nu xi omikron pi rho sigma tau ypsilon".split()


def paragraph(i):
    return " ".join(WORDS[(i * 7 + k * (i % 5 + 1)) % 20] + str(i * 31 + k) for k in range(16)) + "."


def page(i, host="h.example"):
    title = f"The title of article {WORDS[i % 20]} number {i} about something"
    lines = ["Skip to content", "Home | About", "", f"# {title}", "", "Results", paragraph(i), "* A list item here" if i % 12 == 3 else "", "", "Methods", paragraph(i + 500), "Advertisement", f"Careers in {WORDS[i % 20]}", "", "© 2020 Journal", "Terms of use"]
    return (f"d{i:03d}", f"https://{host}/a/{i * 7919 % 1000:03d}", title, "\n".join(lines), "s", "x")


def test_furniture_of_a_host_is_found(spark):
    df = spark.createDataFrame([page(i) for i in range(150)], SCHEMA)
    got = {}
    for doc, line in find_furniture(df).collect():
        got.setdefault(doc, set()).add(line)
    assert len(got) == 150 and all(x == {0, 1, 11, 12, 14, 15} for x in got.values())
    text = {r["doc_id"]: r["article"] for r in keep_articles(df).collect()}["d003"]
    assert text.startswith("# The title") and "Advertisement" not in text and "* A list item here" in text


def test_nulls_empty_long_and_repeated(spark):
    rows = [("n", None, None, None, "s", "x"), ("e", "u", "t", "", "s", "x"), ("l", None, None, "word " * 200_000, "s", "x"), ("b", "https://h.example/a/1", None, "\n\n \n", "s", "x"), page(1), page(1)]
    got = {r["doc_id"] for r in find_furniture(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got <= {"d001"}
    kept = {r["doc_id"]: r["article"] for r in keep_articles(spark.createDataFrame(rows[:2], SCHEMA)).collect()}
    assert kept == {"n": None, "e": ""}
    assert find_furniture(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alignment_is_a_longest_common_subsequence():
    a, b = [1, 2, 3, 4, 5, 2], [2, 4, 3, 5, 2, 9]
    pairs = align(a, b)
    assert len(pairs) == 4 and all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and align([1], [2]) == [] and align([], [1]) == []


def test_templates_make_digits_and_site_names_equal():
    one, two = describe("© 2020 Rasara", None, "rasarajournals.test")[1], describe("© 1999 Bumole", None, "bumolelib.example")[1]
    assert one == two


def test_long_notices_of_a_host_are_found(spark):
    notice = "We and our partners use cookies to keep this site working, to remember what you read, to count visits and to show what may interest you; by reading on you agree to that, and you may change your mind at any time on the page of settings."
    legal = "The views in these pages are those of their authors and not of the publisher, who is not liable for any loss that comes of their use, whether direct or indirect, and who asks readers to seek the advice of a physician before they act."
    rows = []
    for i in range(60):
        doc, url, title, *rest = page(i)
        own = paragraph(i) + " " + paragraph(i + 900)
        rows.append((doc, url, title, "\n".join(["Skip to content", f"# {title}", notice, "", own, "", "Careers", legal, "© 2020 Journal"]), *rest[1:]))
    got = {}
    for doc, line in find_furniture(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(doc, set()).add(line)
    assert min(len(notice), len(legal)) > 200 and len(got) == 60 and all(x == {0, 2, 6, 7, 8} for x in got.values())


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 26, 30])
def test_alignment_against_the_full_table(monkeypatch, bits):
    monkeypatch.setattr(boilerplate, "TABLE_BITS", bits)
    for seed in range(500):
        rng = random.Random(seed)
        kinds = rng.choice([2, 5, 30])
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(25))] for _ in "ab")
        pairs = align(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_pages_of_many_lines():
    rng = random.Random(1)
    a, b = ([rng.randrange(50) for _ in range(30_000)] for _ in "ab")
    assert len(align(a, b)) > 6000


def test_menus_in_any_order_are_one_template():
    one, two = (describe(x, None)[1] for x in ("About | Help | Search", "Search / About / Sign in / News"))
    assert one == two != describe("growth, uptake, release", None)[1]


def test_repeated_ids_are_judged_apart(spark):
    rows = [page(i) for i in range(60)]
    doc, url, title, text, *rest = page(999)
    rows += [("twin", url, title, text, *rest), ("twin", url + "b", title, "Skip to content\n\n# " + title + "\n\n" + paragraph(77) + "\n\nAdvertisement", *rest)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = sorted(r["article"] for r in keep_articles(df).where("doc_id = 'twin'").collect())
    assert len(kept) == 2 and all(k.startswith("# ") and "Advertisement" not in k and "Skip" not in k for k in kept)
    assert paragraph(77) in kept[0] + kept[1] and paragraph(999) in kept[0] + kept[1]
    assert {r["evidence"] for r in evidence(df).collect()} <= {"line", "template", "elsewhere", "block"}
