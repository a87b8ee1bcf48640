import random

import duckdb
import pytest

from evidara.llm import residue
from evidara.llm.residue import exclude_residue, find_residue

PROSE = "The {} of {} in the {} was followed by {} after week {}, which two readers confirmed (p = 0.0{}).".format
NOUNS = "binding release uptake relapse fibrosis growth edema silencing clearance turnover export remodeling".split()


def prose(rng, n=6):
    return " ".join(PROSE(*(rng.choice(NOUNS) for _ in range(4)), rng.randrange(90), rng.randrange(9)) for _ in range(n))


def test_held_out_residue_is_told_from_prose(spark):
    rng = random.Random(2)
    bad = [
        "Please switch on JavaScript in your browser to read this article.", "Error 502: the server could not be reached. Please try again later.", "We interpret the {{volume_number}} as secondary to edema.",
        "Dear ${reader_name}, thank you.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod.", "TODO TBD TODO TBD n/a TODO TBD", "Ut enim ad minim veniam quis nostrud exercitation", "[INSERT TABLE HERE]", "xxx xxxxx xxx xx xxxx xxx xxxxx",
    ]
    good = ["The viewer is written in JavaScript; enabling scripts was not required for the scoring itself.", "Of 12 invited carriers, 4 could not be found at the listed address and 404 declined.", "Coefficients are listed as ${x}$ in Table 3; 17 values were not available at baseline."]
    rows = [(i, prose(rng)) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 3)} {b} {prose(rng, 3)}") for i, b in enumerate(bad)] + [(2000 + i, b) for i, b in enumerate(bad)]
    rows += [(3000 + i, f"{prose(rng, 2)} {g} {prose(rng, 2)}") for i, g in enumerate(good)]
    rows += [(4000, None), (4001, ""), (4002, prose(rng, 5000)), (4003, "a"), (2000, bad[0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, id int")
    found = find_residue(df, "doc_id", "text").collect()
    ids = {r["doc_id"] for r in found}
    assert ids == {1000 + i for i in range(len(bad))} | {2000 + i for i in range(len(bad))}
    assert all(0 <= r["start"] < r["end"] for r in found)
    left = {r["doc_id"] for r in exclude_residue(df, "doc_id", "text").collect()}
    assert left == {r[0] for r in rows} - ids and {4000, 4001} <= left
    assert find_residue(df.limit(0), "doc_id", "text").count() == 0


def test_a_notice_that_is_a_third_of_the_rows(spark):
    rng = random.Random(6)
    notices = ["Your session has expired. Sign in again to continue reading.", "Database connection failed: timeout after {}s (host db{})", "The record has moved. Status {}. The file is no longer hosted here.", "Please switch on JavaScript in your browser to read this article."]
    for notice in notices:
        rows = [(i, prose(rng)) for i in range(400)] + [(1000 + i, notice.format(rng.randrange(100, 999), rng.randrange(9))) for i in range(200)]
        found = {r["doc_id"] for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
        assert found == set(range(1000, 1200)), notice


def test_short_texts_and_lines(spark):
    rng = random.Random(7)
    bad = ["404 Not Found", "403 Forbidden", "Access denied", "Bad Gateway", "Retry", "TBD", "xxx", "  Access Denied.  "]
    good = ["a", "Results", "Methods", "Binding", "fibrosis", "week 12"]
    rows = [(i, prose(rng)) for i in range(300)]
    for at, lines in ((1000, bad), (3000, good)):
        rows += [(at + i, x) for i, x in enumerate(lines)] + [(at + 100 + i, f"{prose(rng, 2)}\n{x}\n{prose(rng, 2)}") for i, x in enumerate(lines)]
    found = find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["doc_id"] for r in found} == {k + i for k in (1000, 1100) for i in range(len(bad))}
    texts = dict(rows)
    assert all(texts[r["doc_id"]][r["start"] : r["end"]].strip() in [b.strip() for b in bad] for r in found)


def test_held_out_sentences_of_neither_samples_nor_tables(spark):
    rng = random.Random(11)
    bad = [
        "Scripts are blocked in this browser, so the reader cannot start.", "You must turn on cookies before you can open the volume.", "Sorry, the issue you asked for is no longer on this server.", "We were unable to open that article. Please reload.",
        "Your account has been locked. Please contact support.", "Gateway timeout (504)", "Please sign in again, your login has expired.", "Die Seite ist derzeit nicht erreichbar. Bitte versuchen Sie es später.", "La page que vous demandez est introuvable.", "No se pudo cargar la página. Inténtelo de nuevo.",
        "Insert your conclusion here.", "Tempor incididunt magna aliqua ut labore dolore et elit sed.", "{{ hospital_name }}", "${ward}", "<%= outcome %>", "[your conclusion]", "@@REGION@@", "asdf asdf qwerty asdf qwerty foo bar",
    ]
    good = [
        "Scripts for the analysis were written in Python and are available from the authors.", "Three samples could not be found in the freezer and were replaced.", "The server that stored the images was replaced in week 12.", "Access to the records was granted by the ethics board.",
        "Every {{name}} field was filled in by hand.", "The set {a, b} was used throughout; f(x) = {x} is the identity.", "Errors of 5 % were tolerated, and two readers had to agree on the page.", "Participants were asked to log in to the app every day.", "Visits were moved to another site when a room was not available.",
        "The word lorem was one of twenty in the recall list.", "Patients whose session had ended early were asked to try again.",
    ]
    rows = [(i, prose(rng)) for i in range(400)]
    rows += [(1000 + i, b) for i, b in enumerate(bad)] + [(2000 + i, f"{prose(rng, 2)}\n\n{b}\n\n{prose(rng, 2)}") for i, b in enumerate(bad)]
    rows += [(3000 + i, f"{prose(rng, 2)} {g} {prose(rng, 2)}") for i, g in enumerate(good)]
    found = {r["doc_id"] for r in find_residue(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    missed = [b for i, b in enumerate(bad) for k in (1000, 2000) if k + i not in found]
    wrong = [good[i - 3000] for i in found if i >= 3000] + [i for i in found if i < 1000]
    print("missed", missed, "wrong", wrong)
    assert len(missed) <= 0.05 * 2 * len(bad) and len(wrong) <= 0.05 * len(good)


def test_no_sample_sentence_is_taken_from_the_tables():
    path = "/root/testdata/sf0.1/documents.parquet"
    try:
        texts = [t for (t,) in duckdb.execute(f"SELECT text FROM '{path}' WHERE text IS NOT NULL").fetchall()]
    except duckdb.Error:
        pytest.skip("no test tables")
    plain = lambda s: residue._DIGIT.sub("0", s.lower()).strip()
    known = {plain(s) for t in texts for s in residue._SENTENCE.split(t)}
    typed = {w for words in residue.TYPED for w in words.split()}
    samples = {plain(s) for x in residue._samples()[:2] for t in x for s in residue._SENTENCE.split(t)}
    assert [s for s in samples & known if s and not set(s.split()) <= typed] == []
