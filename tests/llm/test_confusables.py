import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from evidara.llm.confusables import LOOK_ALIKE, Terms, aligned, find_look_alikes, script_sets, unify, unify_texts

TERMS = "term_id int, name string"


def test_unify():
    assert unify("ＮＢＲＬ６５５－Ｒ２") == "NBRL655-R2"
    assert unify("NВRL655‑R2") == "NBRL655-R2"
    assert unify("re​da­ro﻿") == "redaro"
    assert unify("été x") == "été x"
    assert unify("ﬁbro") == "fibro"
    assert unify("Москва") == "Москва" and unify("PTK-α") == "PTK-α"  # real words and symbols stay
    assert unify("x²") == "x²" and unify("Cafe") != unify("Café") and unify("ab") != unify("AB")
    assert unify("") == ""


def test_script_sets():
    assert "Latin" in script_sets("соре") and script_sets("дом") == {"Cyrillic"} and script_sets("123") is None
    assert script_sets("aдb") == set()


def test_whole_words_of_texts(spark):
    terms = spark.createDataFrame([(1, "NBRL655-R2"), (2, "été x"), (3, None), (4, "")], TERMS)
    rows = [
        ("a", "the NВRL655-R2, is"), ("b", "the NBRL655-R2 is"), ("c", "xNВRL655-R2"), ("d", "été x"), ("e", None), ("f", ""),
        ("g", "​NBRL655-R2​"), ("h", "N​BRL655-R2 " * 20_000), ("h", "N​BRL655-R2"), ("i", "été x"), ("j", "été xy"),
    ]
    texts = spark.createDataFrame([(*r, 0) for r in rows], "doc_id string, text string, record_id int")
    got = {tuple(r) for r in find_look_alikes(texts, "doc_id", "text", terms, whole=False).collect()}
    assert got == {("a", 1), ("d", 2), ("h", 1), ("i", 2)}
    assert find_look_alikes(texts.limit(0), "doc_id", "text", terms, whole=False).count() == 0
    assert find_look_alikes(texts, "doc_id", "text", terms.limit(0), whole=False).count() == 0


def test_whole_aliases_and_odd_reference_names(spark):
    terms = spark.createDataFrame([(1, "abc"), (2, "d​e")], TERMS)
    mentions = spark.createDataFrame([(1, ["аbc", None]), (2, ["abc"]), (3, None), (4, []), (5, ["de"]), (6, ["ABC", "АBC"])], "mention_id long, aliases array<string>")
    got = {tuple(r) for r in find_look_alikes(mentions, "mention_id", "aliases", terms, whole=True).collect()}
    assert got == {("1", 1), ("5", 2)}
    rewritten = {r["mention_id"]: r["aliases"] for r in unify_texts(mentions, "aliases").collect()}
    assert rewritten == {1: ["abc", None], 2: ["abc"], 3: None, 4: [], 5: ["de"], 6: ["ABC", "ABC"]}


def test_terms_are_found_beside_each_other():
    t = Terms([(1, "ab"), (2, "ab cd")])
    assert t.inside("ａb cd") == {1, 2} and t.same("ａb") == {1} and t.same("ab") == set()


def test_letters_of_many_scripts():
    t = Terms([(1, "Córdoba syndrome"), (2, "ataxia"), (3, "lupus"), (4, "Ebola"), (5, "Lupus")])
    for text, term in (("Cо\u0301rdoba syndrome", 1), ("Co\u0301rd\u200boba syndrome", 1), ("ɑtaxia", 2), ("αtaxia", 2), ("lυpus", 3), ("Ꭼbola", 4), ("ꓡupus", 5), ("ataxıa", 2)):
        assert t.same(text) == {term} == t.inside(f"the {text}, is"), text
    for text in ("PTK-α", "IFNα", "α-helix", "γ2", "Ελλάδα", "Москва"):
        assert unify(text) == text


def test_tables_hold_single_letters():
    for table in LOOK_ALIKE.values():
        assert all(len(unicodedata.normalize("NFD", a)) == 1 and b.isascii() and b.isalpha() for a, b in table.items())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab о\u0301\u200bｂﬁéαлÅ1-\u1100\u1161", max_size=12))
def test_positions(text):
    form, at = aligned(text)
    assert form == unify(text) and len(at) == len(form) + 1 and at == sorted(at) and at[-1] == len(text)
    assert unify(form) == form


def test_more_terms_than_a_block_holds(spark):
    terms = spark.createDataFrame([(i, f"name{i}") for i in range(40)], TERMS)
    texts = spark.createDataFrame([(i, f"the nаme{i} is") for i in range(40)], "doc_id int, text string")
    got = {(r["record_id"], r["term_id"]) for r in find_look_alikes(texts, "doc_id", "text", terms, whole=False, block=7).collect()}
    assert got == {(str(i), i) for i in range(40)}
