import random

import pytest

from evidara.functions import names


@pytest.mark.parametrize(
    ("raw", "want"),
    [("TGF-β1", "tgfb1"), ("TGF-beta/BMP", "tgfb bmp"), ("menu", "men"), ("alphabet", "alphabet"), ("3.14", "314"), ("don't", "dont"), ("IL-6", "il6"), ("naïve  T-cell", "naive t cell"), ("", ""), ("α", "a"), ("--", "")],
)
def test_normal_form(raw, want):
    assert names.normalise(raw)[0] == want


def test_positions_point_into_the_text():
    text = "The TGF-β1 receptor (type II)"
    form, at = names.normalise(text)
    assert len(at) == len(form) + 1
    k = form.index("receptor")
    assert text[at[k] : at[k + 7] + 1] == "receptor"
    entries = names.offsets(text)
    assert [names.mapped(entries, i) for i in range(len(form))] == at[:-1]


def test_roman_numerals_and_years():
    assert names.comparable("Collagen type IV") == "collagen type 4" and names.comparable("CD45") == "cd45" and names.comparable("MCMXC") == "1990"


def test_distance():
    assert [names.osa(*p) for p in (("typo", "tpyo"), ("frog", "cat"), ("ca", "abc"), ("", "ab"), ("same", "same"))] == [1, 4, 3, 2, 0]


@pytest.mark.parametrize(
    ("a", "b", "how"),
    [("IL-6", "IL6", "exact"), ("tumour", "tumor", "spelling"), ("gene", "genes", "plural"), ("biopsy", "biopsies", "plural"), ("analysis", "analyses", "plural"), ("matrix", "matrices", "plural"), ("T cell", "Tcell", "spacing"), ("titre", "titer", "spelling"), ("neuropathia alba", "neuropathla alba", "fuzzy"), ("receptor kinase 1", "receptor kinase 2", None), ("abc", "abd", None)],
)
def test_names_match(a, b, how):
    assert names.names_match(a, b)[2] == how


def test_tokens_variants_and_shorthand():
    assert names.tokens("p16 INK4A") == ["ink4a", "p16", "p16ink4a"] and names.tokens("of the") == []
    assert names.slash_forms("GDF1/2") == ["GDF1/2", "GDF1", "GDF2"] and names.slash_forms("a/b/c") == ["a/b/c"] and names.slash_forms("ERBB2 / ERBB3")[1:] == ["ERBB2", "ERBB3"]
    forms = {f: s for f, s, _ in names.variants("Pulmonary arterial hypertension (PAH)", ["PH", None])}
    assert forms["pah"] <= 2 and forms["pulmonary arterial hypertension"] == 1 and forms["ph"] == 1
    assert names.shorthand("exons 2-4") == ["exons 2", "exons 3", "exons 4"] and names.shorthand("plain") == ["plain"]


def test_mentions():
    text = "TNF-α and IL 6; xTNFa. Interleukins are here"
    assert [text[a:b] for a, b in names.mentions_of(["TNF alpha", "interleukin"], text)] == ["TNF-α", "Interleukins"]
    assert names.mentions_of([], text) == []


def test_number_differences():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("ab12") for _ in range(6))
        b = "".join(rng.choice("ab12") for _ in range(6))
        assert names.only_numbers_differ(a, b) == names.only_numbers_differ(b, a)


def test_slashes_by_kind_of_ending():
    assert names.slash_forms("GDF1/12")[1:] == ["GDF1", "GDF12"] and names.slash_forms("HuC/D")[1:] == ["HuC", "HuD"]
    assert names.slash_forms("PTKab/cd")[1:] == ["PTKab", "cd"] and names.slash_forms("12ab/cd")[1:] == ["12ab", "12cd"]
    assert names.slash_forms("type I/II")[1:] == ["type I", "type II"] and names.slash_forms("IFNα/β")[1:] == ["IFNα", "IFNβ"] and names.slash_forms("IFN/β")[1:] == ["IFN", "β"]


def test_names_that_differ_in_writing_only():
    assert names.all_match(["Il-6", "IL-6", "IL6"]) and not names.all_match(["IL-6", "IL-7"]) and names.all_match([]) and names.all_match(["x"])
