import random

import pytest

from evidara.llm import nearest
from evidara.llm.components import group_linked
from evidara.llm.nearest import Units, commonness, near_groups, near_links, near_pairs

SCHEMA = "doc_id string, text string, id string, rep string"


def jaccard(u, a, b):
    x, y = u.exact(a.lower()), u.exact(b.lower())
    return len(x & y) / len(x | y) if x | y else 0


@pytest.mark.parametrize("units", [Units("words", 3), Units("characters", 4)])
def test_against_all_pairs(spark, units):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(7)) for _ in range(900)]
    texts = {}
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(60)]
        texts[f"r{i:03d}"] = " ".join(words)
        for k in range(rng.choice([0, 0, 1, 2])):
            edited = list(words)
            for _ in range(rng.randrange(0, 6)):
                edited[rng.randrange(60)] = rng.choice(vocabulary)
            texts[f"r{i:03d}c{k}"] = " ".join(edited).upper() if k else " ".join(edited)
    df = spark.createDataFrame([(k, v, "z", "z") for k, v in texts.items()], SCHEMA)
    got = {tuple(r) for r in near_pairs(*near_groups(df, "doc_id", "text", units, 0.6)).collect()}
    names = sorted(texts)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if jaccard(units, texts[a], texts[b]) >= 0.6}
    assert not got - want and len(want) > 30 and len(want - got) <= 0.02 * len(want)


def test_copies_nulls_short_and_repeated(spark):
    long = "one two three four five six " * 30_000
    rows = [("a", "One two three four"), ("b", "one TWO three four"), ("c", "one TWO three four"), ("d", None), ("e", ""), ("f", "x"), ("g", "x"), ("h", long), ("i", long + "seven"), ("a", "One two three four")]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA)
    got = {tuple(r) for r in near_pairs(*near_groups(df, "doc_id", "text", Units("words", 3), 0.6)).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "c"), ("f", "g"), ("h", "i")}
    members, pairs = near_groups(df.limit(0), "doc_id", "text", Units("words", 3), 0.6)
    assert members.count() == 0 and pairs.count() == 0


def test_units_are_hashed_as_they_are_counted():
    for units in (Units("words", 3), Units("characters", 4)):
        texts = ["Ein é_b c, d12 e!", "", "ab", "a b c d a b c d", "😀😀😀😀😀 x y z"]
        unit, of = units.hashed([t.lower() for t in texts])
        assert [len(set(unit[of == i].tolist())) for i in range(len(texts))] == [len(units.exact(t.lower())) for t in texts]


def test_runs_hold_whole_texts(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(nearest, "AT_ONCE", 10)
    parts = list(nearest._parts(pd.Series(["aaaa", "bbbb", "C" * 50, "d"])))
    assert parts == [(0, ["aaaa", "bbbb"]), (2, ["c" * 50]), (3, ["d"])]


def test_a_third_of_the_rows_are_near_copies(spark, monkeypatch):
    monkeypatch.setattr(nearest, "HOT", 50, raising=False)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(7)) for _ in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = {f"o{i:03d}": " ".join(rng.choice(vocabulary) for _ in range(120)) for i in range(600)}
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(120), 3):
            words[k] = rng.choice(vocabulary)
        texts[f"c{i:03d}"] = " ".join(words)
    units = Units("words", 3)
    df = spark.createDataFrame([(k, v, "z", "z") for k, v in texts.items()], SCHEMA)
    got = {tuple(r) for r in near_pairs(*near_groups(df, "doc_id", "text", units, 0.6)).collect()}
    sets = {k: units.exact(v) for k, v in texts.items() if k[0] == "c"}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert not got - want and len(want) > 40_000 and len(want - got) <= 0.01 * len(want)

    # Groups come out alike from far fewer pairs.
    members, links = near_links(df, "doc_id", "text", units, 0.6)
    links = links.cache()
    group = {r["entity_name"]: r["group_name"] for r in group_linked(links.selectExpr("0 AS scope", "rep_a", "rep_b"), "scope", "rep_a", "rep_b").collect()}
    assert members.count() == len(texts) and links.count() < 0.2 * len(want) and {tuple(r) for r in links.select("rep_a", "rep_b").collect()} <= got
    assert {k for k in group} == {x for p in want for x in p} and set(group.values()) == {"c000"}


def test_common_units_do_not_depend_on_batches(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice("a b c d e f g h i j k l m n o p".split()) for _ in range(30)),) for _ in range(700)]
    df = spark.createDataFrame(rows, "text string")
    seen = []
    for batch, parts in ((10_000, 1), (40, 3), (7, 8)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        seen.append(commonness(df.repartition(parts), Units("words", 2)).tolist())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any(seen[0]) and seen[0] == seen[1] == seen[2]


def test_records_with_a_common_phrase_are_not_met(spark):
    from evidara.llm.nearest import _Near

    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(n))
    rows = [(f"p{i:03d}", f"{word(50)} qxzjqyqxwjzyq hqzj xqj {word(50)}", "z", "z") for i in range(300)] + [(f"o{i:04d}", word(120), "z", "z") for i in range(900)]
    rows += [(f"q{i:03d}", rows[i][1][:-6] + word(6), "z", "z") for i in range(20)]
    near = _Near(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", Units("characters", 4), 0.6)
    no = {r["id"]: r["no"] for r in near.reps.collect()}
    met = {(r["a"], r["b"]) for r in near.met().collect()}
    assert {tuple(sorted((no[f"p{i:03d}"], no[f"q{i:03d}"]))) for i in range(20)} <= met and len(met) < 500


def test_sketches_keep_similar_sets():
    import numpy as np

    rng, most, sets = np.random.default_rng(3), nearest.bits_apart(0.6), []
    for _ in range(3000):
        n = int(rng.integers(4, 300))
        unit = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        own = n // 4  # as many in each alone as leave at least 0.6 in both
        sets += [unit[:n], np.concatenate([unit[: n - own], unit[n : n + own]])]
    got = nearest.sketches(np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets[:-1]]))
    assert got["size"].tolist() == [len(x) for x in sets]
    bits = np.stack([got[f"s{k}"].view(np.uint64) for k in range(4)])
    apart = np.bitwise_count(bits[:, ::2] ^ bits[:, 1::2]).sum(axis=0)
    sums = got["size"][::2] + got["size"][1::2]
    assert all(d <= (most[s] if s < len(most) else 256) for d, s in zip(apart.tolist(), sums.tolist(), strict=True))
    assert most[280] < 90 and most[40] < 30
