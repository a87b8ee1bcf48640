import random

from evidara.llm.components import group_linked

SCHEMA = "kind string, source_norm string, target_norm string, label long, id string"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return {(k, n): g for k, n, g in group_linked(df, "kind", "source_norm", "target_norm").collect()}


def test_chains_circles_loops_nulls_and_kinds(spark):
    rows = [("g", "c", "b"), ("g", "b", "a"), ("g", "a", "c"), ("g", "a", "c"), ("p", "a", "z"), ("g", "self", "self"), ("g", "lost", None), ("g", None, "lost"), (None, "n", "m"), ("g", "", "x")]
    got = groups(spark, rows)
    assert got == {("g", "a"): "a", ("g", "b"): "a", ("g", "c"): "a", ("p", "a"): "a", ("p", "z"): "a", (None, "n"): "m", (None, "m"): "m", ("g", ""): "", ("g", "x"): ""}


def test_empty(spark):
    assert groups(spark, []) == {}


def test_binary_order_and_long_names(spark):
    long = "é" * 20_000
    got = groups(spark, [("g", "Z", "a"), ("g", "é", "z"), ("g", long, "é")])
    assert got[("g", "a")] == "Z" and got[("g", "é")] == "z" and got[("g", long)] == "z"


def test_against_union_find(spark):
    rng = random.Random(3)
    names = [f"n{i:03d}" for i in range(150)]
    rows = [(rng.choice("ab"), rng.choice(names), rng.choice(names)) for _ in range(130)]
    rows += [("c", f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]  # a long chain
    rows += [("d", "hub", n) for n in names]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for k, a, b in rows:
        if a != b:
            x, y = sorted((find((k, a)), find((k, b))))
            parent[y] = x
    assert groups(spark, rows) == {n: find(n)[1] for n in list(parent)}
